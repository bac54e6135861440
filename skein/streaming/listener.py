"""Matching a live signal to a list of expected events: one state class for batches and streams.

The clock is the count of samples, so results do not depend on how the signal is cut into chunks.
Each hop updates the level and the spectral flux; an onset arms the decision; the spectrum after it is
explained as a sparse non-negative mix of the expected notes, their neighbours and octaves and what
still rings; the event is accepted when enough of its notes carry enough of the mix.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.functions import dsp


@dataclass(frozen=True)
class Settings:
    """Tuning of a listener; times in seconds."""

    rate: int = 48000
    hop: int = 512
    frame: int = 4096
    history: int = 256
    refresh: int = 16
    mads: float = 4.0
    floor: float = 2.0
    min_gap: float = 0.05
    quiet: float = 1e-3
    hear: float = 0.35
    early: float = 0.03
    ttl: float = 0.8
    present: float = 0.22
    wrong: float = 0.55
    ahead: int = 1
    strictness: str = "lenient"


@dataclass
class Target:
    """An expected event: the notes that have to be heard (MIDI numbers); none: any stroke counts."""

    id: str
    notes: tuple[int, ...]


def satisfied(notes: tuple[int, ...], heard: set[int], intruders: bool, strictness: str) -> bool:
    """Lenient: all of up to two notes, else all but one; strict: all and nothing else; bass: the lowest note, others in any octave."""
    if strictness == "strict":
        return all(n in heard for n in notes) and not intruders
    if strictness == "bass":
        classes = {h % 12 for h in heard}
        return min(notes) in heard and all(n % 12 in classes for n in notes)
    missing = sum(n not in heard for n in notes)
    return missing == 0 if len(notes) <= 2 else missing <= 1


@dataclass
class Listener:
    """Feed samples with ``push``; messages come back as dicts with ``kind`` onset, heard, accept or wrong."""

    targets: list[Target]
    settings: Settings = field(default_factory=Settings)
    at: int = 0
    current: int = 0
    armed: float = 0.0
    onset: float = -1e9
    judged: bool = True
    rest: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    ring: np.ndarray | None = None
    bands: np.ndarray | None = None
    fluxes: deque = field(default_factory=lambda: deque(maxlen=256))
    threshold: float = 0.0
    hops: int = 0
    evidence: dict = field(default_factory=dict)
    ringing: list = field(default_factory=list)

    def push(self, samples: np.ndarray) -> list[dict]:
        out: list[dict] = []
        s = self.settings
        data = np.concatenate([self.rest, np.asarray(samples, np.float32)])
        n = len(data) // s.hop * s.hop
        for lo in range(0, n, s.hop):
            out += self._hop(data[lo : lo + s.hop])
        self.rest = data[n:]
        return out

    def _hop(self, hop: np.ndarray) -> list[dict]:
        s = self.settings
        if self.ring is None:
            self.ring = np.zeros(s.frame, np.float32)
            self.fluxes = deque(maxlen=s.history)
        self.ring = np.concatenate([self.ring[s.hop :], hop])
        self.at += s.hop
        self.hops += 1
        now = self.at / s.rate
        out: list[dict] = []
        short = self.ring[-2048:]
        bands = _bands(2048, s.rate) @ dsp.spectrum(short)
        rise = dsp.flux(self.bands if self.bands is not None else np.zeros_like(bands), bands)
        self.bands = bands
        recent = list(self.fluxes)[-2:]
        mean = float(np.mean(list(self.fluxes)[-9:])) if self.fluxes else 0.0
        self.fluxes.append(rise)
        if self.hops % s.refresh == 1:
            past = np.array(self.fluxes)
            med = np.sort(past)[len(past) // 2]
            self.threshold = max(s.floor, float(med + s.mads * np.sort(np.abs(past - med))[len(past) // 2]))
        loud = dsp.level(hop)[0] > s.quiet
        if loud and rise >= max([*recent, 0.0]) and rise >= mean + self.threshold and now - self.onset >= s.min_gap:
            self.onset, self.judged = now, False
            self.evidence.clear()
            out.append({"kind": "onset", "t": now, "id": "", "midi": -1})
        since = now - self.onset
        if loud and not self.judged and 0.04 <= since <= s.hear and self.current < len(self.targets):
            out += self._listen(now)
        return out

    def _listen(self, now: float) -> list[dict]:
        s = self.settings
        x = dsp.spectrum(self.ring)
        hz = np.arange(len(x)) * s.rate / s.frame
        use = (hz >= 60) & (hz <= 4000)
        y = np.sqrt(x[use])
        out: list[dict] = []
        for skip in range(1 + s.ahead):
            i = self.current + skip
            if i >= len(self.targets):
                break
            notes = self.targets[i].notes
            if not notes:
                return out + self._accept(i, now)
            around = {n + d for n in notes for d in (-12, -2, -1, 1, 2, 12)} | set(self.ringing)
            names = [*notes, *sorted(around - set(notes))]
            weights = dsp.nnls(_templates(tuple(names), s.frame, s.rate), y, l1=0.02 * float(y.max()))
            total = max(float(weights.max()), 1e-12)
            fit = dict(zip(names, weights / total, strict=True))
            for n in notes:
                if fit[n] >= s.present:
                    if n not in self.evidence:
                        out.append({"kind": "heard", "t": now, "id": self.targets[i].id, "midi": int(n)})
                    self.evidence[n] = now
            heard = {n for n, t in self.evidence.items() if now - t <= s.ttl}
            intruders = [n for n in names[len(notes) :] if fit[n] >= s.wrong and n not in self.ringing and not any((n - m) % 12 == 0 for m in notes)]
            if satisfied(notes, heard, bool(intruders), s.strictness) and not intruders:
                return out + self._accept(i, now)
            if skip == 0 and intruders and now - self.onset >= 0.12:
                self.judged = True
                return [*out, {"kind": "wrong", "t": now, "id": self.targets[i].id, "midi": int(max(intruders, key=fit.get))}]
        return out

    def _accept(self, i: int, now: float) -> list[dict]:
        target = self.targets[i]
        self.ringing = list(target.notes)
        self.current, self.judged, self.armed = i + 1, True, now
        self.evidence.clear()
        return [{"kind": "accept", "t": self.onset, "id": target.id, "midi": -1}]


_CACHE: dict = {}


def _bands(n: int, rate: int) -> np.ndarray:
    if (key := (n, rate)) not in _CACHE:
        _CACHE[key] = dsp.semitone_bands(n, rate)
    return _CACHE[key]


def _templates(names: tuple[int, ...], frame: int, rate: int) -> np.ndarray:
    if (key := (names, frame, rate)) not in _CACHE:
        if len(_CACHE) > 4000:
            _CACHE.clear()
        hz = np.arange(frame // 2 + 1) * rate / frame
        _CACHE[key] = np.stack([dsp.note_template(n, hz[(hz >= 60) & (hz <= 4000)]) for n in names], axis=1)
    return _CACHE[key]


MESSAGE = "kind string, t double, id string, midi int"


def _targets(rows) -> list[Target]:
    return [Target(r["id"], tuple(int(n) for n in r["notes"])) for r in rows]


def follow(samples: DataFrame, targets: DataFrame, *, key: str = "session", settings: Settings | None = None) -> DataFrame:
    """Batch form: (key, kind, t, id, midi) from chunks (key, seq, samples) and events (key, idx, id, notes)."""
    own = settings or Settings()

    def run(k: tuple, chunks: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
        listener = Listener(_targets(events.sort_values("idx").to_dict("records")), own)
        out = [m for x in chunks.sort_values("seq")["samples"] for m in listener.push(np.asarray(x, np.float32))]
        return pd.DataFrame([{key: k[0], **m} for m in out], columns=[key, "kind", "t", "id", "midi"])

    kind = samples.schema[key].dataType.simpleString()
    return samples.select(key, "seq", "samples").groupBy(key).cogroup(targets.select(key, "idx", "id", "notes").groupBy(key)).applyInPandas(run, f"{key} {kind}, {MESSAGE}")


def follow_stream(samples: DataFrame, targets: dict[str, list[tuple[str, tuple[int, ...]]]], *, key: str = "session", settings: Settings | None = None) -> DataFrame:
    """Streaming form over the same class; the listener's state is one binary value of its session."""
    own = settings or Settings()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        listener = pickle.loads(state.get[0]) if state.exists else Listener([Target(*t) for t in targets.get(k[0], [])], own)
        chunks = pd.concat(list(frames)).sort_values("seq")
        out = [m for x in chunks["samples"] for m in listener.push(np.asarray(x, np.float32))]
        state.update((pickle.dumps(listener),))
        yield pd.DataFrame([{key: k[0], **m} for m in out], columns=[key, "kind", "t", "id", "midi"])

    kind = samples.schema[key].dataType.simpleString()
    return samples.select(key, "seq", "samples").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {MESSAGE}", "listener binary", "append", GroupStateTimeout.NoTimeout)
