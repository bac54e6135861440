"""Reading a page of tablature: staff lines, glyphs, digits, notes, chords, bar lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from skein.operators.raster import components8

#: Height and width of a described glyph.
CROP = (24, 16)


@dataclass
class Staff:
    """Six evenly spaced lines (rows), their distance and extent."""

    lines: np.ndarray
    spacing: float
    x0: int
    x1: int


@dataclass
class Glyph:
    string: int
    x0: int
    x1: int
    y0: int
    y1: int
    crop: np.ndarray
    label: str = ""
    conf: float = 0.0


def islands(marked: np.ndarray, gap: int = 0) -> list[tuple[int, int]]:
    """(first, last) of runs of marked places; gaps of up to ``gap`` are bridged."""
    at = np.flatnonzero(marked)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > gap + 1)
    return list(zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True))


def find_staves(inked: np.ndarray, share: float = 0.5, strings: int = 6) -> list[Staff]:
    """Groups of evenly spaced long rows, top to bottom; the most even group wins where groups overlap."""
    cover = inked.mean(axis=1)
    rows = [(a + b) / 2 for a, b in islands(cover >= share * max(cover.max(initial=0), 1e-9)) if b - a < 6]
    found = []
    for i in range(len(rows) - strings + 1):
        own = np.array(rows[i : i + strings])
        gaps = np.diff(own)
        spacing = float(np.median(gaps))
        uneven = float(np.abs(gaps - spacing).max() / spacing)
        if uneven <= 0.2:
            found.append((uneven, i, own, spacing))
    out, taken = [], set()
    for _, i, own, spacing in sorted(found, key=lambda f: (f[0], f[1])):
        if not taken & set(range(i, i + strings)):
            taken |= set(range(i, i + strings))
            columns = np.flatnonzero(inked[np.round(own).astype(int)].mean(axis=0) >= 0.5)
            out.append(Staff(own, spacing, int(columns.min()), int(columns.max())))
    return sorted(out, key=lambda s: s.lines[0])


def without_lines(inked: np.ndarray, staff: Staff) -> np.ndarray:
    """The mask without staff lines: long runs of their rows, except where a stroke crosses them."""
    out = inked.copy()
    for y in np.round(staff.lines).astype(int):
        lo, hi = y, y
        while lo > 0 and inked[lo - 1].mean() > 0.4:
            lo -= 1
        while hi < len(inked) - 1 and inked[hi + 1].mean() > 0.4:
            hi += 1
        above = inked[lo - 1] if lo else np.zeros(inked.shape[1], bool)
        below = inked[hi + 1] if hi + 1 < len(inked) else np.zeros(inked.shape[1], bool)
        for row in range(lo, hi + 1):
            for a, b in islands(inked[row]):
                if b - a + 1 >= 1.2 * staff.spacing:
                    out[row, a : b + 1] &= (above & below)[a : b + 1]
    return out


def describe(mask: np.ndarray) -> np.ndarray:
    """A glyph's crop at CROP size, zero mean and unit norm, so that a dot product is a correlation."""
    h, w = mask.shape
    ys = np.minimum((np.arange(CROP[0]) + 0.5) * h / CROP[0], h - 1).astype(int)
    xs = np.minimum((np.arange(CROP[1]) + 0.5) * w / CROP[1], w - 1).astype(int)
    v = mask[np.ix_(ys, xs)].astype(float).ravel()
    v = np.append(v - v.mean(), (w / h - 0.6) * 4)  # its shape tells a 1 from a bar
    return v / max(np.linalg.norm(v), 1e-9)


def cut_glyphs(inked: np.ndarray, staff: Staff) -> tuple[list[Glyph], list[int]]:
    """(glyphs at strings in order of x, columns of bar lines)."""
    pad = int(staff.spacing / 2)
    top, bottom = max(0, int(staff.lines[0]) - pad), min(len(inked), int(staff.lines[-1]) + pad + 1)
    area = without_lines(inked, staff)[top:bottom]
    lab, _ = components8(area)
    bars = islands(inked[int(staff.lines[0]) : int(staff.lines[-1]) + 1].mean(axis=0) > 0.9)
    bar_columns = [(a + b) // 2 for a, b in bars if b - a < staff.spacing * 0.4]
    out = []
    for k in range(1, int(lab.max(initial=0)) + 1):
        ys, xs = np.nonzero(lab == k)
        h, w = ys.max() - ys.min() + 1, xs.max() - xs.min() + 1
        if h < 0.35 * staff.spacing or h > 1.6 * staff.spacing or w > 2 * staff.spacing or any(abs((xs.min() + xs.max()) / 2 - b) <= 2 for b in bar_columns):
            continue
        centre = (ys.min() + ys.max()) / 2 + top
        string = int(np.argmin(np.abs(staff.lines - centre))) + 1
        crop = describe((lab == k)[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1])
        out.append(Glyph(string, int(xs.min()), int(xs.max()), int(ys.min() + top), int(ys.max() + top), crop))
    return sorted(out, key=lambda g: (g.x0, g.string)), bar_columns


def by_templates(templates: dict[str, np.ndarray]) -> Callable[[Glyph], tuple[str, float]]:
    """A classifier by correlation with described templates."""
    names = sorted(templates)
    stack = np.array([templates[n] for n in names])

    def run(glyph: Glyph) -> tuple[str, float]:
        score = stack @ glyph.crop
        return names[int(score.argmax())], float(score.max())

    return run


def assemble(glyphs: list[Glyph], bars: list[int], spacing: float) -> list[dict]:
    """Events in order of x: digits side by side on a string are one fret, notes at one x one chord."""
    notes: list[list] = []
    for string in sorted({g.string for g in glyphs}):
        last = None
        for g in (g for g in glyphs if g.string == string):
            if last is not None and g.label.isdigit() and last[4].isdigit() and g.x0 - last[2] <= 0.35 * spacing and int(last[4] + g.label) <= 24 and len(last[4]) < 2:
                last[2], last[4], last[5] = g.x1, last[4] + g.label, min(last[5], g.conf)
            else:
                last = [string, g.x0, g.x1, (g.x0 + g.x1) / 2, g.label, g.conf]
                notes.append(last)
    events: list[dict] = []
    for string, x0, x1, _, label, conf in sorted(notes, key=lambda n: ((n[1] + n[2]) / 2, n[0])):
        centre = (x0 + x1) / 2
        e = events[-1] if events else None
        if e and string not in {n["string"] for n in e["notes"]} and (abs(centre - e["xc"]) <= 0.35 * spacing or abs(x0 - e["x0"]) <= 0.25 * spacing or min(x1, e["x1"]) - max(x0, e["x0"]) >= 0.25 * (x1 - x0 + 1)):
            e["x0"], e["x1"] = min(e["x0"], x0), max(e["x1"], x1)
        else:
            e = {"x0": x0, "x1": x1, "xc": centre, "notes": []}
            events.append(e)
        e["xc"] = (e["x0"] + e["x1"]) / 2
        e["notes"].append({"string": string, "fret": int(label) if label.isdigit() else None, "conf": conf})
    before = -1.0
    for e in events:
        e["bar_before"] = any(before < b <= e["xc"] for b in bars)
        before = e["xc"]
        e["notes"].sort(key=lambda n: n["string"])
    return events


def read_page(plane: np.ndarray, classify: Callable[[Glyph], tuple[str, float]], tau: int = 40) -> list[dict]:
    """Systems of a page (ink plane): {lines, spacing, events}; no staff, no systems."""
    inked = plane > tau
    out = []
    for staff in find_staves(inked):
        glyphs, bars = cut_glyphs(inked, staff)
        for g in glyphs:
            g.label, g.conf = classify(g)
        out.append({"lines": staff.lines.tolist(), "spacing": staff.spacing, "events": assemble(glyphs, bars, staff.spacing)})
    return out


def read_pages(pages: DataFrame, classify: Callable[[Glyph], tuple[str, float]], *, key: str = "page_id") -> DataFrame:
    """(key, system, event, string, fret, bar_before, conf): one row for each note; pages (key, w, h, px)."""

    def run(frames):
        for pdf in frames:
            rows = []
            for k, w, h, px in zip(pdf[key], pdf["w"], pdf["h"], pdf["px"], strict=True):
                for s, system in enumerate(read_page(np.frombuffer(px, np.uint8).reshape(h, w), classify)):
                    rows += [(k, s, i, n["string"], n["fret"], e["bar_before"], n["conf"]) for i, e in enumerate(system["events"]) for n in e["notes"]]
            out = pd.DataFrame(rows, columns=[key, "system", "event", "string", "fret", "bar_before", "conf"])
            out["fret"] = out["fret"].astype("Int64")
            yield out

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "w", "h", "px").mapInPandas(run, f"{key} {kind}, system int, event int, string int, fret int, bar_before boolean, conf double")
