"""Deterministic test inputs: screen recordings as frames, plucked strings as samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def lcg(seed: int, n: int) -> np.ndarray:
    """Numerical Recipes' generator: seed * 1664525 + 1013904223 mod 2^32, as fractions."""
    out = np.empty(n)
    for i in range(n):
        seed = (seed * 1664525 + 1013904223) % (1 << 32)
        out[i] = seed / (1 << 32)
    return out


def screen(seed: int, w: int = 320, h: int = 120) -> np.ndarray:
    """An ink plane: six staff lines and sixteen marks at places drawn from the seed."""
    plane = np.full((h, w), 20, np.uint8)
    for y in range(30, 91, 12):
        plane[y : y + 2, 20:300] = 80
    draw = lcg(seed, 32)
    for a, b in zip(draw[::2], draw[1::2], strict=True):
        x, y = int(24 + a * 260), int(24 + b * 60)
        plane[y : y + 9, x : x + 5] = 230
    return plane


def recording(seeds: list[int], frames_each: int = 16) -> np.ndarray:
    """Screens shown one after another, with a cursor that moves 3 px a frame."""
    out = []
    for seed in seeds:
        base = screen(seed)
        for _ in range(frames_each):
            frame = base.copy()
            x = (3 * len(out)) % (base.shape[1] - 4)
            frame[26:96, x : x + 2] = 200
            out.append(frame)
    return np.array(out)


def frame_table(spark: SparkSession, videos: dict[str, np.ndarray]) -> DataFrame:
    rows = [(k, t, f.shape[1], f.shape[0], bytearray(f.tobytes())) for k, frames in videos.items() for t, f in enumerate(frames)]
    return spark.createDataFrame(rows, "video_id string, t int, w int, h int, px binary")


def pluck(midi: float, seconds: float, rate: int = 48000) -> np.ndarray:
    """A plucked string: 14 stretched partials, each decaying by its number."""
    t = np.arange(int(seconds * rate)) / rate
    f0 = 440 * 2 ** ((midi - 69) / 12)
    out = np.zeros(len(t))
    for k in range(1, 15):
        amp = 0.2 / k * (0.2 if k % 7 == 0 else 1)
        out += amp * np.exp(-t / (1.5 / (1 + 0.25 * k))) * np.sin(2 * np.pi * k * f0 * np.sqrt(1 + 5e-5 * k * k) * t)
    return out.astype(np.float32)


#: Digits as rows of five dots.
DIGITS = {
    "0": (14, 17, 17, 17, 17, 17, 14), "1": (4, 12, 4, 4, 4, 4, 14), "2": (14, 17, 1, 2, 4, 8, 31), "3": (14, 17, 1, 6, 1, 17, 14), "4": (2, 6, 10, 18, 31, 2, 2),
    "5": (31, 16, 30, 1, 1, 17, 14), "6": (14, 16, 16, 30, 17, 17, 14), "7": (31, 1, 2, 4, 4, 4, 4), "8": (14, 17, 17, 14, 17, 17, 14), "9": (14, 17, 17, 15, 1, 1, 14),
}


def digit(name: str, scale: int = 2) -> np.ndarray:
    """A digit's mask, cut to its ink."""
    dots = np.array([[row >> (4 - i) & 1 for i in range(5)] for row in DIGITS[name]], bool)
    dots = dots[:, dots.any(axis=0)]
    return np.kron(dots, np.ones((scale, scale), bool))


def tab_page(events: list, spacing: int = 20, scale: int = 2) -> np.ndarray:
    """An ink plane of one system: each event is ``"|"`` or a dict of string to fret."""
    step = 50
    h, w = 40 + 5 * spacing + 40, 60 + step * len(events)
    plane = np.zeros((h, w), np.uint8)
    for s in range(6):
        plane[40 + s * spacing, 20 : w - 20] = 120
    for i, e in enumerate(events):
        x = 45 + step * i
        if e == "|":
            plane[40 : 41 + 5 * spacing, x] = 120
            continue
        for string, fret in e.items():
            at = x
            for c in str(fret):
                mask = digit(c, scale)
                y = 40 + (string - 1) * spacing - mask.shape[0] // 2
                plane[y - 1 : y + mask.shape[0] + 1, at - 1 : at + mask.shape[1] + 1] = 0  # paper around a glyph
                plane[y : y + mask.shape[0], at : at + mask.shape[1]][mask] = 230
                at += mask.shape[1] + 2
    return plane
