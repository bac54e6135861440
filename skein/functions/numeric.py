"""Scalar expressions with the exact rounding and rank rules the operators need."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, scale: int = 1) -> Column:
    """Round half towards plus infinity (-2.5 -> -2), unlike ``round``."""
    return F.floor(c * scale + 0.5) / scale


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def lerp(a: Column, b: Column, f: Column) -> Column:
    return a + (b - a) * f


def midi_to_hz(m: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (m - 69) / 12.0)


def hz_to_midi(hz: Column) -> Column:
    return 69 + 12 * F.log2(hz / 440.0)


def cents(a: Column, b: Column) -> Column:
    """Distance from b to a in hundredths of a semitone."""
    return 1200 * F.log2(a / b)


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of two boxes; 0 when they do not meet."""
    zero = F.lit(0.0)
    both = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx)) * F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    return both / (aw * ah + bw * bh - both)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer luma of video frames: (77R + 150G + 29B) >> 8."""
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)


def luma_page(r: Column, g: Column, b: Column) -> Column:
    """Luma of page images, 0..1: weights 299, 587, 114."""
    return (r * 299 + g * 587 + b * 114) / 255000.0


def even_frames(n: int, k: int) -> list[int]:
    """k evenly spread indices of n, distinct, first and last included."""
    if n <= 0:
        return []
    if k <= 1 or n == 1:
        return [0]
    return sorted({math.floor(i * (n - 1) / (k - 1) + 0.5) for i in range(k)})
