"""Signal kernels in numpy: windows, flux, pitch, sparse non-negative fits."""

from __future__ import annotations

import numpy as np


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def spectrum(frame: np.ndarray) -> np.ndarray:
    """Magnitudes of a Hann-windowed frame."""
    return np.abs(np.fft.rfft(frame * hann(len(frame)))) * 2 / len(frame)


def level(frame: np.ndarray) -> tuple[float, float, int]:
    """(root mean square, peak, clipped samples)"""
    if not len(frame):
        return 0.0, 0.0, 0
    return float(np.sqrt(np.mean(frame.astype(float) ** 2))), float(np.abs(frame).max()), int((np.abs(frame) >= 0.999).sum())


def semitone_bands(n: int, rate: int, low: int = 36, high: int = 100) -> np.ndarray:
    """Matrix [bands, bins] that sums a magnitude spectrum of a frame of n into semitones."""
    hz = np.arange(n // 2 + 1) * rate / n
    with np.errstate(divide="ignore"):
        midi = 69 + 12 * np.log2(np.maximum(hz, 1e-9) / 440)
    return (np.abs(midi[None, :] - np.arange(low, high + 1)[:, None]) <= 0.5).astype(float)


def flux(before: np.ndarray, now: np.ndarray) -> float:
    """Rise of log band levels over the strongest of each band and its neighbours before."""
    old = np.log1p(1000 * before)
    padded = np.pad(old, 1, mode="edge")
    near = np.maximum(np.maximum(padded[:-2], padded[2:]), old)
    return float(np.maximum(np.log1p(1000 * now) - near, 0).sum())


def pitch(frame: np.ndarray, rate: int, low: float = 60.0, high: float = 1400.0, share: float = 0.9) -> tuple[float, float]:
    """(hertz, clarity) by the normalised square difference: the first key maximum near the highest; (0, 0) if none."""
    x = frame.astype(float)
    n = len(x)
    spec = np.fft.rfft(x, 2 * n)
    r = np.fft.irfft(spec * np.conj(spec))[:n]
    energy = np.cumsum(x**2)
    m = energy[-1] - np.append(0, energy[:-1]) + energy[::-1]
    nsdf = 2 * r / np.maximum(m, 1e-12)
    lo, hi = max(2, int(rate / high)), min(n - 2, int(rate / low))
    peaks = [k for k in range(lo, hi) if nsdf[k] > 0 and nsdf[k] >= nsdf[k - 1] and nsdf[k] > nsdf[k + 1]]
    if not peaks:
        return 0.0, 0.0
    best = max(nsdf[k] for k in peaks)
    k = next(k for k in peaks if nsdf[k] >= share * best)
    a, b, c = nsdf[k - 1 : k + 2]
    bend = a - 2 * b + c
    return rate / (k + (0.5 * (a - c) / bend if bend else 0.0)), float(nsdf[k])


def nnls(a: np.ndarray, y: np.ndarray, l1: float = 0.0, rounds: int = 60) -> np.ndarray:
    """argmin |a x - y|^2 / 2 + l1 |x|_1 over x >= 0, by coordinate descent."""
    gram, ay = a.T @ a, a.T @ y - l1
    x = np.zeros(a.shape[1])
    g = -ay.copy()
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(x)):
            if gram[j, j] <= 0:
                continue
            new = max(0.0, x[j] - g[j] / gram[j, j])
            if new != x[j]:
                g += gram[:, j] * (new - x[j])
                moved = max(moved, abs(new - x[j]))
                x[j] = new
        if moved < 1e-9:
            break
    return x


def note_template(midi: float, hz: np.ndarray, partials: int = 10, cents: float = 35.0) -> np.ndarray:
    """Unit-norm magnitudes that a plucked note leaves at the frequencies."""
    f0 = 440 * 2 ** ((midi - 69) / 12)
    out = np.zeros(len(hz))
    for k in range(1, partials + 1):
        f = k * f0 * np.sqrt(1 + 5e-5 * k * k)
        width = max(f * (2 ** (cents / 1200) - 1), (hz[1] - hz[0]) * 1.2)
        out += np.exp(-0.5 * ((hz - f) / width) ** 2) / k**0.6
    return out / max(np.linalg.norm(out), 1e-12)
