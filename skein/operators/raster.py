"""Dense-array kernels for frames and pages, and the scan of a screen recording into distinct pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Frames of a majority vote, and its share of votes.
VOTES = 7


def ink(rgb: np.ndarray, light: bool = False) -> np.ndarray:
    """Luma (77R + 150G + 29B) >> 8 of [..., 3] bytes; inverted for dark glyphs on light paper."""
    y = (rgb.astype(np.uint32) @ np.array([77, 150, 29], np.uint32)) >> 8
    return (255 - y if light else y).astype(np.uint8)


def half(plane: np.ndarray) -> np.ndarray:
    """2 x 2 maximum; odd edges are dropped."""
    h, w = plane.shape[-2] // 2 * 2, plane.shape[-1] // 2 * 2
    p = plane[..., :h, :w]
    return np.maximum(np.maximum(p[..., ::2, ::2], p[..., 1::2, ::2]), np.maximum(p[..., ::2, 1::2], p[..., 1::2, 1::2]))


def _slide(x: np.ndarray, r: int, how, pad, axis: int) -> np.ndarray:
    width = [(0, 0)] * x.ndim
    width[axis] = (r, r)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, width, constant_values=pad), 2 * r + 1, axis=axis)
    return how(view, axis=-1)


def erode(x: np.ndarray, r: int) -> np.ndarray:
    """Minimum over a square of side 2r + 1; outside the image counts as nothing."""
    return _slide(_slide(x, r, np.min, np.iinfo(x.dtype).max, -1), r, np.min, np.iinfo(x.dtype).max, -2)


def dilate(x: np.ndarray, r: int) -> np.ndarray:
    return _slide(_slide(x, r, np.max, np.iinfo(x.dtype).min, -1), r, np.max, np.iinfo(x.dtype).min, -2)


def top_hat(x: np.ndarray, r: int) -> np.ndarray:
    """The image without its opening: what is thinner than 2r + 1."""
    return x - dilate(erode(x, r), r)


def components8(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels from 1, 0 outside; area by label) of 8-connected parts, numbered in reading order.

    Labels spread as minima along rows, columns and diagonals until they rest.
    """
    h, w = mask.shape
    lab = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0).astype(np.int64)
    big = h * w + 1
    while True:
        p = np.pad(np.where(lab > 0, lab, big), 1, constant_values=big)
        near = np.min([p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        new = np.where(mask, near, 0)
        flat = new.ravel()
        hop = np.where(flat > 0, flat[np.maximum(flat - 1, 0)], 0).reshape(h, w)  # a label's own label
        if np.array_equal(hop, lab):
            break
        lab = hop
    names, dense = np.unique(lab, return_inverse=True)
    dense = dense.reshape(h, w) + (0 if names[0] == 0 else 1)
    return dense, np.bincount(dense.ravel(), minlength=len(names) + (names[0] != 0))[1:]


def remove_small(mask: np.ndarray, least: int) -> np.ndarray:
    """The mask without parts of fewer than ``least`` pixels."""
    lab, area = components8(mask)
    return mask & (np.append(0, area) >= least)[lab]


def majority(masks: np.ndarray, votes: int = VOTES) -> np.ndarray:
    """Centred majority over time; the first and last frame are repeated outwards."""
    r = votes // 2
    padded = np.concatenate([np.repeat(masks[:1], r, 0), masks, np.repeat(masks[-1:], r, 0)])
    total = np.cumsum(np.concatenate([np.zeros((1, *masks.shape[1:]), np.int32), padded.astype(np.int32)]), axis=0)
    return total[votes:] - total[:-votes] > r


def differ(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(pixels of either mask that the other has not within 1 px, their most in a 2 x 2 block of 16-px cells, the larger ink)."""
    da, db = dilate(a.astype(np.uint8), 1) > 0, dilate(b.astype(np.uint8), 1) > 0
    odd = (a & ~db) | (b & ~da)
    cell = 16
    h, w = -(-odd.shape[0] // cell), -(-odd.shape[1] // cell)
    grid = np.zeros((h + 1, w + 1), int)
    ys, xs = np.nonzero(odd)
    np.add.at(grid, (ys // cell, xs // cell), 1)
    block = grid[:-1, :-1] + grid[1:, :-1] + grid[:-1, 1:] + grid[1:, 1:]
    return int(odd.sum()), int(block.max(initial=0)), int(max(a.sum(), b.sum()))


def same_screen(a: np.ndarray, b: np.ndarray, ratio: float = 0.12, local: int = 40) -> bool:
    n, block, size = differ(a, b)
    return n <= ratio * max(1, size) and block <= local


def scan(planes: np.ndarray, fps: float, *, tau: int = 96, least_s: float = 1.0, fps_ratio: float = 0.12) -> list[dict]:
    """Distinct pages of a recording (ink planes [t, y, x]): start, end, further starts, frames.

    Masks of bright ink vote over time; stretches without change are runs; neighbouring runs that look
    alike merge, and a run that looks like an earlier page is a repeat of it.  Runs without ink, or
    with far less than most, are no pages.
    """
    if not len(planes):
        return []
    masks = majority(planes > tau)
    still = np.array([same_screen(a, b, fps_ratio) for a, b in zip(masks, masks[1:], strict=False)], bool)
    runs, start = [], 0
    for i in range(len(masks)):
        if i == len(masks) - 1 or not still[i]:
            if i - start + 1 >= max(3, least_s * fps):
                runs.append([start, i, masks[start : i + 1].mean(axis=0) > 0.5])
            start = i + 1
    runs = [r for r in runs if r[2].any()]
    if runs:
        amount = sorted(int(r[2].sum()) for r in runs)
        runs = [r for r in runs if r[2].sum() >= 0.15 * amount[round(0.75 * (len(amount) - 1))]]
    pages: list[dict] = []
    last = None
    for a, b, mask in runs:
        if last is not None and same_screen(last["mask"], mask):
            last["end"], home = (b + 1) / fps, last
        elif home := next((p for p in pages if same_screen(p["mask"], mask)), None):
            home["also"].append(a / fps)
        else:
            home = {"start": a / fps, "end": (b + 1) / fps, "also": [], "mask": mask, "frames": []}
            pages.append(home)
        home["frames"] += range(a, b + 1)
        last = home
    return pages


def scan_videos(frames: DataFrame, *, key: str = "video_id", fps: float = 4.0) -> DataFrame:
    """(key, page, t_start, t_end, also_at, n_frames) from frames (key, t, w, h, px): px is w * h bytes of ink."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        w, h = int(pdf["w"].iloc[0]), int(pdf["h"].iloc[0])
        pages = scan(np.array([np.frombuffer(x, np.uint8).reshape(h, w) for x in pdf["px"]]), fps)
        rows = [(pdf[key].iloc[0], i, p["start"], p["end"], p["also"], len(p["frames"])) for i, p in enumerate(pages)]
        return pd.DataFrame(rows, columns=[key, "page", "t_start", "t_end", "also_at", "n_frames"])

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, "t", "w", "h", "px").groupBy(key).applyInPandas(run, f"{key} {kind}, page int, t_start double, t_end double, also_at array<double>, n_frames int")


def composite(samples: np.ndarray, rank: float = 0.65, share: float = 0.6, gate: int = 96) -> np.ndarray:
    """Each pixel's value at a rank of its samples, where enough samples pass the gate."""
    k = len(samples)
    value = np.sort(samples, axis=0)[int(np.floor(rank * (k - 1)))]
    return np.where((samples > gate).sum(axis=0) >= np.ceil(share * k), value, 0).astype(np.uint8)
