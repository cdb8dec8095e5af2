"""Lanczos kernels: the tap table of 2:1 reduction, a numpy reduction of pixel buffers, and numpy sampling at any place."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

LOBES = 3
#: Added before flooring, so that exact halves round up whatever the order of summation.
HALF_UP = 0.500001


def lanczos(t):
    """sinc(t) sinc(t / 3) inside three lobes, else 0 (Duchon 1979)."""
    t = np.asarray(t, float)
    return np.where(np.abs(t) < LOBES, np.sinc(t) * np.sinc(t / LOBES), 0.0)


def taps() -> list[tuple[int, float]]:
    """(offset, weight) of 2:1 reduction: output i draws on inputs 2 i + 1 + offset; the weights add up to 1."""
    w = lanczos((np.arange(-6, 6) + 0.5) / 2)
    return [(o, float(round(x, 9))) for o, x in zip(range(-6, 6), w / w.sum(), strict=True)]


@lru_cache(maxsize=16)
def _spans(size: int) -> tuple[list[tuple[float, slice, slice]], np.ndarray]:
    """For each tap of a reduction of `size` to its half: weight, outputs that have it, their inputs; and the weights' sum by output."""
    n, spans = size // 2, []
    weight = np.zeros(n)
    for o, w in taps():
        first, end = max(0, -o // 2), min(n, (size - o) // 2)
        if first < end:
            spans.append((w, slice(first, end), slice(2 * first + 1 + o, 2 * end + o, 2)))
            weight[first:end] += w
    return spans, weight


def _halved(a: np.ndarray) -> np.ndarray:
    """The first axis reduced 2:1; taps outside are dropped and the rest renormalised."""
    spans, weight = _spans(a.shape[0])
    total = np.zeros((weight.size, *a.shape[1:]))
    for w, outputs, inputs in spans:
        total[outputs] += w * a[inputs]
    return total / weight.reshape(-1, *[1] * (a.ndim - 1))


def halve(canvas: np.ndarray) -> np.ndarray:
    """A (2h, 2w, bands) byte canvas to (h, w, bands): vertical pass, horizontal pass, clamp, round half up."""
    out = _halved(_halved(canvas.astype(float)).swapaxes(0, 1)).swapaxes(0, 1)
    return np.floor(np.clip(out, 0, 255) + HALF_UP).astype(np.uint8)


def sample(source: np.ndarray, col: np.ndarray, row: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Lanczos samples of a (h, w, bands) array at fractional pixel-centre places; scale over 1 widens the kernel for reduction.

    Returns the samples as bytes and whether each place lies on the raster. Taps outside are dropped, the rest renormalised.
    """
    h, w, bands = source.shape
    scale = max(1.0, scale)
    inside = (col >= 0) & (col < w) & (row >= 0) & (row < h)
    if inside.any() and (col == col[:1]).all() and (row == row[:, :1]).all():
        return _by_axes(source, np.where(inside.any(0), col[0], -1.0), np.where(inside.any(1), row[:, 0], -1.0), scale), inside
    flat_c, flat_r = np.where(inside, col, 0).ravel() - 0.5, np.where(inside, row, 0).ravel() - 0.5
    reach = math.ceil(LOBES * scale)
    total, weight = np.zeros((flat_c.size, bands)), np.zeros(flat_c.size)
    base_c, base_r = np.floor(flat_c).astype(int), np.floor(flat_r).astype(int)
    # the kernel is a product of both axes: each axis' weights are found once
    shifts = range(1 - reach, reach + 1)
    across = [(np.clip(c, 0, w - 1), np.where((c >= 0) & (c < w), lanczos((c - flat_c) / scale), 0.0)) for c in (base_c + d for d in shifts)]
    for r in (base_r + d for d in shifts):
        wr = np.where((r >= 0) & (r < h), lanczos((r - flat_r) / scale), 0.0)
        line = np.clip(r, 0, h - 1)
        for c, wc in across:
            k = wr * wc
            total += k[:, None] * source[line, c]
            weight += k
    out = np.floor(np.clip(total / np.where(weight == 0, 1, weight)[:, None], 0, 255) + HALF_UP).astype(np.uint8)
    return out.reshape(*col.shape, bands), inside


def _axis(at: np.ndarray, size: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Source places, cut to the source, and weights, a row a tap, of places along an axis; those off the source stand on the first one on it."""
    at = np.where(at >= 0, at, at[at >= 0][0]) - 0.5
    reach = math.ceil(LOBES * scale)
    places = np.floor(at).astype(int) + np.arange(1 - reach, reach + 1)[:, None]
    return np.clip(places, 0, size - 1), np.where((places >= 0) & (places < size), lanczos((places - at) / scale), 0.0)


def _by_axes(source: np.ndarray, col: np.ndarray, row: np.ndarray, scale: float) -> np.ndarray:
    """sample() where columns depend on x and rows on y only (negative: off the source): one axis after the other."""
    (columns, wc), (rows, wr) = _axis(col, source.shape[1], scale), _axis(row, source.shape[0], scale)
    low, high = rows.min(), rows.max() + 1
    part = source[low:high]
    across = np.zeros((high - low, col.size, source.shape[2]))
    for c, w in zip(columns, wc, strict=True):
        across += w[:, None] * part[:, c]
    total = np.zeros((row.size, col.size, source.shape[2]))
    for r, w in zip(rows, wr, strict=True):
        total += w[:, None, None] * across[r - low]
    weight = wr.sum(0)[:, None] * wc.sum(0)
    return np.floor(np.clip(total / np.where(weight == 0, 1, weight)[:, :, None], 0, 255) + HALF_UP).astype(np.uint8)
