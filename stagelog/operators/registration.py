"""Pairwise image registration (H4, H5, H7).

One row is one pair with both bodies.  Every method returns the same quantity:
``(dx, dy) = position(new) - position(ref)`` in pixels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stagelog.operators.pixels import as_array


@dataclass(frozen=True)
class CircularParams:
    """H5 parameters; ``ignore`` is (x, y, w, h)."""

    search_x: int = 4
    search_y: int = 4
    ignore: tuple[int, int, int, int] | None = None


def _fast_len(n: int) -> int:
    return 1 << (n - 1).bit_length()


def slide(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sum of image × kernel at every position where the kernel fits."""
    shape = [_fast_len(a) for a in image.shape]
    spectrum = np.fft.rfft2(image, shape) * np.conj(np.fft.rfft2(kernel, shape))
    full = np.fft.irfft2(spectrum, shape)
    return full[: image.shape[0] - kernel.shape[0] + 1, : image.shape[1] - kernel.shape[1] + 1]


def window_sums(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sum over every h × w window, from an integral image."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    return total[h:, w:] - total[:-h, w:] - total[h:, :-w] + total[:-h, :-w]


def zero_mean_ncc(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Zero-mean normalised correlation (Lewis 1995); 0 where either side is flat."""
    image, template = image.astype(float), template.astype(float)
    image = image - image.mean()
    h, w = template.shape
    centred = template - template.mean()
    energy = float((centred * centred).sum())
    s1, s2 = window_sums(image, h, w), window_sums(image * image, h, w)
    spread = np.maximum(s2 - s1 * s1 / (h * w), 0.0)
    scale = np.sqrt(spread * energy)
    flat = scale <= 1e-9 * max(float(scale.max()), 1.0)
    return np.where(flat, 0.0, np.clip(slide(image, centred) / np.where(flat, 1.0, scale), -1.0, 1.0))


def _peak(surface: np.ndarray) -> tuple[int, int]:
    y, x = np.unravel_index(int(np.argmax(surface)), surface.shape)
    return int(y), int(x)


def phase_surface(ref: np.ndarray, new: np.ndarray) -> np.ndarray:
    """H7: centred phase-correlation surface (Kuglin and Hines 1975)."""
    cross = np.fft.fft2(new.astype(float)) * np.conj(np.fft.fft2(ref.astype(float)))
    size = np.abs(cross)
    return np.fft.fftshift(np.fft.ifft2(cross / np.where(size == 0, 1e-9, size)).real)


def register_phase(surface: np.ndarray) -> dict:
    """H4: shift from the weighted centre of the 5 × 5 cells around the peak; their sum is the response."""
    h, w = surface.shape
    y, x = _peak(surface)
    ys, xs = (np.arange(max(0, c - 2), min(n, c + 3)) for c, n in ((y, h), (x, w)))
    box = surface[np.ix_(ys, xs)]
    total = float(box.sum())
    cx, cy = ((box.sum(0) @ xs) / total, (box.sum(1) @ ys) / total) if total else (x, y)
    return dict(dx=float(w // 2 - cx), dy=float(h // 2 - cy), score=total)


def register_circular(ref: np.ndarray, new: np.ndarray, p: CircularParams) -> dict:
    """H5: best correlation over all circular shifts in range; the first best wins."""
    a, b = ref.astype(float).copy(), new.astype(float).copy()
    if p.ignore:
        x, y, w, h = p.ignore
        for image in (a, b):
            image[y: y + h + 1, x: x + w + 1] = 0
    spread = a.std() * b.std() * a.size
    if spread == 0:
        return dict(dx=0.0, dy=0.0, score=-1.0)
    a, b = a - a.mean(), b - b.mean()
    full = np.fft.ifft2(np.fft.fft2(a) * np.conj(np.fft.fft2(b))).real / spread
    ys, xs = np.arange(-p.search_y, p.search_y + 1), np.arange(-p.search_x, p.search_x + 1)
    near = np.round(full[np.ix_(ys % a.shape[0], xs % a.shape[1])], 10)
    y, x = _peak(near)
    return dict(dx=float(xs[x]), dy=float(ys[y]), score=float(near[y, x]))


def register_pairs(
    pairs: DataFrame, tiles: DataFrame, method: str = "phase", params=None, keep_surface: bool = False,
) -> DataFrame:
    """H4/H5: measured shifts for pairs (run_id, i, j, dx, dy) with expected shifts.

    Each body meets its pairs in two joins; the pair rows are spread by pair, so
    a tile with many pairs is no one task's work.  A pair of unequal
    shapes gives no row.
    """
    defaults = {"phase": dict, "circular": CircularParams}
    if method not in defaults:
        raise ValueError(f"unknown method {method!r}")
    params = params if params is not None else defaults[method]()
    body = {e: tiles.select("run_id", F.col("tile_id").alias(e), F.struct("w", "h", "pixels").alias(f"t{e}")) for e in "ij"}
    rows = (
        pairs.select("run_id", "i", "j", F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy"))
        .join(body["i"], ["run_id", "i"]).join(body["j"], ["run_id", "j"])
        .select("run_id", "i", "j", "dx", "dy", F.col("ti.w").alias("wi"), F.col("ti.h").alias("hi"),
                F.col("ti.pixels").alias("pi"), F.col("tj.w").alias("wj"), F.col("tj.h").alias("hj"),
                F.col("tj.pixels").alias("pj")))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                ref, new = as_array(r.pi, r.wi, r.hi), as_array(r.pj, r.wj, r.hj)
                surface = None
                if ref.shape != new.shape:
                    got = None
                elif method == "circular":
                    got = register_circular(ref, new, params)
                else:
                    surface = phase_surface(ref, new)
                    got = register_phase(surface)
                if got is not None:
                    out.append((r.run_id, r.i, r.j, got["dx"], got["dy"], got["score"],
                                surface.ravel().astype(np.float32).tolist() if keep_surface and surface is not None else None))
            yield pd.DataFrame(out, columns=[
                "run_id", "i", "j", "dx", "dy", "score", "surface"])

    found = rows.mapInPandas(measure, (
        "run_id string, i bigint, j bigint, dx double, dy double, score double, "
        "surface array<float>"))
    keep = ["run_id", "i", "j", "dx", "dy", "score"]
    return found.select(*keep, "surface") if keep_surface else found.select(*keep)
