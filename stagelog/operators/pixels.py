"""Per-tile pixel steps used inside the image jobs (H6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame


def as_array(body: bytes, w: int, h: int) -> np.ndarray:
    """A tile body as an array: one byte or one float32 per pixel."""
    kind = np.uint8 if len(body) == w * h else np.float32
    return np.frombuffer(body, kind).reshape(h, w)


def _like(result: np.ndarray, image: np.ndarray) -> np.ndarray:
    if image.dtype == np.uint8:
        return np.clip(np.rint(result), 0, 255).astype(np.uint8)
    return result.astype(np.float32)


def _filter(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    padded = np.pad(image.astype(float), ((ry, ry), (rx, rx)), mode="reflect")
    out = np.zeros(image.shape)
    for y, x in np.argwhere(kernel != 0):
        out += kernel[y, x] * padded[y: y + image.shape[0], x: x + image.shape[1]]
    return out


def median(image: np.ndarray, k: int) -> np.ndarray:
    if k <= 1:
        return image
    r = k // 2
    view = sliding_window_view(np.pad(image, r, mode="edge"), (k, k))
    rows = [np.median(view[y].reshape(view.shape[1], -1), axis=1) for y in range(view.shape[0])]
    return np.array(rows).astype(image.dtype)


def gaussian5(image: np.ndarray) -> np.ndarray:
    line = np.array([1, 4, 6, 4, 1]) / 16.0
    return _like(_filter(image, np.outer(line, line)), image)


def sobel(image: np.ndarray) -> np.ndarray:
    kx = np.outer([1, 2, 1], [-1, 0, 1]).astype(float)
    gx, gy = (np.minimum(np.abs(_filter(image, k)), 255) for k in (kx, kx.T))
    return np.rint((np.rint(gx) + np.rint(gy)) / 2).astype(np.uint8)


def tukey(n: int, alpha: float) -> np.ndarray:
    if alpha <= 0 or n == 1:
        return np.ones(n)
    t = np.arange(n) / (n - 1)
    edge = np.minimum(t, 1 - t)
    alpha = min(alpha, 1.0)
    return np.where(edge < alpha / 2, 0.5 * (1 - np.cos(2 * np.pi * edge / alpha)), 1.0)


def blackman(image: np.ndarray, k: int) -> np.ndarray:
    line = np.blackman(k)
    kernel = np.outer(line, line)
    return _like(_filter(image, kernel / kernel.sum()), image)


def apply_step(image: np.ndarray, step: dict) -> np.ndarray:
    options = {k: v for k, v in step.items() if k != "op"}
    op, (h, w) = step["op"], image.shape
    if op == "median":
        return median(image, **options)
    if op == "gaussian":
        return gaussian5(image)
    if op == "sobel":
        return sobel(image)
    if op == "blackman":
        return blackman(image, **options)
    if op == "tukey":
        return (image * np.outer(tukey(h, options["alpha"]), tukey(w, options["alpha"]))).astype(np.float32)
    if op == "normalize":
        return (image / 255.0).astype(np.float32)
    raise ValueError(f"unknown preprocessing step {op!r}")


def preprocess_tiles(tiles: DataFrame, chain: list[dict]) -> DataFrame:
    """H6: apply the steps to every tile once; bodies stay bytes or become float32."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bodies = []
            for body, w, h in zip(frame["pixels"], frame["w"], frame["h"]):
                image = as_array(body, int(w), int(h))
                for step in chain:
                    image = apply_step(image, step)
                bodies.append(np.ascontiguousarray(image).tobytes())
            yield frame.assign(pixels=bodies)

    return tiles.mapInPandas(run, tiles.schema)
