"""Image tiles as rows (A6): raw or uncompressed 8-bit bodies become row-major grey bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from stagelog.functions.units import filename
from stagelog.operators.ordered import rank_by
from stagelog.schema import CROP_BOTTOM_PX

# Grey weights of red, green, blue (ITU-R BT.601).
_GREY = np.array([0.299, 0.587, 0.114])


def decode_bmp(body: bytes) -> np.ndarray | None:
    """Grey pixels of an uncompressed 8-, 24- or 32-bit bitmap, or None."""
    if len(body) < 54 or body[:2] != b"BM":
        return None
    start, head, width, height = struct.unpack_from("<IIii", body, 10)
    bits, packing = struct.unpack_from("<HI", body, 28)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        return None
    rows, stride = abs(height), (width * bits // 8 + 3) // 4 * 4
    if len(body) < start + rows * stride:
        return None
    data = np.frombuffer(body, np.uint8, rows * stride, start).reshape(rows, stride)[:, : width * bits // 8]
    data = data if height < 0 else data[::-1]
    if bits == 8:
        count = struct.unpack_from("<I", body, 46)[0] or 256
        table = np.frombuffer(body, np.uint8, count * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        grey = np.zeros(256, np.uint8)
        grey[:count] = np.rint(table @ _GREY)
        return grey[data]
    colour = data.reshape(rows, width, bits // 8)[:, :, 2::-1]
    return np.rint(colour @ _GREY).astype(np.uint8)


def read_tiles(
    spark: SparkSession, path: str, crop_bottom: int = CROP_BOTTOM_PX, glob: str = "*.{bmp,raw}",
    raw_width: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Tiles sorted by name per run (the folder), and the files that could not be read.

    ``raw_width`` gives the row length of ``.raw`` bodies.  The bottom rows hold
    an overlay and are cropped; an image not taller than that is unreadable.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .load(path).select(
            F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("run_id"),
            filename(F.col("path")).alias("filename"), "content"))

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for run, name, body in frame.itertuples(index=False):
                if name.lower().endswith(".raw"):
                    fits = raw_width and len(body) % raw_width == 0
                    image = np.frombuffer(body, np.uint8).reshape(-1, raw_width) if fits else None
                else:
                    image = decode_bmp(body)
                if image is not None and crop_bottom > 0:
                    image = image[:-crop_bottom] if image.shape[0] > crop_bottom else None
                if image is None:
                    out.append((run, name, None, None, None))
                else:
                    out.append((run, name, image.shape[1], image.shape[0], np.ascontiguousarray(image).tobytes()))
            yield pd.DataFrame(out, columns=["run_id", "filename", "w", "h", "pixels"]).astype(
                {"w": "Int32", "h": "Int32"})

    read = files.mapInPandas(unpack, "run_id string, filename string, w int, h int, pixels binary")
    names = files.select("run_id", "filename")
    bad = read.where(F.col("pixels").isNull()).select("run_id", "filename")
    order = rank_by(names.join(bad, ["run_id", "filename"], "left_anti"), ["run_id"], ["filename"], "tile_id")
    return read.where(F.col("pixels").isNotNull()).join(order, ["run_id", "filename"]), bad


def tiles_from_vectors(vectors: DataFrame, side: int, value: str, low: float, high: float) -> DataFrame:
    """Square tiles from array columns, scaled from [low, high] to grey bytes."""
    span = high - low

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            grey = [np.clip(np.rint((np.asarray(v, float) - low) / span * 255.0), 0, 255).astype(np.uint8).tobytes()
                    for v in frame[value]]
            yield frame.drop(columns=[value]).assign(w=side, h=side, pixels=grey)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != value]
    return vectors.mapInPandas(pack, ", ".join([*fields, "w int, h int, pixels binary"]))
