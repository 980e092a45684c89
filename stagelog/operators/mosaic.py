"""Mosaic composition block by block (H8, H9).

Feather weights are whole numbers (distance to the tile edge, up to the feather
width), so sums are exact and may be combined in any order.  Where many tiles
cover one block, bounded sub-groups are combined level by level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from collections.abc import Iterator
from pyspark.sql import DataFrame, functions as F

from stagelog.operators.pixels import as_array
from stagelog.operators.quality import canvas_extent
from stagelog.schema import CANVAS_MARGIN_PX, CROP_PADDING_PX, FEATHER_PX
from stagelog.session import cut_lineage

GROUP_LIMIT = 64
_PART = "run_id string, bx bigint, by bigint, salt bigint, a binary, b binary, c binary"


def _ramp(size: int, start: int, count: int) -> np.ndarray:
    """Distance of ``count`` pixels of a line from its nearer end, from 1: half the line less the way from its middle."""
    k = np.arange(start, start + count)
    return (size + 1 - np.abs(2 * k - size + 1)) // 2


def placements(tiles: DataFrame, poses: DataFrame, margin: int = CANVAS_MARGIN_PX) -> DataFrame:
    """Integer canvas position of every placed tile (no pixels read)."""
    shape = tiles.select("run_id", "tile_id", "w", "h")
    placed = poses.select("run_id", "tile_id", "x", "y").join(shape, ["run_id", "tile_id"])
    low = canvas_extent(poses, 0, 0, margin).select("run_id", "min_x", "min_y")
    return placed.join(low, "run_id").select(
        "run_id", "tile_id", "w", "h",
        (F.bround("x").cast("bigint") - F.col("min_x") + margin).alias("px"),
        (F.bround("y").cast("bigint") - F.col("min_y") + margin).alias("py"))


def _blocks_of(placed: DataFrame, block: int) -> DataFrame:
    def span(start: str, size: str):
        return F.explode(F.sequence(F.floor(F.col(start) / block), F.floor((F.col(start) + F.col(size) - 1) / block)))

    return placed.withColumn("bx", span("px", "w")).withColumn("by", span("py", "h"))


def _merge(blend: str, size: int):
    def merge(key, frame):
        shape = size * size
        if blend == "feather":
            a, b, c = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
            for r in frame.itertuples(index=False):
                a += np.frombuffer(r.a, np.int64)
                b += np.frombuffer(r.b, np.int64)
                c += np.frombuffer(r.c, np.int64)
        else:
            a, b = np.zeros(shape, np.int64), np.full(shape, np.iinfo(np.int64).max)
            c = np.zeros(shape, np.int64)
            for r in frame.itertuples(index=False):
                w, o, v = (np.frombuffer(x, np.int64) for x in (r.a, r.b, r.c))
                better = (w > a) | ((w == a) & (o < b))
                a, b, c = np.where(better, w, a), np.where(better, o, b), np.where(better, v, c)
        return pd.DataFrame([(*key, a.tobytes(), b.tobytes(), c.tobytes())],
                            columns=["run_id", "bx", "by", "salt", "a", "b", "c"])

    return merge


def compose_mosaic(
    tiles: DataFrame, poses: DataFrame, block: int = 512, feather: int = FEATHER_PX, blend: str = "feather",
    margin: int = CANVAS_MARGIN_PX, group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """H8: covered blocks of each run's mosaic, one row per block with its pixels.

    ``feather`` averages by distance to the tile edge; ``sharp`` takes the pixel
    furthest from its tile's edge, the first tile winning ties.  ``covered`` and
    ``overlapped`` count pixels under at least one and (feather) two tiles; the
    four bounds are canvas coordinates of the covered pixels.
    """
    if blend not in ("feather", "sharp"):
        raise ValueError(f"unknown blend {blend!r}")
    placed = placements(tiles, poses, margin)
    touched = cut_lineage(_blocks_of(placed, block))
    groups = touched.groupBy("run_id", "bx", "by").agg(F.ceil(F.count("*") / F.lit(group_limit)).alias("salts"))
    deepest = groups.agg(F.max("salts")).first()[0] or 1
    pieces = touched.join(groups, ["run_id", "bx", "by"]).withColumn(
        "salt", F.pmod(F.xxhash64("tile_id"), F.col("salts")))
    per_tile = pieces.groupBy("run_id", "tile_id", "px", "py").agg(
        F.collect_list(F.struct("bx", "by", "salt", "salts")).alias("blocks"))
    rows = per_tile.join(tiles.select("run_id", "tile_id", "w", "h", "pixels"), ["run_id", "tile_id"]).select(
        "run_id", "tile_id", "px", "py", "w", "h", "blocks", "pixels")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                image = as_array(r.pixels, r.w, r.h)
                for k in r.blocks:
                    x1, x2 = max(r.px, k["bx"] * block), min(r.px + r.w, (k["bx"] + 1) * block)
                    y1, y2 = max(r.py, k["by"] * block), min(r.py + r.h, (k["by"] + 1) * block)
                    body = np.ascontiguousarray(image[y1 - r.py: y2 - r.py, x1 - r.px: x2 - r.px])
                    out.append((r.run_id, k["bx"], k["by"], k["salt"], k["salts"], r.tile_id, r.w, r.h,
                                x1 - r.px, y1 - r.py, x2 - x1, y2 - y1, x1 - k["bx"] * block, y1 - k["by"] * block,
                                body.tobytes()))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in cut_schema.split(", ")])

    cut_schema = ("run_id string, bx bigint, by bigint, salt bigint, salts bigint, tile_id bigint, w int, h int, "
                  "sx bigint, sy bigint, pw bigint, ph bigint, dx bigint, dy bigint, body binary")

    def accumulate(key, frame):
        a, b, c = (np.zeros((block, block), np.int64) for _ in range(3))
        if blend == "sharp":
            b[:] = np.iinfo(np.int64).max
        for r in frame.sort_values("tile_id").itertuples(index=False):
            weight = np.minimum.outer(_ramp(r.h, r.sy, r.ph), _ramp(r.w, r.sx, r.pw)).clip(max=feather)
            pixel = as_array(r.body, r.pw, r.ph).astype(np.int64)
            at = np.s_[r.dy: r.dy + r.ph, r.dx: r.dx + r.pw]
            if blend == "feather":
                a[at] += weight * pixel
                b[at] += weight
                c[at] += 1
            else:
                better = weight > a[at]
                a[at][better], c[at][better], b[at][better] = weight[better], pixel[better], r.tile_id
        return pd.DataFrame([(*key, a.tobytes(), b.tobytes(), c.tobytes())],
                            columns=["run_id", "bx", "by", "salt", "a", "b", "c"])

    parts = rows.mapInPandas(cut, cut_schema).groupBy("run_id", "bx", "by", "salt").applyInPandas(accumulate, _PART)
    while deepest > 1:
        deepest = -(-deepest // group_limit)
        parts = parts.withColumn("salt", F.pmod("salt", F.lit(deepest))).groupBy(
            "run_id", "bx", "by", "salt").applyInPandas(_merge(blend, block), _PART)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                a, b, c = (np.frombuffer(v, np.int64).reshape(block, block) for v in (r.a, r.b, r.c))
                used = (b if blend == "feather" else a) > 0
                pixel = np.where(used, a // np.maximum(b, 1), 0) if blend == "feather" else np.where(used, c, 0)
                ys, xs = np.flatnonzero(used.any(1)), np.flatnonzero(used.any(0))
                x0, y0 = r.bx * block, r.by * block
                twice = int((c > 1).sum()) if blend == "feather" else None
                out.append((r.run_id, r.bx, r.by, block, block, pixel.astype(np.uint8).tobytes(),
                            np.where(used, 255, 0).astype(np.uint8).tobytes(), int(used.sum()), twice,
                            x0 + int(xs[0]), x0 + int(xs[-1]), y0 + int(ys[0]), y0 + int(ys[-1])))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in done.split(", ")]).astype({"overlapped": "Int64"})

    done = ("run_id string, bx bigint, by bigint, w int, h int, pixels binary, alpha binary, covered bigint, "
            "overlapped bigint, left bigint, right bigint, top bigint, bottom bigint")
    return parts.drop("salt").mapInPandas(finish, done)


def crop_extent(blocks: DataFrame, padding: int = CROP_PADDING_PX) -> DataFrame:
    """Bounds of the covered pixels with padding, not beyond the canvas origin."""
    zero = F.lit(0).cast("bigint")
    return blocks.groupBy("run_id").agg(
        F.greatest(zero, F.min("left") - padding).alias("x1"), (F.max("right") + padding + 1).alias("x2"),
        F.greatest(zero, F.min("top") - padding).alias("y1"), (F.max("bottom") + padding + 1).alias("y2"))


def coverage(blocks: DataFrame) -> DataFrame:
    """H9: covered and multiply covered share of every block."""
    area = (F.col("w") * F.col("h")).cast("double")
    return blocks.select("run_id", "bx", "by", "covered", "overlapped", (F.col("covered") / area).alias("covered_share"),
                         (F.col("overlapped") / area).alias("overlapped_share"))
