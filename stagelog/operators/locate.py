"""Locating tiles in a composite (H2).

The search is exhaustive by definition.  Tiles and search areas meet in bounded
bundles, so a body travels once per bundle of the other side, not once per pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stagelog.operators.pixels import as_array, gaussian5
from stagelog.operators.registration import zero_mean_ncc

_HALO = 2
TILES_PER_BUNDLE = 16
AREAS_PER_BUNDLE = 4


def _areas(blocks: DataFrame, block: int, tile_w: int, tile_h: int, blur: bool) -> DataFrame:
    """Each block extended by a tile's size, blurred, with its opaque sum."""
    reach = [-(-(n + _HALO) // block) for n in (tile_w, tile_h)]
    spread = blocks.select(
        "run_id", "bx", "by", "pixels", "alpha",
        F.explode(F.sequence(F.lit(-reach[0]), F.lit(1))).alias("ox")
    ).withColumn("oy", F.explode(F.sequence(F.lit(-reach[1]), F.lit(1))))
    spread = spread.withColumns({"ax": F.col("bx") + F.col("ox"), "ay": F.col("by") + F.col("oy")}).where(
        (F.col("ax") >= 0) & (F.col("ay") >= 0))
    h, w = block + tile_h - 1 + 2 * _HALO, block + tile_w - 1 + 2 * _HALO

    def build(key, frame):
        run, ax, ay = key
        grey, alpha = np.zeros((h, w), np.uint8), np.zeros((h, w), np.uint8)
        left, top = ax * block - _HALO, ay * block - _HALO
        for r in frame.itertuples(index=False):
            x1, y1 = r.bx * block - left, r.by * block - top
            xs, ys = slice(max(0, x1), min(w, x1 + block)), slice(max(0, y1), min(h, y1 + block))
            if xs.start >= xs.stop or ys.start >= ys.stop:
                continue
            for target, body in ((grey, r.pixels), (alpha, r.alpha)):
                target[ys, xs] = as_array(body, block, block)[ys.start - y1: ys.stop - y1, xs.start - x1: xs.stop - x1]
        grey = gaussian5(grey) if blur else grey
        core = np.s_[_HALO: _HALO + block, _HALO: _HALO + block]
        solid = alpha[core] >= 128
        inner = np.s_[_HALO: h - _HALO, _HALO: w - _HALO]
        return pd.DataFrame([(run, ax, ay, int(grey[core][solid].sum()), int(solid.sum()),
                              np.ascontiguousarray(grey[inner]).tobytes(), np.ascontiguousarray(alpha[inner]).tobytes())],
                            columns=["run_id", "ax", "ay", "total", "solid", "grey", "opaque"])

    return spread.groupBy("run_id", "ax", "ay").applyInPandas(
        build, "run_id string, ax bigint, ay bigint, total bigint, solid bigint, grey binary, opaque binary")


def cut_blocks(images: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """One composite image per run (``w``, ``h``, ``pixels``, optional ``alpha``) as blocks, and its size."""
    has_alpha = "alpha" in images.columns

    def cut(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                rows, cols = -(-r.h // block), -(-r.w // block)
                room = ((0, rows * block - r.h), (0, cols * block - r.w))
                grey = np.pad(as_array(r.pixels, r.w, r.h), room)
                solid = as_array(r.alpha, r.w, r.h) if has_alpha else np.full((r.h, r.w), 255, np.uint8)
                solid = np.pad(solid, room)
                for by in range(rows):
                    for bx in range(cols):
                        at = np.s_[by * block: (by + 1) * block, bx * block: (bx + 1) * block]
                        out.append((r.run_id, bx, by, grey[at].tobytes(), solid[at].tobytes()))
            yield pd.DataFrame(out, columns=["run_id", "bx", "by", "pixels", "alpha"])

    kept = ["run_id", "w", "h", "pixels", *(["alpha"] if has_alpha else [])]
    blocks = images.select(*kept).mapInPandas(cut, "run_id string, bx bigint, by bigint, pixels binary, alpha binary")
    return blocks, images.select("run_id", F.col("w").cast("bigint").alias("cw"), F.col("h").cast("bigint").alias("ch"))


def locate_tiles(
    tiles: DataFrame, blocks: DataFrame, block: int, tile_w: int, tile_h: int, blur: bool = True,
    size: DataFrame | None = None,
) -> DataFrame:
    """H2: best place of every tile in its run's composite; null where the tile is larger.

    ``blocks`` are (run_id, bx, by, pixels, alpha) squares of side ``block`` as
    composed; all tiles are ``tile_w`` × ``tile_h``.  ``size`` (run_id, cw, ch)
    bounds the search where the last blocks are padded.  Transparent pixels take the
    mean of the opaque ones.  The first best place in row order wins.
    """
    areas = _areas(blocks, block, tile_w, tile_h, blur)
    if size is None:
        size = blocks.groupBy("run_id").agg(
            ((F.max("bx") + 1) * block).alias("cw"), ((F.max("by") + 1) * block).alias("ch"))
    fill = areas.groupBy("run_id").agg(F.floor(F.sum("total") / F.sum("solid")).cast("int").alias("fill"))
    counts = size.join(fill, "run_id").join(
        tiles.groupBy("run_id").agg((F.expr(f"max(tile_id) div {TILES_PER_BUNDLE}")).alias("last_t")), "run_id")
    counts = counts.withColumn("nx", F.ceil(F.col("cw") / block)).withColumn(
        "last_a", F.expr(f"(nx * ceil(ch / {block}) - 1) div {AREAS_PER_BUNDLE}"))
    everywhere = F.sequence(F.lit(0).cast("bigint"), F.col("last_a"))
    left = tiles.select("run_id", "tile_id", "w", "h", "pixels").join(counts, "run_id").select(
        "run_id", F.expr(f"tile_id div {TILES_PER_BUNDLE}").alias("t"), F.explode(everywhere).alias("a"),
        "tile_id", "pixels")
    right = areas.join(counts, "run_id").where(
        (F.col("ax") < F.col("nx")) & (F.col("ay") * block < F.col("ch"))).select(
        "run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last_t"))).alias("t"),
        F.expr(f"(ay * nx + ax) div {AREAS_PER_BUNDLE}").alias("a"), "ax", "ay", "grey", "opaque", "fill", "cw", "ch")
    shape = (block + tile_h - 1, block + tile_w - 1)

    def search(key, some, where):
        best: dict[int, tuple] = {}
        images = {}
        for tid, body in zip(some["tile_id"], some["pixels"]):
            image = as_array(body, tile_w, tile_h)
            images[tid] = gaussian5(image) if blur else image
        for r in where.itertuples(index=False):
            grey = np.frombuffer(r.grey, np.uint8).reshape(shape)
            field = np.where(np.frombuffer(r.opaque, np.uint8).reshape(shape) >= 128, grey, r.fill)
            w, h = min(shape[1], r.cw - r.ax * block), min(shape[0], r.ch - r.ay * block)
            if w < tile_w or h < tile_h:
                continue
            for tid, image in images.items():
                surface = np.round(zero_mean_ncc(field[:h, :w], image), 9)
                y, x = np.unravel_index(int(np.argmax(surface)), surface.shape)
                got = (float(surface[y, x]), -int(r.ay * block + y), -int(r.ax * block + x))
                best[tid] = max(best.get(tid, got), got)
        rows = [(key[0], int(t), -x, -y, s) for t, (s, y, x) in best.items()]
        return pd.DataFrame(rows, columns=["run_id", "tile_id", "x", "y", "score"])

    found = left.groupBy("run_id", "t", "a").cogroup(right.groupBy("run_id", "t", "a")).applyInPandas(
        search, "run_id string, tile_id bigint, x bigint, y bigint, score double")
    top = found.groupBy("run_id", "tile_id").agg(F.max_by(
        F.struct("x", "y", "score"), F.struct(F.col("score"), -F.col("y"), -F.col("x"))).alias("b"))
    ids = tiles.select("run_id", "tile_id", F.lit(tile_w).cast("bigint").alias("w"), F.lit(tile_h).cast("bigint").alias("h"))
    return ids.join(top, ["run_id", "tile_id"], "left").select(
        "run_id", "tile_id", F.col("b.x").alias("x"), F.col("b.y").alias("y"), "w", "h",
        F.round("b.score", 4).alias("confidence"))
