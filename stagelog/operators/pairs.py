"""Candidate pairs of overlapping tiles.

Every tile looks only at earlier tiles, so appending records never changes
existing pairs.  Nearest-earlier search is a grid equi-join; where tiles crowd,
finer grids answer most tiles first and only the unanswered ones go on to the
next coarser grid, so no cell ever emits all of its pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from stagelog.functions.rows import overlaps
from stagelog.operators.features import approach_direction
from stagelog.operators.ordered import CHUNK, trailing_rows
from stagelog.schema import (
    MIN_OVERLAP_PX, NEIGHBOURS, NEIGHBOURS_RECENT, NEIGHBOURS_SAME_DIRECTION, RECENT_WINDOW)
from stagelog.session import cut_lineage

CELL_LIMIT = 256
_FINER = 4.0


def _cell(column: str, size: float):
    return F.floor(F.col(column) / F.lit(size))


def _cell_sizes(heads: DataFrame, keys: list[str], radius: float, limit: int) -> list[float]:
    """Cell sizes from coarse to fine; the finest has no cell above ``limit`` tiles.

    Positions are distinct up to a few copies, so splitting ends.
    """
    sizes = [radius]
    while len(sizes) < 20:
        size = sizes[-1]
        fullest = (
            heads.groupBy(*keys, _cell("x", size).alias("cx"), _cell("y", size).alias("cy"))
            .count().agg(F.max("count")).first()[0])
        if fullest is None or fullest <= limit:
            break
        sizes.append(size / _FINER)
    return sizes


def nearest_earlier(
    tiles: DataFrame, keys: list[str], k: int, radius: float, cell_limit: int = CELL_LIMIT,
) -> DataFrame:
    """The ``k`` nearest tiles with a smaller ``tile_id`` within ``radius``; ties to the smaller id.

    Exact: a tile counts as answered on a grid of cell size *s* only when its
    k-th neighbour lies within *s*, the range the 3×3 cells cover completely.
    Of many tiles on one spot only the first ``k`` can ever be neighbours.
    """
    spot = W.partitionBy(*keys, "x", "y").orderBy("tile_id")
    heads = tiles.select(*keys, "tile_id", "x", "y").withColumn("__r", F.row_number().over(spot)).where(
        F.col("__r") <= k).drop("__r")
    crowded = heads.groupBy(*keys, "x", "y").agg(F.sort_array(F.collect_list("tile_id")).alias("first")).where(
        F.size("first") == k)
    stacked = (
        tiles.select(*keys, "tile_id", "x", "y").join(crowded, [*keys, "x", "y"])
        .where(F.col("tile_id") > F.element_at("first", -1))
        .select("run_id", F.explode("first").alias("i"), F.col("tile_id").alias("j")))

    sizes = _cell_sizes(heads, keys, radius, cell_limit)
    answers, open_tiles = [stacked], heads
    for level in range(len(sizes) - 1, -1, -1):
        size, last = sizes[level], level == 0
        near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        queries = (
            open_tiles.select(*keys, F.col("tile_id").alias("j"), F.col("x").alias("jx"), F.col("y").alias("jy"))
            .withColumn("__dx", near).withColumn("__dy", near)
            .withColumns({"cx": _cell("jx", size) + F.col("__dx"), "cy": _cell("jy", size) + F.col("__dy")})
            .drop("__dx", "__dy"))
        pool = heads.select(
            *keys, F.col("tile_id").alias("i"), "x", "y", _cell("x", size).alias("cx"), _cell("y", size).alias("cy"))
        dx, dy = F.col("x") - F.col("jx"), F.col("y") - F.col("jy")
        # a tile meets hundreds of others: a broadcast would leave them in the few tasks that small tables have
        found = queries.join(pool.hint("merge"), [*keys, "cx", "cy"]).where(F.col("i") < F.col("j")).withColumn(
            "d2", dx * dx + dy * dy).where(F.col("d2") <= size * size)
        by_tile = W.partitionBy("run_id", "j")
        best = found.withColumn("__r", F.row_number().over(by_tile.orderBy("d2", "i"))).where(F.col("__r") <= k)
        if last:
            answers.append(best.select("run_id", "i", "j"))
            break
        best = best.withColumn("__n", F.count("*").over(by_tile)).where(F.col("__n") == k)
        done = cut_lineage(best.select("run_id", "i", "j"))
        answers.append(done)
        open_tiles = cut_lineage(open_tiles.join(
            done.select("run_id", F.col("j").alias("tile_id")).distinct(), ["run_id", "tile_id"], "left_anti"))
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


def nearest_recent(
    tiles: DataFrame, k: int, recent: int, width: int = CHUNK,
) -> DataFrame:
    """The ``k`` nearest among the ``recent`` tiles just before each tile."""
    rows = trailing_rows(tiles, ["run_id"], "tile_id", F.struct("tile_id", "x", "y"), recent + 1,
                         "__rows", width=width)
    earlier = F.slice("__rows", 1, F.size("__rows") - 1)
    ranked = F.array_sort(F.transform(earlier, lambda t: F.struct(
        ((t["x"] - F.col("x")) * (t["x"] - F.col("x")) + (t["y"] - F.col("y")) * (t["y"] - F.col("y"))).alias("d2"),
        t["tile_id"].alias("i"))))
    return rows.where(F.size("__rows") > 1).select(
        "run_id", F.explode(F.slice(ranked, 1, k)).alias("n"), F.col("tile_id").alias("j")
    ).select("run_id", "n.i", "j")


def neighbor_pairs(
    tiles: DataFrame, w: int, h: int, min_overlap: int = MIN_OVERLAP_PX, k: int = NEIGHBOURS,
    k_same_dir: int = NEIGHBOURS_SAME_DIRECTION, k_recent: int = NEIGHBOURS_RECENT,
    recent: int = RECENT_WINDOW, cell_limit: int = CELL_LIMIT, width: int = CHUNK,
) -> DataFrame:
    """C4: pairs (i < j) worth registering, from a layout with dense ``tile_id``.

    Ranks are taken before the overlap test.  Two tiles further apart than
    ``radius`` cannot overlap, and nearer tiles rank first, so searching within
    it loses nothing.
    """
    base = tiles.select("run_id", "tile_id", F.col("x_px").alias("x"), F.col("y_px").alias("y"))
    base = cut_lineage(approach_direction(base, "x", "y", "tile_id", width=width))
    radius = math.hypot(w - min_overlap, h - min_overlap)
    pools = []
    if k > 0:
        pools.append(nearest_earlier(base, ["run_id"], k, radius, cell_limit))
    if k_same_dir > 0:
        pools.append(nearest_earlier(base, ["run_id", "dir_x", "dir_y"], k_same_dir, radius, cell_limit))
    if k_recent > 0:
        pools.append(nearest_recent(base, k_recent, recent, width))
    merged = pools[0]
    for pool in pools[1:]:
        merged = merged.unionByName(pool)
    at = base.select("run_id", "tile_id", "x", "y")
    out = (
        merged.distinct()
        .join(at.select("run_id", F.col("tile_id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi")).hint("merge"), ["run_id", "i"])
        .join(at.select("run_id", F.col("tile_id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj")).hint("merge"), ["run_id", "j"]))
    out = out.withColumns({"dx": F.col("xj") - F.col("xi"), "dy": F.col("yj") - F.col("yi")})
    return out.where(overlaps(F.col("dx"), F.col("dy"), w, h, min_overlap)).select("run_id", "i", "j", "dx", "dy")
