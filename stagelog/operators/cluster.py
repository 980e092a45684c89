"""Weighted agreement clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stagelog.functions.rows import distance
from stagelog.session import cut_lineage

_FINE = 4  # cells per radius
_TOGETHER = 1024  # points of a group that are compared in one place


def agreement_cluster(
    df: DataFrame, group: list[str], x: str, y: str, quality: str, weight: str, radius: float,
    min_support: int, order: str, pair_limit: int = 64,
) -> DataFrame:
    """Per group, the weighted mean of the points around its best-supported point.

    The best point has the most points within ``radius``, then the largest
    quality sum, then the smallest ``order``.  Points are compared pair by pair
    only where the largest group has at most ``pair_limit`` of them; otherwise cells bound
    what is compared, in one place for groups of at most ``_TOGETHER`` points.
    """
    pts = df.select(
        *group, F.col(x).alias("px"), F.col(y).alias("py"), F.col(quality).alias("q"), F.col(weight).alias("wt"),
        F.col(order).alias("o"))
    sizes = pts.groupBy(*group).count()
    least, most = sizes.agg(F.min("count"), F.max("count")).first()
    if (most or 0) <= pair_limit:
        supported = _by_pairs(pts, group, radius)
    elif most <= _TOGETHER:
        supported = _in_place(pts, group, radius, min_support)
    elif least > _TOGETHER:
        supported = _by_cells(pts, group, radius, min_support)
    else:
        large = cut_lineage(sizes.where(F.col("count") > _TOGETHER).select(*group))
        supported = _in_place(pts.join(large, group, "left_anti"), group, radius, min_support).unionByName(
            _by_cells(pts.join(large, group, "left_semi"), group, radius, min_support))
    best = supported.groupBy(*group).agg(F.max_by(
        F.struct("sx", "sy", "support"), F.struct(F.col("support"), F.col("quality"), -F.col("so"))).alias("s"))
    best = best.where(F.col("s.support") >= min_support)
    members = pts.join(best, group).where(
        distance(F.col("px") - F.col("s.sx"), F.col("py") - F.col("s.sy")) <= radius)
    return members.groupBy(*group).agg(
        (F.sum(F.col("px") * F.col("wt")) / F.sum("wt")).alias("x"),
        (F.sum(F.col("py") * F.col("wt")) / F.sum("wt")).alias("y"),
        F.count("*").alias("support"), F.sum("q").alias("quality"))


def _by_pairs(pts: DataFrame, group: list[str], radius: float) -> DataFrame:
    """Support of every point from its group's pairs; groups are known to be small."""
    seeds = pts.select(*group, F.col("px").alias("sx"), F.col("py").alias("sy"), F.col("o").alias("so"))
    near = seeds.join(pts, group).where(
        distance(F.col("px") - F.col("sx"), F.col("py") - F.col("sy")) <= radius)
    return near.groupBy(*group, "so", "sx", "sy").agg(
        F.count("*").alias("support"), F.round(F.sum("q"), 9).alias("quality"))


def _reach(ox: Column, oy: Column) -> tuple[Column, Column]:
    """Whether points of cells so far apart may lie, and surely lie, within the radius."""
    ox, oy = (F.least(F.abs(o), F.lit(_FINE + 2)) for o in (ox, oy))  # more is as far, and squares stay small
    near = distance(F.greatest(ox - 1, F.lit(0)), F.greatest(oy - 1, F.lit(0)))
    return near <= _FINE, distance(ox + 1, oy + 1) < _FINE


def _in_place(pts: DataFrame, group: list[str], radius: float, min_support: int) -> DataFrame:
    """What :func:`_by_cells` gives, for groups small enough to meet in one task: no pair is moved."""
    cell = radius / _FINE
    seeds = pts.groupBy(*group, F.col("px").alias("sx"), F.col("py").alias("sy"), F.col("o").alias("so")).agg(F.count("*").alias("copies"))
    ox, oy = (F.floor(F.col(f"p{a}") / cell) - F.floor(F.col(f"s{a}") / cell) for a in "xy")
    possible, sure = _reach(ox, oy)
    hit = ~F.col("sure") & (distance(F.col("px") - F.col("sx"), F.col("py") - F.col("sy")) <= radius)
    sums = seeds.join(pts.drop("o", "wt"), group).where(possible).withColumn("sure", sure).groupBy(*group, "so", "sx", "sy", "copies").agg(
        F.count_if("sure").alias("low"), F.sum(F.when(F.col("sure"), F.col("q")).otherwise(F.lit(0.0))).alias("low_q"), F.count("*").alias("high"),
        F.count_if(hit).alias("more"), F.sum(F.when(hit, F.col("q"))).alias("more_q"))
    floor_ = F.max(F.greatest("low", F.lit(1).cast("bigint"))).over(W.partitionBy(*group))
    contenders = sums.withColumn("floor", floor_).where((F.col("high") >= F.col("floor")) & (F.col("high") >= min_support))
    # rows that share an order value add up what is not sure
    alike, known = W.partitionBy(*group, "so"), F.col("so").isNotNull()
    more, more_q = (F.when(known, F.sum(F.col("copies") * F.col(c)).over(alike)) for c in ("more", "more_q"))
    return contenders.withColumns({"__more": more, "__more_q": more_q}).select(
        *group, "so", "sx", "sy", (F.col("low") + F.coalesce("__more", F.lit(0))).alias("support"),
        F.round(F.col("low_q") + F.coalesce("__more_q", F.lit(0.0)), 9).alias("quality"))


def _by_cells(pts: DataFrame, group: list[str], radius: float, min_support: int) -> DataFrame:
    """Support of the points that may be best, from fine-grid cell totals.

    Cells wholly inside or outside a cell's reach are only counted, and a cell
    whose upper bound is under another's lower bound is out, so a tight group of
    any size compares (almost) no points one by one.
    """
    cell = radius / _FINE
    pts = pts.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    cells = pts.groupBy(*group, "cx", "cy").agg(F.count("*").alias("n"), F.sum("q").alias("q"))

    reach = _FINE + 1
    possible, sure = _reach(F.col("ox"), F.col("oy"))
    blocks = cells.withColumns({"bx": F.floor(F.col("cx") / reach), "by": F.floor(F.col("cy") / reach)})

    def reached(from_cells: DataFrame) -> DataFrame:
        """The cells that points of each cell may reach: cells meet in blocks of ``reach`` of them and the blocks around."""
        step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        around = from_cells.select(*group, "ax", "ay").withColumn("sx", step).withColumn("sy", step).select(
            *group, "ax", "ay", (F.floor(F.col("ax") / reach) + F.col("sx")).alias("bx"), (F.floor(F.col("ay") / reach) + F.col("sy")).alias("by"))
        met = around.join(blocks, [*group, "bx", "by"]).withColumns({"ox": F.col("cx") - F.col("ax"), "oy": F.col("cy") - F.col("ay")})
        return met.where(possible).select(*group, "ax", "ay", "cx", "cy", "n", "q", sure.alias("sure"))

    links = reached(cells.select(*group, F.col("cx").alias("ax"), F.col("cy").alias("ay")))
    zero = F.lit(0)
    bounds = links.groupBy(*group, "ax", "ay").agg(
        F.sum(F.when(F.col("sure"), F.col("n")).otherwise(zero)).alias("low"),
        F.sum(F.when(F.col("sure"), F.col("q")).otherwise(F.lit(0.0))).alias("low_q"),
        F.sum("n").alias("high"))
    floor_ = bounds.groupBy(*group).agg(F.max(F.greatest("low", F.lit(1).cast("bigint"))).alias("floor"))
    contenders = bounds.join(floor_, group).where(
        (F.col("high") >= F.col("floor")) & (F.col("high") >= min_support)).select(*group, "ax", "ay", "low", "low_q")

    seeds = pts.select(*group, F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("px").alias("sx"),
                       F.col("py").alias("sy"), F.col("o").alias("so")).join(contenders, [*group, "ax", "ay"])
    reachable = reached(contenders).where(~F.col("sure")).select(*group, "ax", "ay", "cx", "cy")
    others = reachable.join(pts, [*group, "cx", "cy"]).select(*group, "ax", "ay", "px", "py", "q")
    extra = (
        seeds.join(others, [*group, "ax", "ay"])
        .where(distance(F.col("px") - F.col("sx"), F.col("py") - F.col("sy")) <= radius)
        .groupBy(*group, "so").agg(F.count("*").alias("more"), F.sum("q").alias("more_q")))
    return seeds.join(extra, [*group, "so"], "left").select(
        *group, "so", "sx", "sy", (F.col("low") + F.coalesce("more", F.lit(0))).alias("support"),
        F.round(F.col("low_q") + F.coalesce("more_q", F.lit(0.0)), 9).alias("quality"))
