"""Registration graph: residuals, cycles, cores, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagelog.functions.rows import distance
from stagelog.operators.quantiles import exact_percentiles
from stagelog.schema import CLOSURE_PX, MAX_RESIDUAL_PX, MIN_CYCLE_SUPPORT, MIN_NEIGHBOURS
from stagelog.session import cut_lineage, release


def edge_weight(score: Column, area: Column, support: Column) -> Column:
    """Weight of a registration before cycle support is known."""
    return score * score * score * score * F.greatest(F.lit(0.2), area) * F.least(F.lit(1.0), support / F.lit(3.0))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select("run_id", F.explode(F.array("i", "j")).alias("tile_id"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges per tile."""
    return endpoints(edges).groupBy("run_id", "tile_id").agg(F.count("*").alias("degree"))


def keep_edges(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """Edges whose two ends are both in ``tiles``."""
    kept = tiles.select("run_id", "tile_id")
    for end in ("i", "j"):
        kept_end = kept.withColumnRenamed("tile_id", end)
        edges = edges.join(kept_end, ["run_id", end], "left_semi")
    return edges


def drop_edges(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """Edges with no end in ``tiles`` (cheap where ``tiles`` is small)."""
    for end in ("i", "j"):
        edges = edges.join(tiles.select("run_id", F.col("tile_id").alias(end)), ["run_id", end], "left_anti")
    return edges


def triangles(edges: DataFrame, closure_px: float | None = CLOSURE_PX) -> DataFrame:
    """All triangles l < m < r with their translation closure error.

    Each edge is owned by its end of smaller degree (ties by id), so an owner
    has at most about sqrt(2·edges) owned edges however large the hubs are, and
    wedges are built only at owners.  No side is broadcast: all grow with the edges.
    """
    deg = degrees(edges)
    di, dj = (deg.select("run_id", F.col("tile_id").alias(e), F.col("degree").alias(f"d{e}")).hint("merge") for e in "ij")
    low_i = (F.col("di") < F.col("dj")) | ((F.col("di") == F.col("dj")) & (F.col("i") < F.col("j")))
    owned = edges.select("run_id", "i", "j").join(di, ["run_id", "i"]).join(dj, ["run_id", "j"]).select(
        "run_id", F.when(low_i, F.col("i")).otherwise(F.col("j")).alias("u"),
        F.when(low_i, F.col("j")).otherwise(F.col("i")).alias("v"))
    wedges = owned.join(owned.withColumnRenamed("v", "w").hint("merge"), ["run_id", "u"]).where(F.col("v") < F.col("w"))
    closed = wedges.join(
        edges.select("run_id", F.col("i").alias("v"), F.col("j").alias("w")).hint("merge"), ["run_id", "v", "w"], "left_semi")
    ordered = closed.select("run_id", F.sort_array(F.array("u", "v", "w")).alias("t")).select(
        "run_id", F.col("t")[0].alias("l"), F.col("t")[1].alias("m"), F.col("t")[2].alias("r"))

    def side(a: str, b: str) -> DataFrame:
        return edges.select("run_id", F.col("i").alias(a), F.col("j").alias(b),
                            F.struct("dx", "dy").alias(f"{a}{b}")).hint("merge")

    out = (
        ordered.join(side("l", "m"), ["run_id", "l", "m"])
        .join(side("m", "r"), ["run_id", "m", "r"]).join(side("l", "r"), ["run_id", "l", "r"]))

    def gap(axis: str) -> Column:
        return F.col(f"lm.{axis}") + F.col(f"mr.{axis}") - F.col(f"lr.{axis}")

    out = out.select("run_id", "l", "m", "r", distance(gap("dx"), gap("dy")).alias("closure_error"))
    return out if closure_px is None else out.where(F.col("closure_error") <= closure_px)


def triangle_sides(tri: DataFrame) -> DataFrame:
    sides = F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for a, b in ("lm", "mr", "lr")])
    return tri.select("run_id", "closure_error", F.explode(sides).alias("e")).select(
        "run_id", "e.i", "e.j", "closure_error")


def cycle_filter(
    edges: DataFrame, closure_px: float = CLOSURE_PX, min_support: int = MIN_CYCLE_SUPPORT,
) -> tuple[DataFrame, DataFrame]:
    """D5 + C6: edges in enough closed triangles, re-weighted, and the triangles left among them."""
    edges = cut_lineage(edges)
    tri = cut_lineage(triangles(edges, closure_px))
    sides = triangle_sides(tri)
    support = sides.groupBy("run_id", "i", "j").agg(F.count("*").alias("cycle_support")).where(
        F.col("cycle_support") >= min_support)
    support = cut_lineage(support)
    median = exact_percentiles(
        sides.join(support.select("run_id", "i", "j").hint("merge"), ["run_id", "i", "j"], "left_semi"), ["run_id", "i", "j"], "closure_error",
        {"cycle_error_median": 0.5}, many_keys=True)
    boost = F.least(F.lit(2.0), F.lit(1.0) + F.lit(0.15) * F.col("cycle_support"))
    kept = edges.join(support.hint("merge"), ["run_id", "i", "j"]).join(median.hint("merge"), ["run_id", "i", "j"]).withColumn(
        "base_weight", F.col("base_weight") * boost)
    pairs = support.select("run_id", "i", "j")
    for a, b in ("lm", "mr", "lr"):
        tri = tri.join(pairs.select("run_id", F.col("i").alias(a), F.col("j").alias(b)).hint("merge"), ["run_id", a, b], "left_semi")
    return kept, tri


def edge_residuals(edges: DataFrame, poses: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Distance between each edge's measured and solved displacement."""
    keys, at = list(by), poses
    for e in "ij":
        edges = edges.join(
            at.select(*keys, F.col("tile_id").alias(e), F.col("x").alias(f"__x{e}"), F.col("y").alias(f"__y{e}")),
            [*keys, e])
    return edges.withColumn("residual", distance(
        F.col("__xj") - F.col("__xi") - F.col("dx"), F.col("__yj") - F.col("__yi") - F.col("dy"))
    ).drop("__xi", "__yi", "__xj", "__yj")


def peel(edges: DataFrame, k: int) -> DataFrame:
    """Edges of the k-core: tiles with fewer than ``k`` edges go, until none is left to go."""
    edges = cut_lineage(edges)
    while True:
        weak = cut_lineage(degrees(edges).where(F.col("degree") < k).select("run_id", "tile_id"))
        if weak.isEmpty():
            return edges
        old, edges = edges, cut_lineage(drop_edges(edges, weak))
        release(old)
        release(weak)


def consensus_core(
    poses: DataFrame, edges: DataFrame, k: int = MIN_NEIGHBOURS, max_residual: float = MAX_RESIDUAL_PX,
) -> tuple[DataFrame, DataFrame]:
    """G1: tiles with at least ``k`` agreeing neighbours that are themselves kept, and those edges.

    ``k <= 0`` accepts every tile with degree 0 and every edge whatever its residual.
    """
    if k <= 0:
        return poses.select("run_id", "tile_id").withColumn("degree", F.lit(0).cast("bigint")), edges
    columns = edges.columns
    agreeing = edge_residuals(edges, poses).where(F.col("residual") <= max_residual).select(*columns)
    core = peel(agreeing, k)
    return degrees(core), core


def connected_components(edges: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """``component`` (its smallest tile id) of every tile on an edge.

    Random contraction (Bögeholz, Brand and Todor, 2020): each round every tile
    joins the neighbour with the smallest hash, merged tiles become one, and
    repeated edges vanish, so the graph shrinks geometrically whatever its shape.
    """
    keys = list(by)
    start = graph = cut_lineage(edges.where(F.col("i") != F.col("j")).select(*keys, "i", "j").distinct())
    labels = edges.select(*keys, F.explode(F.array("i", "j")).alias("tile_id")).distinct().withColumn(
        "label", F.col("tile_id"))
    rounds = 0
    while not graph.isEmpty():
        both = graph.select(*keys, F.col("i").alias("v"), F.col("j").alias("n")).unionByName(
            graph.select(*keys, F.col("j").alias("v"), F.col("i").alias("n")))
        salt = F.lit(rounds)

        def rank(c: str) -> Column:
            return F.struct(F.xxhash64(F.col(c), salt).alias("h"), F.col(c).alias("id"))

        best = both.groupBy(*keys, "v").agg(F.min(rank("n")).alias("b"))
        chosen = cut_lineage(best.select(*keys, "v", F.least(F.col("b"), rank("v"))["id"].alias("rep")))
        for end in ("i", "j"):
            graph = graph.join(chosen.select(*keys, F.col("v").alias(end), F.col("rep").alias(f"r{end}")), [*keys, end])
        older = [start, labels, chosen]
        start = graph = cut_lineage(graph.where(F.col("ri") != F.col("rj")).select(
            *keys, F.least("ri", "rj").alias("i"), F.greatest("ri", "rj").alias("j")).distinct())
        labels = cut_lineage(labels.join(chosen.withColumnRenamed("v", "label"), [*keys, "label"], "left").select(
            *keys, "tile_id", F.coalesce("rep", "label").alias("label")))
        for frame in older:
            release(frame)
        rounds += 1
    names = labels.groupBy(*keys, "label").agg(F.min("tile_id").alias("component"))
    return labels.join(names, [*keys, "label"]).select(*keys, "tile_id", "component")


def largest_component(components: DataFrame) -> DataFrame:
    """Tiles of each run's largest component; equal sizes go to the smaller id."""
    sizes = components.groupBy("run_id", "component").agg(F.count("*").alias("tiles"))
    winner = sizes.groupBy("run_id").agg(
        F.max_by("component", F.struct(F.col("tiles"), -F.col("component"))).alias("component"))
    return components.join(winner, ["run_id", "component"], "left_semi").select("run_id", "tile_id")
