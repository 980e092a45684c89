"""Whole jobs, shape and correction reports, shared random numbers."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from stagelog import workflows as Wf
from stagelog.operators import quality as Q
from stagelog.plans import trajectories as Tr
from stagelog.queries import graphs, logs

SF = "/root/testdata/sf0.001"


def fifth_powers(*keys):
    m, state = Tr.FIELD, 0
    for k in [h for key in keys for h in (key % m, int(math.trunc(key / m)) % m)] + list(Tr.FINISH):
        state = pow(state + k, 5, m)
    return state


def test_mixed_numbers(frame):
    rows = [(0, 0), (1, 2), (-5, 7), (1 << 40, 3), (Tr.FIELD - 1, Tr.FIELD)]
    got = frame(rows, "a bigint, b bigint").select("a", "b", Tr.mixed([F.lit(9).cast("bigint"), F.col("a"), F.col("b")]).alias("m")).collect()
    assert all(r["m"] == fifth_powers(9, r["a"], r["b"]) for r in got)
    assert frame([(None, 1)], "a bigint, b bigint").select(Tr.mixed([F.col("a"), F.col("b")])).first()[0] is not None


def test_random_numbers_are_even(spark):
    n = 40_000
    found = spark.range(n).select(F.lit(3).alias("plan_id"), F.col("id").alias("seq")).select(
        Tr._uniform(1, Tr.ANGLE).alias("a"), Tr._uniform(1, Tr.RADIUS).alias("b"), Tr._uniform(2, Tr.ANGLE).alias("c"))
    row = found.agg(F.avg("a"), F.stddev("a"), F.corr("a", "b"), F.corr("a", "c"), F.count_distinct("a"), F.min("a"), F.max("a")).first()
    assert abs(row[0] - 0.5) < 0.01 and abs(row[1] - 12 ** -0.5) < 0.01 and abs(row[2]) < 0.03 and abs(row[3]) < 0.03
    assert row[4] > n - 5 and row[5] >= 0 and row[6] < 1
    cells = found.groupBy(F.floor(F.col("a") * 10), F.floor(F.col("b") * 10)).count().collect()
    assert len(cells) == 100 and sum((r["count"] - n / 100) ** 2 / (n / 100) for r in cells) < 160  # chi-square, 99 degrees


def test_names_as_plans(frame):
    plans = frame([("p", 0, 0, 4, 100), ("q", 0, 0, 4, 100)], "plan_id string, x0 bigint, y0 bigint, n int, radius_nm bigint")
    rows = Tr.random_walk(plans, seed=1).collect()
    assert len(rows) == 10 and len({(r["x_nm"], r["y_nm"]) for r in rows if r["seq"]}) == 8
    assert all(math.hypot(r["x_nm"], r["y_nm"]) <= 100 for r in rows)


def test_shapes(frame):
    rows = [("a", 8, 8)] * 3 + [("b", 8, 8), ("b", 9, 8), ("b", None, 8), ("c", None, None), ("d", 9, 9), ("d", 8, 9)]
    images = frame(rows, "run_id string, w bigint, h bigint")
    got = {r[0]: tuple(r)[1:] for r in Q.shape_report(images).collect()}
    assert got == {"a": (3, 1, 8, 8, 0, True), "b": (3, 3, 8, 8, 2, False), "c": (1, 1, None, None, 0, True), "d": (2, 2, 8, 9, 1, False)}
    assert Q.shape_report(images.limit(0)).count() == 0


def test_corrections(frame):
    poses = [("a", k, 3.0 * k, 4.0 * k) for k in range(11)] + [("b", 0, None, 1.0), ("c", 1, 1.0, 1.0)]
    at = [("a", k, 0.0, 0.0) for k in range(11)] + [("b", 0, 0.0, 0.0)]
    kind = "run_id string, tile_id bigint, x double, y double"
    got = Q.correction_summary(frame(poses, kind), frame(at, kind), nm_per_px=2.0, limit_nm=85.0).collect()
    assert len(got) == 1 and got[0]["tiles"] == 11 and got[0]["beyond"] == 2
    assert got[0]["median_nm"] == pytest.approx(statistics.median(10.0 * k for k in range(11)))
    assert got[0]["p90_nm"] == pytest.approx(90) and got[0]["max_nm"] == pytest.approx(100)


def test_recalculate_and_segment(spark):
    steps, positions = logs.steps(spark, SF), logs.positions(spark, SF)
    found = Wf.recalculate_and_segment(steps, positions, min_confidence=0.3, min_length=2)
    kept, lost = found.rows.count(), found.discarded.count()
    short = found.summary.where("part is null").agg(F.sum("records")).first()[0] or 0
    assert kept + lost + short == steps.count() and kept and lost
    assert found.summary.agg(F.sum(F.when(F.col("part").isNotNull(), F.col("records")))).first()[0] == kept
    counts = found.counts.agg(F.sum("updated"), F.sum("skipped")).first()
    assert sum(counts) == steps.count() and found.agreement.count() > 0
    none = Wf.recalculate_and_segment(steps.limit(0), positions)
    assert none.rows.count() == none.discarded.count() == none.summary.count() == 0


def test_stitch(spark):
    """Every run of exact edges ends where it was sent; tiles of different shapes are refused."""
    run = graphs.layout(spark, SF).first()["run_id"]
    at = graphs.targets(spark, SF).where(F.col("run_id") == run)
    tiles = graphs.tiles(spark, SF).where(F.col("run_id") == run)
    exact = graphs.pairs(spark, SF).where(F.col("run_id") == run).select(
        "run_id", "i", "j", "dx", "dy", F.lit(0.9).alias("score"), F.lit(0.1).alias("peak_margin"), F.lit(0.5).alias("base_weight"))
    small = at.withColumns({"x": F.col("x") / 32, "y": F.col("y") / 32})
    edges = exact.withColumns({"dx": F.col("dx") / 32, "dy": F.col("dy") / 32})
    done = Wf.stitch(tiles, small, edges, block=64)
    row = done.corrections.first()
    placed = done.poses.count()
    assert placed > 0 and row["tiles"] == placed and row["max_nm"] < 1e-3 and row["beyond"] == 0
    assert done.mosaic.agg(F.sum("covered")).first()[0] > 64 and done.edges.count() > 0
    with pytest.raises(ValueError, match="shapes"):
        Wf.stitch(tiles.withColumn("w", F.when(F.col("tile_id") == 0, 9).otherwise(F.col("w"))), small, edges)
