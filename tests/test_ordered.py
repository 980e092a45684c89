"""Chunked scans equal plain windows for every chunk width."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from stagelog.operators import ordered as O
from stagelog.operators.quantiles import exact_percentiles


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(0)
    rows = []
    for run, n in (("hot", 400), ("b", 37), ("one", 1)):
        at = np.sort(rng.choice(5000, n, replace=False))
        rows += [(run, int(i), int(v), int(v) if v % 3 else None) for i, v in zip(at, rng.integers(-50, 50, n))]
    return spark.createDataFrame(rows, "run_id string, i bigint, v bigint, m bigint").cache()


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 20])
def test_scans_match_windows(log, width):
    w = W.partitionBy("run_id").orderBy("i")
    rows = w.rowsBetween(W.unboundedPreceding, 0)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    assert same(O.running_sum(log, ["run_id"], "i", {"s": F.col("v")}, width=width).select("run_id", "i", "s"),
                log.select("run_id", "i", F.sum("v").over(rows)))
    assert same(O.running_sum(log, ["run_id"], "i", {"s": F.col("v")}, inclusive=False, width=width).select("run_id", "i", "s"),
                log.select("run_id", "i", F.coalesce(F.sum("v").over(before), zero)))
    assert same(O.dense_position(log, ["run_id"], "i", "p", width=width).select("run_id", "i", "p"),
                log.select("run_id", "i", F.row_number().over(w) - 1))
    assert same(O.previous_row(log, ["run_id"], "i", {"p": F.col("m")}, width=width).select("run_id", "i", "p"),
                log.select("run_id", "i", F.lag("m").over(w)))
    for inclusive, frame in ((True, rows), (False, before)):
        assert same(O.last_known(log, ["run_id"], "i", {"k": F.col("m")}, inclusive=inclusive, width=width).select("run_id", "i", "k"),
                    log.select("run_id", "i", F.last("m", ignorenulls=True).over(frame)))


@pytest.mark.parametrize("width", [3, 10, 1 << 20])
def test_trailing_rows(log, width):
    dense = O.dense_position(log, ["run_id"], "i", "p")
    got = O.trailing_rows(dense, ["run_id"], "p", F.col("v"), 4, "a", width=width).select("run_id", "i", "a")
    frame = W.partitionBy("run_id").orderBy("i").rowsBetween(-3, 0)
    assert same(got, log.select("run_id", "i", F.collect_list("v").over(frame)))


def test_rank_by(log):
    named = log.withColumn("name", F.concat(F.lit("n"), F.col("i").cast("string")))
    got = O.rank_by(named, ["run_id"], ["name"], "r", start=1).select("run_id", "name", "r")
    want = named.select("run_id", "name", F.row_number().over(W.partitionBy("run_id").orderBy("name")))
    assert same(got, want)


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_percentiles_are_exact(log, accuracy):
    probs = {"p0": 0.0, "m": 0.5, "q": 0.9, "p1": 1.0}
    got = exact_percentiles(log, ["run_id"], "v", probs, accuracy=accuracy).toPandas().set_index("run_id")
    values = log.toPandas().groupby("run_id")["v"]
    for name, p in probs.items():
        for run, v in values:
            assert got.loc[run, name] == pytest.approx(np.quantile(v, p), abs=1e-9)


@pytest.mark.parametrize("width", [1, 5, 1 << 20])
def test_null_keys_and_orders_keep_their_rows(spark, width):
    rows = spark.createDataFrame([(None, 3, 1), (None, 9, 2), ("a", None, 4), ("a", 2, 8), ("b", None, 16)], "k string, i bigint, v bigint")
    w = W.partitionBy("k").orderBy("i")
    assert same(O.running_sum(rows, ["k"], "i", {"s": F.col("v")}, width=width).select("k", "i", "s"),
                rows.select("k", "i", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0))))
    assert same(O.previous_row(rows, ["k"], "i", {"p": F.col("v")}, width=width).select("k", "i", "p"), rows.select("k", "i", F.lag("v").over(w)))
    assert same(O.last_known(rows, ["k"], "i", {"p": F.col("v")}, inclusive=False, width=width).select("k", "i", "p"), rows.select("k", "i", F.lag("v").over(w)))


def test_rank_by_equal_names(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "x", 3)], "k string, n string, v bigint")
    got = O.rank_by(rows, ["k"], ["n"], "r").orderBy("r").collect()
    assert [r.r for r in got] == [0, 1, 2] and sorted(r.v for r in got) == [1, 2, 3] and got[2].n == "y"


def test_null_keys_and_orders_are_groups_of_their_own(spark):
    rows = [(r, k, i, v) for r, k in (("a", 1), (None, 1), ("a", None), (None, None), ("", 0)) for i, v in ((None, 100), (-5, 7), (3, None), (9, 2))]
    df = spark.createDataFrame(rows, "r string, k bigint, i bigint, v bigint")
    w = W.partitionBy("r", "k").orderBy("i")
    for width in (1, 4, 1 << 20):
        got = O.running_sum(df, ["r", "k"], "i", {"s": F.col("v")}, width=width)
        assert got.columns == ["r", "k", "i", "v", "s"]
        assert same(got, df.withColumn("s", F.coalesce(F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))))
        assert same(O.previous_row(df, ["r", "k"], "i", {"p": F.col("v"), "key": F.col("r")}, width=width),
                    df.withColumns({"p": F.lag("v").over(w), "key": F.lag("r").over(w)}))
        assert same(O.last_known(df, ["r", "k"], "i", {"v": F.col("v") + 1}, width=width).select("r", "k", "i", "v"),
                    df.select("r", "k", "i", F.last(F.col("v") + 1, ignorenulls=True).over(w)))
    assert O.dense_position(df.limit(0), ["r", "k"], "i", "p").count() == 0


def test_chunks_of_rows(spark):
    """Order values far apart and in clumps: chunks stay even, and scans over them equal plain windows."""
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.choice(10 ** 9, 3000, replace=False) * 10 ** 6, 5 + np.arange(3000)])
    rows = [("hot" if k % 4 else "b", int(i), int(v)) for k, (i, v) in enumerate(zip(at, rng.integers(-9, 9, len(at))))]
    df = spark.createDataFrame(rows, "run_id string, i bigint, v bigint").repartition(5)
    cut = O.row_chunks(df, ["run_id"], "i", "c", rows=500)
    sizes = [r["count"] for r in cut.groupBy("c").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 2 * 500
    w = W.partitionBy("run_id").orderBy("i")
    chunk = F.col("c")
    assert same(O.running_sum(cut, ["run_id"], "i", {"s": F.col("v")}, chunk=chunk).drop("c"),
                df.withColumn("s", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0))))
    assert same(O.previous_row(cut, ["run_id"], "i", {"p": F.col("v")}, chunk=chunk).drop("c"), df.withColumn("p", F.lag("v").over(w)))
    assert same(O.last_known(cut, ["run_id"], "i", {"p": F.nullif("v", F.lit(3))}, chunk=chunk).drop("c"),
                df.withColumn("p", F.last(F.nullif("v", F.lit(3)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))))


@pytest.mark.parametrize("scan", [
    lambda d: O.dense_position(d, ["run_id"], "i", "p"), lambda d: O.previous_row(d, ["run_id"], "i", {"p": F.col("v")}),
    lambda d: O.last_known(d, ["run_id"], "i", {"p": F.col("m")})])
def test_a_scan_exchanges_its_table_once(spark, tmp_path, log, scan):
    """Without broadcasts: the rows are dealt out once, the other exchanges have one row a chunk."""
    log.withColumn("wide", F.lit("text")).write.parquet(str(tmp_path / "log"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = scan(spark.read.parquet(str(tmp_path / "log")))
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = text.splitlines()
    exchanges = [n for n, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(exchanges) <= 4
    wide = [n for n in exchanges if "wide#" in next(x for x in lines[n + 1:] if "Project" in x or "Aggregate" in x)]
    assert len(wide) == 1
