"""The agreement report kept up to date while its log grows (K4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stagelog.operators.quality import verdict
from stagelog.session import cut_lineage, release
from stagelog.sources.versions import VersionedTable, folder_rows

_SUM = T.DecimalType(38, 0)
_MOMENTS = ("t", "a", "tt", "aa", "ta", "gap")  # sums of target, actual, their squares and product, and of |target - actual|
_COUNTS = ("n", "x_agree", "y_agree")


def _fields(*names_and_types) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in names_and_types])


MOMENTS = [f"{axis}_{m}" for axis in "xy" for m in _MOMENTS]
STATE = _fields(
    ("run_id", T.StringType()), ("window_start", T.TimestampType()), *[(c, T.LongType()) for c in _COUNTS], *[(m, _SUM) for m in MOMENTS])
REFERENCE = _fields(("run_id", T.StringType()), ("rx", T.LongType()), ("ry", T.LongType()))
ROW = _fields(
    ("run_id", T.StringType()), ("window_start", T.TimestampType()), *[(c, T.LongType()) for c in ("tx", "ty", "ax", "ay")])


def moments_of(rows: DataFrame) -> DataFrame:
    """Exact, mergeable sums of displacements per run and window: whole numbers, added in any order."""
    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast(_SUM)

    agg = [F.count("tx").alias("n"), F.count_if(F.col("tx").cast(_SUM) * F.col("ax") > 0).alias("x_agree"),
           F.count_if(F.col("ty").cast(_SUM) * F.col("ay") > 0).alias("y_agree")]
    for axis in "xy":
        t, a = (F.col(f"{kind}{axis}").cast(T.DecimalType(19, 0)) for kind in "ta")
        for name, value in zip(_MOMENTS, (t, a, t * t, a * a, t * a, F.abs(t - a))):
            agg.append(total(value).alias(f"{axis}_{name}"))
    return rows.groupBy("run_id", "window_start").agg(*agg)


def merged(states: DataFrame, by: list[str]) -> DataFrame:
    """States added up by ``by``."""
    return states.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in _COUNTS], *[F.sum(m).cast(_SUM).alias(m) for m in MOMENTS])


def report_of(states: DataFrame) -> DataFrame:
    """The columns of the batch report from merged sums."""
    n = F.col("n").cast("double")
    out = {}
    for axis in "xy":
        t, a, tt, aa, ta, gap = (F.col(f"{axis}_{m}") for m in _MOMENTS)
        rows = F.col("n").cast(T.DecimalType(19, 0))

        def spread(product, one, other):  # n squared times the covariance, still a whole number
            return (rows * product - one * other).cast("double")

        scale = F.sqrt(spread(tt, t, t)) * F.sqrt(spread(aa, a, a))
        out[f"{axis}_r"] = F.coalesce(F.try_divide(spread(ta, t, a), scale), F.lit(0.0))
        out[f"{axis}_mae"] = F.try_divide(gap.cast("double"), n)
    keys = [c for c in states.columns if c not in (*MOMENTS, *_COUNTS)]
    states = states.withColumns(out)
    return states.select(
        *keys, *_COUNTS, *out, F.try_divide(100.0 * F.col("x_agree"), F.col("n")).alias("x_agree_pct"),
        F.try_divide(100.0 * F.col("y_agree"), F.col("n")).alias("y_agree_pct")).withColumn("verdict", verdict())


class LiveReport:
    """Report of a stream of steps in a folder that all executors share.

    ``update`` is for ``foreachBatch``.  It adds the batch's sums to the last state of the windows it touches and
    writes those as a new version, so windows are never closed, late rows count, and the report can be
    read at any time, open windows included.  A repeated batch writes what it wrote before.

    Displacements are taken from the run's reference: the row with ``ref_step`` that arrives first (within a
    batch that of the smallest ``source_index``).  Rows that come before it wait in the folder and are written
    again with each batch while they do; until then they count in no figure, but their windows are listed.  Sums
    are whole numbers of at most 38 digits.  Rows without a time are in a window of their own, null.
    """

    def __init__(self, spark: SparkSession, path: str, *, window: str = "1 hour", ref_step: int = 0, every: int = 20):
        self.spark, self.path, self.window, self.ref_step, self.every = spark, path, window, ref_step, every

    def _table(self, spark: SparkSession, name: str) -> VersionedTable:
        keys, schema = {"states": (["run_id", "window_start"], STATE), "references": (["run_id"], REFERENCE)}[name]
        return VersionedTable(spark, f"{self.path}/{name}", keys, schema, self.every)

    def update(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        states, references = self._table(spark, "states"), self._table(spark, "references")
        start = F.date_trunc("microsecond", F.window("event_time", self.window)["start"])
        timed = batch.where("event_time is not null").withColumn("window_start", start).unionByName(
            batch.where("event_time is null").withColumn("window_start", F.lit(None).cast("timestamp")))
        rows = cut_lineage(timed.select(
            "run_id", "source_index", "window_start", F.col("step").eqNullSafe(self.ref_step).alias("is_ref"),
            *[F.col(f"{axis}_{kind}_abs").alias(f"{kind[0]}{axis}") for kind in ("target", "actual") for axis in "xy"]))
        known = references.latest(number)
        first = rows.where("is_ref").groupBy("run_id").agg(F.min_by(F.struct("tx", "ty"), "source_index").alias("r"))
        new = cut_lineage(first.select("run_id", F.col("r.tx").alias("rx"), F.col("r.ty").alias("ry")).join(
            known.select("run_id"), "run_id", "left_anti"))
        placed = rows.select("run_id", "window_start", *[F.when(~F.col("is_ref"), F.col(c)).alias(c) for c in ROW.names[2:]])
        held = folder_rows(spark, f"{self.path}/waiting", number, ROW)
        come = placed.unionByName(held.join(new.select("run_id"), "run_id", "left_semi"))
        measured = come.join(known.unionByName(new), "run_id", "left")
        measured = measured.withColumns({f"{kind}{axis}": F.col(f"{kind}{axis}") - F.col(f"r{axis}") for kind in "ta" for axis in "xy"})
        added = cut_lineage(moments_of(measured))
        touched = states.latest(number).join(added.select("run_id", "window_start"), ["run_id", "window_start"], "left_semi")
        states.write(number, merged(touched.unionByName(added), ["run_id", "window_start"]))
        waiting = placed.unionByName(held).join(known.unionByName(new).select("run_id"), "run_id", "left_anti")
        waiting.write.mode("overwrite").parquet(f"{self.path}/waiting/batch={number}")
        references.write(number, new)
        for table in (rows, new, added):
            release(table)

    def windows(self) -> DataFrame:
        """The batch report's columns for each run and window, as of the last batch."""
        return report_of(self._table(self.spark, "states").latest())

    def runs(self) -> DataFrame:
        """The batch report's columns for each run: its windows merged."""
        return report_of(merged(self._table(self.spark, "states").latest(), ["run_id"]))


def follow(stream: DataFrame, report: LiveReport) -> None:
    """Bring ``report`` up to date with everything that ``stream`` has now; call again when its log has grown."""
    query = (
        stream.writeStream.foreachBatch(report.update).option("checkpointLocation", f"{report.path}/progress")
        .trigger(availableNow=True).start())
    query.awaitTermination()
