"""Queries that replay ``events`` as a stream and return what the stream wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stagelog import adapters as A
from stagelog.queries import query
from stagelog.queries.logs import T, _windows_sql
from stagelog.schema import STREAM_STEP
from stagelog.session import cut_lineage, shared_folder
from stagelog.sources.tail import tail_steps
from stagelog.streaming.live import LiveReport, follow
from stagelog.streaming.report import replay
from stagelog.streaming.stateful import stream_drift, stream_segments, stream_windows, use_rocksdb

B = "bigint"
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _events(spark, folder):
    use_rocksdb(spark)
    schema = A.table(spark, folder, "events").schema
    # a pattern that only the table's own name fits: streams take a file only by pattern, a folder of files either way
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")


def _steps(spark, folder):
    """The step view with the event id as step (a stream cannot rank its rows)."""
    e = F.col("event_id")
    return _events(spark, folder).select(
        F.col("user_id").cast("string").alias("run_id"), e.alias("source_index"), F.col("ts").cast("timestamp").alias("event_time"),
        e.alias("step"), (e * 7919 % 40001 - 20000).alias("x_target_abs"), (e * 104729 % 40001 - 20000).alias("y_target_abs"),
        (e * 7919 % 40001 - 20000 + e * 31 % 4001 - 2000).alias("x_actual_abs"),
        (e * 104729 % 40001 - 20000 + e * 57 % 3001 - 1500).alias("y_actual_abs"),
        ((e * 13 % 1000).cast("double") / F.lit(1000.0)).alias("confidence"),
        F.when(e % 23 != 0, (e * 37 % 1000).cast("double") / F.lit(1000.0)).alias("position_confidence"))


@query("streamed_segments", f"""WITH {A.STEPS_SQL}, m AS (SELECT *, position_confidence IS NULL OR position_confidence < {T} AS rejected FROM steps),
s AS (SELECT *, CAST(sum(CASE WHEN rejected THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY source_index) AS BIGINT) AS segment FROM m)
SELECT run_id, source_index, segment, CAST(rejected AS BIGINT) AS rejected,
  CAST(sum(CASE WHEN rejected THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, segment ORDER BY source_index) AS BIGINT) AS length FROM s""")
def streamed_segments(spark, folder):
    """K1: equal to the batch segmentation."""
    out = replay(stream_segments(_steps(spark, folder), T))
    return out.select("run_id", "source_index", "segment", F.col("rejected").cast(B).alias("rejected"), "length")


@query("streamed_drift", f"""WITH {A.TASKS_SQL}, d AS (SELECT *, coalesce(sum(CASE WHEN task_type = 'CORRECTION' THEN dx ELSE 0 END) OVER w, 0) AS drift_x,
  coalesce(sum(CASE WHEN task_type = 'CORRECTION' THEN dy ELSE 0 END) OVER w, 0) AS drift_y FROM tasks
  WINDOW w AS (PARTITION BY run_id ORDER BY source_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT run_id, source_index, CAST(drift_x AS BIGINT) AS drift_x, CAST(drift_y AS BIGINT) AS drift_y, CAST(x_target+drift_x AS BIGINT) AS x_drifted, CAST(y_target+drift_y AS BIGINT) AS y_drifted FROM d""")
def streamed_drift(spark, folder):
    """K2: equal to the batch accumulation."""
    return replay(stream_drift(A.tasks_from_events(_events(spark, folder)))).drop("late")


@query("streamed_windows", f"WITH {A.STEPS_SQL} " + _windows_sql("steps", "run_id", "step", 4, 1))
def streamed_windows(spark, folder):
    """K3: equal to the batch windows."""
    return replay(stream_windows(_steps(spark, folder), 4))


def _live_sql(by: str) -> str:
    keys = {"window": "run_id, window_start", "run": "run_id"}[by]
    return f"""WITH {A.STEPS_SQL}, ref0 AS (SELECT run_id, x_target_abs AS rx, y_target_abs AS ry FROM steps WHERE step = 0),
d AS (SELECT run_id, CAST(epoch_us(time_bucket(INTERVAL 1 DAY, event_time)) // 1000000 AS BIGINT) AS window_start,
  CASE WHEN step <> 0 THEN CAST(x_target_abs-rx AS DOUBLE) END AS tx, CASE WHEN step <> 0 THEN CAST(y_target_abs-ry AS DOUBLE) END AS ty,
  CASE WHEN step <> 0 THEN CAST(x_actual_abs-rx AS DOUBLE) END AS ax, CASE WHEN step <> 0 THEN CAST(y_actual_abs-ry AS DOUBLE) END AS ay FROM steps LEFT JOIN ref0 USING (run_id)),
g AS (SELECT {keys}, count(tx) AS n, count(*) FILTER (tx*ax > 0) AS x_agree, count(*) FILTER (ty*ay > 0) AS y_agree,
  coalesce(CASE WHEN stddev_pop(tx)*stddev_pop(ax) = 0 THEN 0 ELSE covar_pop(tx,ax)/(stddev_pop(tx)*stddev_pop(ax)) END, 0) AS x_r,
  coalesce(CASE WHEN stddev_pop(ty)*stddev_pop(ay) = 0 THEN 0 ELSE covar_pop(ty,ay)/(stddev_pop(ty)*stddev_pop(ay)) END, 0) AS y_r,
  avg(abs(tx-ax)) AS x_mae, avg(abs(ty-ay)) AS y_mae FROM d GROUP BY {keys})
SELECT {keys}, n, x_agree, y_agree, round(x_r,6) AS x_r, round(y_r,6) AS y_r, round(x_mae,6) AS x_mae, round(y_mae,6) AS y_mae,
  CASE WHEN n > 0 THEN round(CAST(100 AS DOUBLE)*x_agree/n,6) END AS x_agree_pct, CASE WHEN n > 0 THEN round(CAST(100 AS DOUBLE)*y_agree/n,6) END AS y_agree_pct,
  CASE WHEN n <= 1 THEN 'INSUFFICIENT' WHEN x_r < 0.3 OR y_r < 0.3 THEN 'LOW' WHEN x_r > 0.8 AND y_r > 0.8 THEN 'GOOD' ELSE 'MODERATE' END AS verdict
FROM g"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("x_r", "y_r", "x_mae", "y_mae", "x_agree_pct", "y_agree_pct")})


def _home(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _log_rows(spark, folder):
    return A.steps_from_events(A.table(spark, folder, "events")).select(*STREAM_STEP.names)


@query("streamed_report", _live_sql("window"))
def streamed_report(spark, folder):
    """K4: every window of every run, open ones included, after several micro-batches."""
    log, report = _home(spark, "log"), LiveReport(spark, _home(spark, "live"), window="1 day")
    _log_rows(spark, folder).repartition(6).write.parquet(log)
    follow(spark.readStream.schema(STREAM_STEP).option("maxFilesPerTrigger", 2).parquet(log), report)
    return _rounded(report.windows()).withColumn("window_start", F.unix_seconds("window_start"))


@query("tailed_report", _live_sql("run"))
def tailed_report(spark, folder):
    """A10 and K4: the report of each run, brought up to date twice from a log of JSON lines that has grown between."""
    log, report = _home(spark, "log"), LiveReport(spark, _home(spark, "live"), window="1 day")
    rows = cut_lineage(_log_rows(spark, folder))
    for late in (True, False):  # the later half first, so many rows wait for their reference
        rows.where(F.col("source_index") % 2 == int(late)).write.mode("append").json(log, timestampFormat=MICROS)
        follow(tail_steps(spark, log, glob="*.json", range_bytes=1 << 20), report)
    return _rounded(report.runs())


@query("tailed_steps", f"""WITH {A.STEPS_SQL} SELECT run_id, source_index, CAST(epoch_us(event_time) AS BIGINT) AS event_us, step, x_target_abs, y_target_abs,
  x_actual_abs, y_actual_abs, confidence, position_confidence FROM steps""")
def tailed_steps(spark, folder):
    """A10: every record of a log of JSON lines read by byte ranges while it grows."""
    log, home = _home(spark, "log"), _home(spark, "tailed")
    rows = cut_lineage(_log_rows(spark, folder))
    for part in range(2):
        rows.where(F.col("source_index") % 2 == part).write.mode("append").json(log, timestampFormat=MICROS)
        stream = tail_steps(spark, log, glob="*.json", range_bytes=1 << 18)
        stream.writeStream.format("parquet").option("path", f"{home}/rows").option(
            "checkpointLocation", f"{home}/progress").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{home}/rows")
    return out.select("run_id", "source_index", F.unix_micros("event_time").alias("event_us"), *STREAM_STEP.names[3:])
