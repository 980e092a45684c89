"""Measurement-log, tile and edge views over generic tables, in integer arithmetic.

The same expressions exist as SQL next to each view so another engine gives
bit-equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stagelog.operators.ordered import dense_position

TILE_W = TILE_H = 1280


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def steps_from_events(events: DataFrame) -> DataFrame:
    """Each user's events as the measurement log of one run."""
    e = F.col("event_id")
    out = events.select(
        F.col("user_id").cast("string").alias("run_id"), e.alias("source_index"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.lit("walk").alias("experiment_name"), F.lit(1).alias("iteration"),
        (e * 7919 % 40001 - 20000).alias("x_target_abs"),
        (e * 104729 % 40001 - 20000).alias("y_target_abs"),
        F.concat(F.lit("temp\\img_"), e.cast("string"), F.lit(".bmp")).alias("img_path"),
        ((e * 13 % 1000).cast("double") / F.lit(1000.0)).alias("confidence"),
        F.when(e % 23 != 0, (e * 37 % 1000).cast("double") / F.lit(1000.0)).alias("position_confidence"),
    ).withColumns({
        "x_actual_abs": F.col("x_target_abs") + F.col("source_index") * 31 % 4001 - 2000,
        "y_actual_abs": F.col("y_target_abs") + F.col("source_index") * 57 % 3001 - 1500,
    })
    return dense_position(out, ["run_id"], "source_index", "step")


STEPS_SQL = """steps AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS source_index, ts AS event_time,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step,
    event_id*7919%40001-20000 AS x_target_abs, event_id*104729%40001-20000 AS y_target_abs,
    event_id*7919%40001-20000 + event_id*31%4001-2000 AS x_actual_abs,
    event_id*104729%40001-20000 + event_id*57%3001-1500 AS y_actual_abs,
    'temp\\img_' || CAST(event_id AS VARCHAR) || '.bmp' AS img_path,
    CAST(event_id*13%1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS confidence,
    CASE WHEN event_id%23<>0 THEN CAST(event_id*37%1000 AS DOUBLE)/CAST(1000 AS DOUBLE) END AS position_confidence
  FROM events)"""


def positions_from_events(events: DataFrame) -> DataFrame:
    """A position entry for every located event image."""
    e = F.col("event_id")
    return events.where(e % 23 != 0).select(
        F.col("user_id").cast("string").alias("run_id"),
        F.concat(F.lit("img_"), e.cast("string"), F.lit(".bmp")).alias("filename"), e.alias("entry"),
        (e * 31 % 4000).alias("x"), (e * 57 % 3000).alias("y"),
        F.lit(1280).cast("bigint").alias("w"), F.lit(900).cast("bigint").alias("h"),
        ((e * 37 % 1000).cast("double") / F.lit(1000.0)).alias("confidence"))


POSITIONS_SQL = """positions AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, 'img_' || CAST(event_id AS VARCHAR) || '.bmp' AS filename,
    event_id*31%4000 AS x, event_id*57%3000 AS y, 1280 AS w, 900 AS h,
    CAST(event_id*37%1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS confidence
  FROM events WHERE event_id%23<>0)"""


def tasks_from_events(events: DataFrame) -> DataFrame:
    """Each user's events as an executed task list with measured shifts."""
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "CORRECTION").when(e % 3 == 1, "UPDATE_REFERENCE").otherwise("EXPOSURE")
    return events.select(
        F.col("user_id").cast("string").alias("run_id"), e.alias("source_index"), kind.alias("task_type"),
        (e * 7919 % 40001 - 20000).alias("x_target"), (e * 104729 % 40001 - 20000).alias("y_target"),
        (e * 31 % 401 - 200).alias("dx"), (e * 57 % 301 - 150).alias("dy"),
        ((e * 13 % 1000).cast("double") / F.lit(1000.0)).alias("confidence"),
        F.concat(F.lit("temp/img_"), e.cast("string"), F.lit(".bmp")).alias("img_path"))


TASKS_SQL = """tasks AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS source_index,
    CASE WHEN event_id%3=0 THEN 'CORRECTION' WHEN event_id%3=1 THEN 'UPDATE_REFERENCE' ELSE 'EXPOSURE' END AS task_type,
    event_id*7919%40001-20000 AS x_target, event_id*104729%40001-20000 AS y_target,
    event_id*31%401-200 AS dx, event_id*57%301-150 AS dy,
    CAST(event_id*13%1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS confidence,
    'temp/img_' || CAST(event_id AS VARCHAR) || '.bmp' AS img_path
  FROM events)"""


def layout_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """Each label's vectors as the commanded tile layout of one run."""
    v = F.col("vec_id")
    out = embeddings.select(
        F.col("label").cast("string").alias("run_id"), v.alias("vec_id"),
        (v * 7919 % 6001).cast("double").alias("x_px"), (v * 104729 % 6001).cast("double").alias("y_px"))
    return dense_position(out, ["run_id"], "vec_id", "tile_id")


LAYOUT_SQL = """layout AS (
  SELECT CAST(label AS VARCHAR) AS run_id, vec_id,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS tile_id,
    CAST(vec_id*7919%6001 AS DOUBLE) AS x_px, CAST(vec_id*104729%6001 AS DOUBLE) AS y_px
  FROM embeddings)"""
