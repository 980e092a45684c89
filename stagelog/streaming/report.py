"""Live agreement report (K4) and running a stream to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from stagelog.session import shared_folder


def stream_report(stream: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """K4: per run and time window, how measured moves follow commanded ones.

    Displacements are relative to the stage origin, as a stream has no first row
    to look back to; late rows beyond the watermark are dropped.
    """
    tx, ty, ax, ay = (F.col(c).cast("double") for c in ("x_target_abs", "y_target_abs", "x_actual_abs", "y_actual_abs"))
    return (
        stream.withWatermark("event_time", watermark).groupBy("run_id", F.window("event_time", window).alias("w"))
        .agg(F.count("*").alias("n"), F.count_if(tx * ax > 0).alias("x_agree"), F.count_if(ty * ay > 0).alias("y_agree"),
             F.avg(F.abs(tx - ax)).alias("x_mae"), F.avg(F.abs(ty - ay)).alias("y_mae"))
        .select("run_id", F.col("w.start").alias("window_start"), "n", "x_agree", "y_agree", "x_mae", "y_mae"))


def replay(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything available now into a table in the shared folder and return it."""
    spark: SparkSession = stream.sparkSession
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{home}/rows")
        .option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")
