"""Writing logs and position maps in the forms the readers take.

Rows are range-partitioned in output order, so a large run becomes several
files whose names follow the order; reading them with ``run_from="folder"``
gives the run back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stagelog.schema import RAW_STEP
from stagelog.sources.folders import mounted, write_folders


# Tasks put their own files in place; otherwise the driver renames every file, one after the other.
COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """Rows sorted into as many ranges as a shuffle has partitions.

    Writing a file for each key takes time by files, not bytes, so small ranges must not be merged into a few tasks.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)


def write_text(df: DataFrame, out: str, keys: list[str], order: list[str], form: str, overwrite: bool) -> None:
    """Rows in ranges of ``order``, in one folder for each value of ``keys``: the column ``value`` as text, or all others as JSON lines."""
    ordered = in_ranges(df, *order)
    if mounted(df.sparkSession, out) is None:
        mode = "overwrite" if overwrite else "errorifexists"
        writer = ordered.drop(*[c for c in order if c not in keys]).write.options(**COMMIT).mode(mode).partitionBy(*keys)
        return writer.json(out) if form == "json" else writer.text(out)
    value = F.to_json(F.struct(*[c for c in df.columns if c not in keys and c not in order])) if form == "json" else F.col("value")
    write_folders(ordered.select(*keys, value.alias("value")), out, keys, ".json" if form == "json" else ".txt", overwrite)


def write_steps(steps: DataFrame, out: str, overwrite: bool = False) -> None:
    """Records as JSON lines in source order, one folder per run."""
    text = {"confidence": "confidence_text", "step": "step_text"}
    fields = [F.col(text[f] if text.get(f) in steps.columns else f).alias(f) for f in RAW_STEP.fieldNames() if f in steps.columns]
    write_text(steps.select("run_id", "source_index", *fields), out, ["run_id"], ["run_id", "source_index"], "json", overwrite)


def write_positions(positions: DataFrame, out: str, overwrite: bool = False) -> None:
    """Position maps keyed by file name: the files of a run's folder, in order, form one JSON object."""
    ends = positions.groupBy("run_id").agg(F.min("entry").alias("first"), F.max("entry").alias("last"))
    named = F.to_json(F.struct(F.col("filename").alias("k")))
    name = F.when(F.col("filename").isNull(), "").otherwise(named.substr(F.lit(6), F.length(named) - 6))
    body = F.to_json(F.struct("x", "y", "w", "h", "confidence"))
    line = F.concat(
        F.when(F.col("entry") == F.col("first"), "{").otherwise(","), name, F.lit(": "), body,
        F.when(F.col("entry") == F.col("last"), "}").otherwise(""))
    write_text(positions.join(ends, "run_id").select("run_id", "entry", line.alias("value")), out, ["run_id"], ["run_id", "entry"], "text", overwrite)
