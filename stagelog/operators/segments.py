"""Contiguous high-confidence segments of a log.

A rejected record closes the running segment, so a segment is named by the
number of rejections before it.  Counting, numbering and the join back to the
records are all keyed by (run, chunk), never by run or segment alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagelog.functions.units import safe_label, with_filename
from stagelog.operators.ordered import CHUNK, chunk_of, running_sum
from stagelog.operators.quality import attach_positions
from stagelog.schema import RAW_STEP
from stagelog.session import cut_lineage
from stagelog.sources.sinks import COMMIT, in_ranges, write_text

_RUN = ["run_id"]


def mark_segments(
    steps: DataFrame, positions: DataFrame | None = None, min_confidence: float = 0.8, width: int = CHUNK,
) -> DataFrame:
    """Add ``rejected`` and ``segment`` (rejections so far) to every record.

    A record is kept when it has a position whose confidence is not below the
    threshold; a not-a-number confidence is therefore kept.
    """
    if not 0.0 <= min_confidence <= 1.0:
        raise ValueError("min_confidence must lie between 0 and 1")
    base = attach_positions(steps, positions) if positions is not None else steps
    conf = F.col("position_confidence")
    base = base.withColumn("rejected", conf.isNull() | (conf < min_confidence))
    return running_sum(base, _RUN, "source_index", {"segment": F.col("rejected").cast("bigint")}, width=width)


def _pieces(marked: DataFrame, width: int) -> DataFrame:
    """Partial statistics of each segment within each chunk."""
    return (
        marked.where(~F.col("rejected")).withColumn("piece", chunk_of("source_index", width))
        .groupBy("run_id", "segment", "piece").agg(
            F.count("*").alias("records"), F.min("source_index").alias("first_index"),
            F.max("source_index").alias("last_index"),
            F.min_by("step", "source_index").alias("first_step"),
            F.max_by("step", "source_index").alias("last_step")))


def segment_summary(marked: DataFrame, min_length: int = 1, width: int = CHUNK) -> DataFrame:
    """D3: one row per segment; ``part`` numbers the long-enough ones from 1, null for short ones."""
    if min_length < 1:
        raise ValueError("min_length must be at least 1")
    whole = _pieces(marked, width).groupBy("run_id", "segment").agg(
        F.sum("records").alias("records"), F.min("first_index").alias("first_index"),
        F.max("last_index").alias("last_index"),
        F.min_by("first_step", "first_index").alias("first_step"),
        F.max_by("last_step", "last_index").alias("last_step"))
    kept = F.col("records") >= min_length
    numbered = running_sum(whole, _RUN, "first_index", {"part": kept.cast("bigint")}, width=width)
    return numbered.withColumn("part", F.when(kept, F.col("part")))


def segment_runs(
    steps: DataFrame, positions: DataFrame | None = None, min_confidence: float = 0.8,
    min_length: int = 1, confidence_field: str | None = "position_confidence", width: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """The records of every long-enough segment with its ``part``, and the discarded records."""
    marked = cut_lineage(mark_segments(steps, positions, min_confidence, width))  # read four times
    parts = segment_summary(marked, min_length, width).where(F.col("part").isNotNull())
    where = _pieces(marked, width).select("run_id", "segment", "piece").join(
        parts.select("run_id", "segment", "part"), ["run_id", "segment"])
    rows = (
        marked.where(~F.col("rejected")).withColumn("piece", chunk_of("source_index", width))
        .join(where, ["run_id", "segment", "piece"]).drop("piece", "rejected"))
    if confidence_field is None:
        rows = rows.drop("position_confidence")
    elif confidence_field != "position_confidence":
        rows = rows.withColumnRenamed("position_confidence", confidence_field)
    return rows, discarded_records(marked)


def discarded_records(marked: DataFrame) -> DataFrame:
    out = marked.where(F.col("rejected"))
    out = out if "filename" in out.columns or "img_path" not in out.columns else with_filename(out)
    keep = [c for c in ("img_path", "filename") if c in out.columns]
    reason = F.when(F.col("position_confidence").isNull(), "missing-position").otherwise("below-threshold")
    return out.select("run_id", "source_index", "step", *keep, "position_confidence", reason.alias("reason"))


def discard_reasons(discarded: DataFrame) -> DataFrame:
    """Discarded records per reason."""
    return discarded.groupBy("run_id", "reason").agg(F.count("*").alias("records"))


def segment_file(stem: Column, part: Column, first: Column, last: Column) -> Column:
    unknown = F.lit("unknown")
    number = F.lpad(part.cast("string"), F.greatest(F.lit(3), F.length(part.cast("string"))), F.lit("0"))
    return F.concat(
        stem, F.lit("_part"), number, F.lit("_steps"), F.coalesce(safe_label(first), unknown),
        F.lit("-"), F.coalesce(safe_label(last), unknown))


def plan_segments(summary: DataFrame) -> DataFrame:
    """What a write would produce, without writing."""
    name = segment_file(F.col("run_id"), F.col("part"), F.col("first_step"), F.col("last_step"))
    return summary.where(F.col("part").isNotNull()).select(
        "run_id", "part", name.alias("segment_file"), "records", "first_step", "last_step")


def write_segments(
    rows: DataFrame, plan: DataFrame, out: str, confidence_field: str | None = "position_confidence",
    overwrite: bool = False, width: int = CHUNK,
) -> None:
    """JSON lines under one folder per segment, records in source order.

    Range partitioning splits a long segment over several files whose names
    follow the record order.  An existing target is an error unless ``overwrite``.
    """
    names = plan.select("run_id", "part", "segment_file")
    fields = [f for f in RAW_STEP.fieldNames() if f in rows.columns and f != "position_confidence"]
    fields += [confidence_field] if confidence_field else []
    record = [F.col("confidence_text").alias(f) if f == "confidence" and "confidence_text" in rows.columns
              else F.col(f) for f in fields]
    named = rows.join(names, ["run_id", "part"]).select("run_id", "part", "source_index", "segment_file", *record)
    write_text(named, out, ["run_id", "segment_file"], ["run_id", "part", "source_index"], "json", overwrite)


def build_manifest(
    marked: DataFrame, summary: DataFrame, min_confidence: float = 0.8, min_length: int = 1,
    confidence_field: str | None = "position_confidence", position_entries: DataFrame | None = None,
    source_format: str = "jsonl",
) -> DataFrame:
    """One row of counts and settings per run.

    The lists of a manifest grow with the log, so they stay rows of their own:
    see :func:`manifest_entries`.
    """
    counts = marked.groupBy("run_id").agg(
        F.count("*").alias("input_records"), F.count_if("rejected").alias("discarded_count"))
    zero = F.lit(0).cast("bigint")
    kept = F.col("part").isNotNull()
    segs = summary.groupBy("run_id").agg(
        F.count_if(kept).alias("segment_count"), F.count_if(~kept).alias("omitted_count"),
        F.sum(F.when(kept, F.col("records")).otherwise(zero)).alias("written_records"))
    out = counts.join(segs, "run_id", "left")
    if position_entries is not None:
        entries = position_entries.groupBy("run_id").agg(
            F.count_distinct("filename").alias("position_entries"))
        out = out.join(entries, "run_id", "left")
    out = out.fillna(0)
    return out.withColumns({
        "source_format": F.lit(source_format), "min_confidence": F.lit(float(min_confidence)),
        "confidence_field": F.lit(confidence_field).cast("string"),
        "min_segment_length": F.lit(int(min_length)).cast("bigint"),
    })


def manifest_entries(discarded: DataFrame, summary: DataFrame) -> DataFrame:
    """The manifest's lists as rows ``(run_id, section, ordinal, entry)`` with ``entry`` in JSON."""
    keep = [c for c in ("img_path", "filename") if c in discarded.columns]
    d = discarded.select(
        "run_id", F.lit("discarded_records").alias("section"), F.col("source_index").alias("ordinal"),
        F.to_json(F.struct("source_index", "step", *keep, "position_confidence", "reason"),
                  {"ignoreNullFields": "false"}).alias("entry"))
    span = F.struct("records", "first_step", "last_step")
    short = summary.where(F.col("part").isNull()).select(
        "run_id", F.lit("omitted_short_segments").alias("section"), F.col("first_index").alias("ordinal"),
        F.to_json(span).alias("entry"))
    plan = plan_segments(summary).select(
        "run_id", F.lit("segments").alias("section"), F.col("part").alias("ordinal"),
        F.to_json(F.struct(F.concat("segment_file", F.lit(".jsonl")).alias("file"),
                           "records", "first_step", "last_step")).alias("entry"))
    return d.unionByName(short).unionByName(plan)


def write_manifest(header: DataFrame, entries: DataFrame, out: str, overwrite: bool = False) -> None:
    """Counts as one JSON line per run, lists as ordered JSON lines per run and section."""
    mode = "overwrite" if overwrite else "errorifexists"
    header.write.mode(mode).json(f"{out}/header")
    in_ranges(entries, "run_id", "section", "ordinal").write.options(**COMMIT).mode(mode).partitionBy("run_id", "section").json(f"{out}/entries")
