"""Exposure schedules and default filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stagelog.operators.ordered import CHUNK, running_sum


def expand_schedule(exposures: DataFrame, interval_s: int, width: int = CHUNK) -> DataFrame:
    """Task rows of each plan: UPDATE_REFERENCE, then EXPOSURE pieces with CORRECTION between.

    Exposures (``plan_id``, ``step_idx``, ``exposure_s``) are cut at multiples of
    the interval of the plan's cumulative exposure time.  ``seq`` numbers the
    tasks within a step; tasks order by (step_idx, seq).
    """
    if interval_s <= 0:
        raise ValueError("the correction interval must be positive")
    base = running_sum(exposures, ["plan_id"], "step_idx", {"until": F.col("exposure_s")}, width=width)
    i = F.lit(interval_s)
    base = base.withColumn("since", F.col("until") - F.col("exposure_s"))
    first, last = F.floor(F.col("since") / i) + 1, F.ceil(F.col("until") / i)
    base = base.where(F.col("exposure_s") >= 0).withColumn(
        "cell", F.when(F.col("exposure_s") > 0, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))

    def piece(c):
        begin = F.greatest(F.col("since"), (c - 1) * i)
        end = F.least(F.col("until"), c * i)
        expose = F.struct(F.lit("EXPOSURE").alias("task_type"), (end - begin).cast("double").alias("exposure_s"))
        correct = F.struct(F.lit("CORRECTION").alias("task_type"), F.lit(None).cast("double").alias("exposure_s"))
        return F.when(c * i <= F.col("until"), F.array(expose, correct)).otherwise(F.array(expose))

    start = F.array(F.struct(F.lit("UPDATE_REFERENCE").alias("task_type"), F.lit(None).cast("double").alias("exposure_s")))
    tasks = F.concat(start, F.flatten(F.transform("cell", piece)))
    return base.select("plan_id", "step_idx", F.posexplode(tasks).alias("seq", "t")).select(
        "plan_id", "step_idx", F.col("seq").cast("bigint").alias("seq"), "t.task_type", "t.exposure_s")


def fill_defaults(exposures: DataFrame, defaults: DataFrame, known_mags: DataFrame, strict: bool = True) -> DataFrame:
    """A step's magnification or its plan's default; one without focus settings is an error.

    ``strict=False`` keeps such rows and marks them in ``known``.
    """
    d = defaults.select("plan_id", F.col("exposure_mag").alias("__e"), F.col("correction_mag").alias("__c"))
    out = exposures.join(d, "plan_id").withColumns({
        "exposure_mag": F.coalesce("exposure_mag", "__e"),
        "correction_mag": F.coalesce("correction_mag", "__c")}).drop("__e", "__c")
    for mag in ("exposure_mag", "correction_mag"):
        seen = known_mags.select(F.col("mag").alias(mag)).distinct().withColumn(f"__{mag}", F.lit(True))
        out = out.join(seen, mag, "left")
    known = F.coalesce("__exposure_mag", F.lit(False)) & F.coalesce("__correction_mag", F.lit(False))
    out = out.withColumn("known", known).drop("__exposure_mag", "__correction_mag")
    if not strict:
        return out
    return out.where(F.assert_true(F.col("known"), F.lit("a magnification has no focus settings")).isNull()).drop("known")
