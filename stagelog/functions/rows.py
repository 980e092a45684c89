"""Row-wise flags and geometry (B2, B8–B12, G6 helpers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagelog.schema import LOW_CONFIDENCE, MATCH_THRESHOLD, MIN_OVERLAP_PX


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def normalise_steps(df: DataFrame) -> DataFrame:
    """B2: text ``step`` to a number plus a final-row flag, text confidence to a number."""
    return df.withColumns({
        "is_final": F.col("step").isNotNull() & F.col("step").try_cast("bigint").isNull(),
        "step": F.col("step").try_cast("bigint"),
        "confidence": F.col("confidence").try_cast("double"),
    })


def position_error(df: DataFrame) -> DataFrame:
    """Target minus actual per axis and its length."""
    ex = F.col("x_target_abs") - F.col("x_actual_abs")
    ey = F.col("y_target_abs") - F.col("y_actual_abs")
    return df.withColumns({
        "x_error": ex, "y_error": ey,
        "error_nm": distance(ex.cast("double"), ey.cast("double")),
    })


def match_status(df: DataFrame, threshold: float = MATCH_THRESHOLD, column: str = "confidence") -> DataFrame:
    """``OK`` at or above the threshold, else ``LOW``; confidence to four decimals."""
    return df.withColumns({
        "status": F.when(F.col(column) >= threshold, "OK").otherwise("LOW"),
        column: F.round(column, 4),
    })


def flag_quality(
    df: DataFrame, low: float = LOW_CONFIDENCE, min_conf: float | None = None, column: str = "confidence",
) -> DataFrame:
    """The logger's low-confidence flag and the control loop's bad-measurement flag."""
    out = df.withColumn("low_confidence", F.col(column) < low)
    if min_conf is not None:
        out = out.withColumn("bad_measurement", F.col(column) < min_conf)
    return out


def gate_command(df: DataFrame, limit_nm: float) -> DataFrame:
    """Keep the wanted target where the predicted error exceeds the limit."""
    over = F.col("error_nm") > limit_nm
    return df.withColumns({
        "compensated": ~over,
        "x_command": F.when(over, F.col("x_target")).otherwise(F.col("x_command")),
        "y_command": F.when(over, F.col("y_target")).otherwise(F.col("y_command")),
    })


def overlaps(dx: Column, dy: Column, w: int, h: int, min_overlap: int = MIN_OVERLAP_PX) -> Column:
    """Both overlap sides are at least ``min_overlap`` pixels."""
    return (F.lit(w) - F.abs(dx) >= min_overlap) & (F.lit(h) - F.abs(dy) >= min_overlap)


def predicted_overlap(df: DataFrame, w: int, h: int) -> DataFrame:
    """The overlap rectangle in the newer tile's own pixels for a shift (dx, dy)."""
    dx, dy, zero = F.col("dx"), F.col("dy"), F.lit(0.0)
    return df.withColumns({
        "x1": F.greatest(zero, -dx), "x2": F.least(F.lit(float(w)), F.lit(float(w)) - dx),
        "y1": F.greatest(zero, -dy), "y2": F.least(F.lit(float(h)), F.lit(float(h)) - dy),
    })


def clip_placement(
    df: DataFrame, canvas_w: int, canvas_h: int, min_confidence: float = 0.0,
) -> DataFrame:
    """Destination and source rectangles clipped to the canvas; empty ones dropped."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    zero = F.lit(0).cast("bigint")
    out = df.where(F.col("confidence") >= min_confidence) if min_confidence > 0 else df
    out = out.withColumns({
        "dst_x1": F.greatest(zero, x), "dst_y1": F.greatest(zero, y),
        "dst_x2": F.least(F.lit(canvas_w).cast("bigint"), x + w),
        "dst_y2": F.least(F.lit(canvas_h).cast("bigint"), y + h),
    }).where((F.col("dst_x1") < F.col("dst_x2")) & (F.col("dst_y1") < F.col("dst_y2")))
    return out.withColumns({
        "src_x1": F.col("dst_x1") - x, "src_y1": F.col("dst_y1") - y,
        "src_x2": F.col("dst_x2") - x, "src_y2": F.col("dst_y2") - y,
    })


def placement_name(order: Column, status: Column, confidence: Column, name: Column) -> Column:
    """Output name of a placed tile: number, status, confidence and file stem."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.format_string("%04d_%s_%.4f_%s", order, status, confidence, stem)
