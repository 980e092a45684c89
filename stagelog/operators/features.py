"""Ordered features: approach direction, model windows, drift, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagelog.operators.ordered import (
    CHUNK, dense_position, first_by, last_known, previous_row, running_sum, trailing_rows)


def approach_direction(
    df: DataFrame, x: str = "x_target_abs", y: str = "y_target_abs", order: str = "source_index",
    by: tuple[str, ...] = ("run_id",), width: int = CHUNK,
) -> DataFrame:
    """Sign of the move from the previous target per axis; (0, 0) for the first record."""
    out = previous_row(df, list(by), order, {"__px": F.col(x), "__py": F.col(y)}, width=width)

    def sign(now: str, before: str) -> Column:
        return F.coalesce(F.signum(F.col(now) - F.col(before)), F.lit(0)).cast("int")

    return out.withColumns({"dir_x": sign(x, "__px"), "dir_y": sign(y, "__py")}).drop("__px", "__py")


def model_windows(
    steps: DataFrame, window: int, actual_lag: int = 1, by: tuple[str, ...] = ("run_id",),
    width: int = CHUNK,
) -> DataFrame:
    """Full sliding windows ending at each record, relative to their first target.

    Entry *k* pairs the target of a record with the measured position of the
    record ``actual_lag`` before it.  With ``by=("run_id", "part")`` over
    segment rows (J4) no window crosses a segment.
    """
    if actual_lag not in (0, 1):
        raise ValueError("actual_lag is 0 or 1")
    keys = list(by)
    base = dense_position(steps, keys, "source_index", "__pos", width=width)
    d = "double"
    row = F.struct(
        F.col("x_target_abs").cast(d).alias("tx"), F.col("y_target_abs").cast(d).alias("ty"),
        F.col("x_actual_abs").cast(d).alias("ax"), F.col("y_actual_abs").cast(d).alias("ay"))
    span = window + actual_lag
    rows = trailing_rows(base, keys, "__pos", row, span, "__rows", width=width).where(
        F.size("__rows") == span)
    targets = F.slice("__rows", 1 + actual_lag, window)
    actuals = F.slice("__rows", 1, window)
    first = targets[0]
    entry = F.zip_with(targets, actuals, lambda t, a: F.struct(
        (t["tx"] - first["tx"]).alias("tx"), (t["ty"] - first["ty"]).alias("ty"),
        (a["ax"] - first["tx"]).alias("ax"), (a["ay"] - first["ty"]).alias("ay")))
    return rows.select(
        *keys, "source_index", "step", first["tx"].alias("ref_x"), first["ty"].alias("ref_y"),
        F.col("x_target_abs"), F.col("y_target_abs"), F.col("x_actual_abs"), F.col("y_actual_abs"),
        entry.alias("window"))


def accumulate_drift(
    df: DataFrame, mode: str = "accumulate", min_conf: float = 0.0,
    correction: str = "task_type = 'CORRECTION'", by: tuple[str, ...] = ("run_id",), width: int = CHUNK,
) -> DataFrame:
    """E5: drift in force before each row, and the target moved by it.

    ``accumulate`` adds every correction whatever its confidence,
    ``accumulate_gated`` only confident ones, ``replace`` keeps the negated
    latest confident one.
    """
    keys, is_corr = list(by), F.expr(correction)
    sure = is_corr & (F.col("confidence") >= min_conf)
    zero = F.lit(0).cast("bigint")
    if mode == "replace":
        out = last_known(df, keys, "source_index", {
            "__d": F.when(sure, F.struct((-F.col("dx")).alias("x"), (-F.col("dy")).alias("y")))},
            inclusive=False, width=width)
        out = out.withColumns({
            "drift_x": F.coalesce(F.col("__d.x"), zero), "drift_y": F.coalesce(F.col("__d.y"), zero)}).drop("__d")
    elif mode in ("accumulate", "accumulate_gated"):
        gate = is_corr if mode == "accumulate" else sure
        out = running_sum(df, keys, "source_index", {
            "drift_x": F.when(gate, F.col("dx")).otherwise(zero),
            "drift_y": F.when(gate, F.col("dy")).otherwise(zero)}, inclusive=False, width=width)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return out.withColumns({
        "x_drifted": F.col("x_target") + F.col("drift_x"), "y_drifted": F.col("y_target") + F.col("drift_y")})


def running_reference(
    df: DataFrame, x0: Column, y0: Column, update: str = "task_type = 'UPDATE_REFERENCE'",
    by: tuple[str, ...] = ("run_id",), width: int = CHUNK,
) -> DataFrame:
    """Reference position after each row; a reference update moves it by minus the shift."""
    is_update, zero = F.expr(update), F.lit(0).cast("bigint")
    out = running_sum(df, list(by), "source_index", {
        "__sx": F.when(is_update, F.col("dx")).otherwise(zero),
        "__sy": F.when(is_update, F.col("dy")).otherwise(zero)}, width=width)
    return out.withColumns({"ref_x": x0 - F.col("__sx"), "ref_y": y0 - F.col("__sy")}).drop("__sx", "__sy")


def pair_with_reference(
    steps: DataFrame, policy: str = "first", update: str = "task_type = 'UPDATE_REFERENCE'",
    by: tuple[str, ...] = ("run_id", "experiment_name", "iteration"), width: int = CHUNK,
) -> DataFrame:
    """The reference image of every record.

    ``first`` compares with the trajectory's first record, ``latest_update``
    with the latest earlier reference update.
    """
    keys = list(by)
    if policy == "first":
        ref = first_by(steps, keys, "source_index", {
            "ref_index": F.col("source_index"), "ref_img_path": F.col("img_path")})
        out = steps.join(ref, keys)
    elif policy == "latest_update":
        value = F.when(F.expr(update), F.struct("source_index", "img_path"))
        out = last_known(steps, keys, "source_index", {"__r": value}, inclusive=False, width=width)
        out = out.withColumns({"ref_index": F.col("__r.source_index"), "ref_img_path": F.col("__r.img_path")}).drop("__r")
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return out.where(F.col("ref_index") < F.col("source_index"))
