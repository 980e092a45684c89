"""Position attachment, recalculation and agreement statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagelog.functions.rows import distance, placement_name
from stagelog.functions.units import mosaic_to_nm, with_filename
from stagelog.operators.ordered import CHUNK, dense_position, first_by, previous_row, rank_by
from stagelog.operators.quantiles import exact_percentiles
from stagelog.schema import CANVAS_MARGIN_PX, MAX_CORRECTION_NM, NM_PER_PX
from stagelog.session import cut_lineage


def sample_steps(df: DataFrame, stride: int = 1, limit: int = 0) -> DataFrame:
    """Every ``stride``-th record, then the first ``limit`` of them (0 = all)."""
    out = df.where(F.col("source_index") % stride == 0)
    return out.where(F.col("source_index") < limit * stride) if limit > 0 else out


def attach_positions(steps: DataFrame, positions: DataFrame) -> DataFrame:
    """Add the mosaic position by file name; unmatched records keep nulls.

    A file name listed twice keeps its last entry.
    """
    value = F.struct("x", "y", "w", "h", "confidence")
    last = positions.groupBy("run_id", "filename").agg(F.max_by(value, "entry").alias("position"))
    base = steps if "filename" in steps.columns else with_filename(steps)
    return base.drop("position_confidence").join(last, ["run_id", "filename"], "left").withColumn(
        "position_confidence", F.col("position.confidence"))


def recalculate_positions(
    steps: DataFrame, positions: DataFrame, ref_step: int = 0, nm_per_px: float = NM_PER_PX,
    missing_reference: str = "error", by: tuple[str, ...] = ("run_id",),
) -> DataFrame:
    """C1 + C2 + B5: re-derive actual positions from the mosaic; adds ``updated``.

    The reference is each run's first record with ``step = ref_step``.  A run
    without one, or whose reference image has no position, is an error, or is
    left out with ``missing_reference="drop"``, or keeps its positions with
    ``updated`` false with ``missing_reference="keep"``.  A log of several trajectories,
    each with its own reference, is divided with ``by``.
    """
    joined = attach_positions(steps, positions)
    is_ref = F.col("step") == ref_step
    order = F.when(is_ref, F.col("source_index"))
    ref = joined.groupBy(*by).agg(
        F.count_if(is_ref).alias("__refs"),
        F.min_by(F.struct("x_target_abs", "y_target_abs", "position"), order).alias("__ref"))
    located = (F.col("__refs") > 0) & F.col("__ref.position").isNotNull()
    if missing_reference == "error":
        located = F.assert_true(
            located, F.concat(F.lit("no located reference record in run "), F.col("run_id"))).isNull()
    out = joined.join(ref if missing_reference == "keep" else ref.where(located), list(by))
    px, rpx = F.col("position"), F.col("__ref.position")
    new_x = mosaic_to_nm(px["x"], rpx["x"], F.col("__ref.x_target_abs"), -1, nm_per_px)
    new_y = mosaic_to_nm(px["y"], rpx["y"], F.col("__ref.y_target_abs"), 1, nm_per_px)
    return out.withColumns({
        "updated": px.isNotNull() & rpx.isNotNull(),
        "x_actual_abs": F.coalesce(new_x, "x_actual_abs"),
        "y_actual_abs": F.coalesce(new_y, "y_actual_abs"),
    }).drop("__refs", "__ref")


def update_counts(df: DataFrame) -> DataFrame:
    """Updated and skipped records per run."""
    return df.groupBy("run_id").agg(
        F.count_if("updated").alias("updated"), F.count_if(~F.col("updated")).alias("skipped"))


def _pearson(a: Column, b: Column) -> Column:
    scale = F.stddev_pop(a) * F.stddev_pop(b)
    return F.coalesce(F.try_divide(F.covar_pop(a, b), scale), F.lit(0.0))


def agreement_report(df: DataFrame, ref_step: int = 0, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """One row per run comparing commanded and measured displacement from the reference.

    Reference rows do not count; rows whose position was not updated do.  A run
    with at most one counted row, or without a reference, is ``INSUFFICIENT``.
    """
    d = "double"
    is_ref = F.col("step").eqNullSafe(ref_step)
    ref = first_by(df.where(is_ref), list(by), "source_index", {
        "__rx": F.col("x_target_abs"), "__ry": F.col("y_target_abs")})
    rows = df.join(ref, list(by), "left")
    delta = {
        f"__{kind}{axis}": F.when(~is_ref, (F.col(f"{axis}_{name}_abs") - F.col(f"__r{axis}")).cast(d))
        for axis in "xy" for kind, name in (("t", "target"), ("a", "actual"))}
    rows = rows.withColumns(delta)
    per_axis = []
    for axis in "xy":
        t, a = F.col(f"__t{axis}"), F.col(f"__a{axis}")
        per_axis += [F.count_if(t * a > 0).alias(f"{axis}_agree"), _pearson(t, a).alias(f"{axis}_r"),
                     F.avg(F.abs(t - a)).alias(f"{axis}_mae")]
    stats = rows.groupBy(*by).agg(F.count("__tx").alias("n"), *per_axis)
    return stats.withColumns({
        "x_agree_pct": F.try_divide(100.0 * F.col("x_agree"), F.col("n")),
        "y_agree_pct": F.try_divide(100.0 * F.col("y_agree"), F.col("n")),
        "verdict": verdict(),
    })


def verdict() -> Column:
    return (
        F.when(F.col("n") <= 1, "INSUFFICIENT")
        .when((F.col("x_r") < 0.3) | (F.col("y_r") < 0.3), "LOW")
        .when((F.col("x_r") > 0.8) & (F.col("y_r") > 0.8), "GOOD")
        .otherwise("MODERATE"))


def split_by_image(steps: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records whose image is present, and those whose image is absent."""
    names = tiles.select("run_id", "filename")
    base = steps if "filename" in steps.columns else with_filename(steps)
    return base.join(names, ["run_id", "filename"], "left_semi"), base.join(
        names, ["run_id", "filename"], "left_anti")


def layout_px(
    steps: DataFrame, images: DataFrame | None = None, nm_per_px: float = NM_PER_PX, width: int = CHUNK,
) -> DataFrame:
    """Commanded layout in pixels relative to the run's first record, image or not.

    ``tile_id`` numbers the records whose image is present.
    """
    anchor = first_by(steps, ["run_id"], "source_index", {
        "__ax": F.col("x_target_abs"), "__ay": F.col("y_target_abs")})
    kept = split_by_image(steps, images)[0] if images is not None else steps
    out = kept.join(anchor, "run_id").withColumns({
        "x_px": -(F.col("x_target_abs") - F.col("__ax")).cast("double") / nm_per_px,
        "y_px": (F.col("y_target_abs") - F.col("__ay")).cast("double") / nm_per_px,
    }).drop("__ax", "__ay")
    return dense_position(out, ["run_id"], "source_index", "tile_id", width=width)


def confidence_profile(df: DataFrame, column: str = "position_confidence", bins: int = 10,
                       threshold: float = 0.8) -> DataFrame:
    """Histogram of a confidence over [0, 1] with the count below a threshold per bin."""
    value = F.col(column)
    bucket = F.width_bucket(value, F.lit(0.0), F.lit(1.0), F.lit(bins)).cast("bigint")
    return df.where(value.isNotNull()).groupBy("run_id", bucket.alias("bin")).agg(
        F.count("*").alias("records"), F.count_if(value < threshold).alias("below"))


def backlash_summary(df: DataFrame) -> DataFrame:
    """Return-to-home residual by direction and position."""
    dist = distance(F.col("dx_measured").cast("double"), F.col("dy_measured").cast("double"))
    return df.groupBy("r_target", "x_target", "y_target").agg(
        F.count("*").alias("tasks"), F.avg("dx_measured").alias("dx_mean"),
        F.avg("dy_measured").alias("dy_mean"), F.avg(dist).alias("residual_mean"),
        F.max(dist).alias("residual_max"))


def cadence(df: DataFrame, slow_s: float = 10.0, time: str = "event_time", width: int = CHUNK) -> DataFrame:
    """Seconds since the previous record of the run and a slow-record flag."""
    seconds = F.unix_micros(F.col(time)) / F.lit(1e6) if dict(df.dtypes)[time] != "double" else F.col(time)
    base = df.withColumn("__t", seconds)
    out = previous_row(base, ["run_id"], "source_index", {"__p": F.col("__t")}, width=width)
    gap = F.col("__t") - F.col("__p")
    return out.withColumns({"gap_s": gap, "slow": F.coalesce(gap > slow_s, F.lit(False))}).drop("__t", "__p")


def residual_summary(df: DataFrame, column: str = "residual", by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Median and 90th percentile, exact with linear interpolation."""
    return exact_percentiles(df, list(by), column, {"median": 0.5, "p90": 0.9})


def correction_summary(poses: DataFrame, targets: DataFrame, nm_per_px: float = NM_PER_PX, limit_nm: float = MAX_CORRECTION_NM) -> DataFrame:
    """How far placed tiles lie from their commanded places: per run ``tiles``, ``median_nm``, ``p90_nm``, ``max_nm``, ``beyond`` (over ``limit_nm``).

    Tiles without a pose or a commanded place (or a null one) do not count; a run without any has no row.
    """
    at = targets.select("run_id", "tile_id", F.col("x").alias("__x"), F.col("y").alias("__y"))
    moved = cut_lineage(poses.select("run_id", "tile_id", "x", "y").join(at, ["run_id", "tile_id"]).select(
        "run_id", (distance(F.col("x") - F.col("__x"), F.col("y") - F.col("__y")) * nm_per_px).alias("moved_nm")).where("moved_nm is not null"))
    totals = moved.groupBy("run_id").agg(F.count("*").alias("tiles"), F.max("moved_nm").alias("max_nm"), F.count_if(F.col("moved_nm") > limit_nm).alias("beyond"))
    return totals.join(exact_percentiles(moved, ["run_id"], "moved_nm", {"median_nm": 0.5, "p90_nm": 0.9}), "run_id")


def shape_report(images: DataFrame, by: tuple[str, ...] = ("run_id",), width: str = "w", height: str = "h") -> DataFrame:
    """Whether all images of a run have one shape: ``images``, ``shapes``, the commonest shape (``width``, ``height``; ties: the smaller), ``others`` (images of another shape), ``uniform``.

    Images are counted by shape first, so a run's rows do not meet in one task.  An image without a width
    or height has a shape of its own, which is never the commonest unless no other is there.
    """
    shapes = images.groupBy(*by, F.col(width).alias("__w"), F.col(height).alias("__h")).agg(F.count("*").alias("__n"))
    known = F.col("__w").isNotNull() & F.col("__h").isNotNull()
    best = F.max_by(F.struct("__w", "__h", "__n"), F.struct(known.alias("k"), F.col("__n").alias("n"), (-F.col("__w")).alias("w"), (-F.col("__h")).alias("h")))
    found = shapes.groupBy(*by).agg(F.sum("__n").alias("images"), F.count("*").alias("shapes"), best.alias("__b"))
    return found.select(*by, "images", "shapes", F.col("__b.__w").alias("width"), F.col("__b.__h").alias("height"),
                        (F.col("images") - F.col("__b.__n")).alias("others"), (F.col("shapes") == 1).alias("uniform"))


def canvas_extent(poses: DataFrame, w: int, h: int, margin: int = CANVAS_MARGIN_PX,
                  by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Integer bounds of all poses and the canvas they need."""
    lo_x, lo_y = F.floor(F.min("x")), F.floor(F.min("y"))
    hi_x, hi_y = F.ceil(F.max("x")), F.ceil(F.max("y"))
    return poses.groupBy(*by).agg(
        lo_x.alias("min_x"), lo_y.alias("min_y"), hi_x.alias("max_x"), hi_y.alias("max_y"),
        (hi_x - lo_x + w + 2 * margin).alias("canvas_w"), (hi_y - lo_y + h + 2 * margin).alias("canvas_h"),
    )


def number_placements(positions: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Number position entries by file name and build their output names."""
    ranked = rank_by(positions, ["run_id"], ["filename"], "ordinal", start=1)
    exact = F.col("confidence")
    status = F.when(exact >= threshold, "OK").otherwise("LOW")
    return ranked.withColumn("status", status).withColumn(
        "output_name", placement_name(F.col("ordinal"), F.col("status"), exact, F.col("filename")))
