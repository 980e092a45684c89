"""Expansion of plan rows into waypoint rows.

A plan becomes numbered pieces of at most ``PIECE`` points, the pieces are
spread over the cluster (they are tiny), and each is exploded in place, so one
plan with most of the points is many tasks' work and no array grows with it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

_BIG = "bigint"
PIECE = 1 << 16
FIELD = (1 << 31) - 1  # a prime
FINISH = (1, 2, 3)  # keys after the last one, which spread its low digits
ANGLE, RADIUS, PICK = 1, 2, 3  # independent numbers of one point


def _numbered(plans: DataFrame, count: Column) -> DataFrame:
    """One row per point of each plan, numbered by ``seq`` from 0; none for a count below one."""
    n, piece = count.cast(_BIG), F.lit(PIECE).cast(_BIG)
    starts = F.sequence(F.lit(0).cast(_BIG), F.col("__n") - 1, piece)
    pieces = plans.withColumn("__n", n).where(F.col("__n") > 0).withColumn("__from", F.explode(starts))
    spread = pieces.repartition("plan_id", "__from")
    last = F.least(F.col("__from") + piece, F.col("__n")) - 1
    return spread.withColumn("seq", F.explode(F.sequence(F.col("__from"), last))).drop("__n", "__from")


def _points(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    return rows.select("plan_id", F.col("seq").cast(_BIG).alias("seq"), x.cast(_BIG).alias("x_nm"), y.cast(_BIG).alias("y_nm"))


def _along(rows: DataFrame, offset: Column) -> DataFrame:
    """Points at ``offset`` from the start along the plan's axis."""
    on_x, zero = F.col("axis") == "x", F.lit(0).cast(_BIG)
    return _points(rows, F.col("x0") + F.when(on_x, offset).otherwise(zero),
                   F.col("y0") + F.when(on_x, zero).otherwise(offset))


def _ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast(_BIG)


def sawtooth(plans: DataFrame) -> DataFrame:
    """n = ceil(range / step) steps out and n back, repeated; overshoots when not divisible."""
    n = _ceil_div(F.col("range_nm"), F.col("step_nm"))
    rows = _numbered(plans.withColumn("__m", n), 2 * n * F.col("reps"))
    phase = F.pmod(F.col("seq"), 2 * F.col("__m"))
    return _along(rows, F.when(phase < F.col("__m"), phase + 1).otherwise(2 * F.col("__m") - phase - 1) * F.col("step_nm"))


def square(plans: DataFrame) -> DataFrame:
    """Four sides of ``n`` points each; a side that ``n`` does not divide is an error."""
    side, n = F.col("range_nm"), F.col("n")
    checked = plans.where(F.assert_true(
        side % n == 0, F.lit("side length must be divisible by points per side")).isNull())
    rows = _numbered(checked, 4 * n)
    leg, d = F.expr("seq div n"), F.pmod(F.col("seq"), n) * F.expr("range_nm div n")
    zero = F.lit(0).cast(_BIG)
    x = F.when(leg == 0, zero).when(leg == 1, d).when(leg == 2, side).otherwise(side - d)
    y = F.when(leg == 0, d).when(leg == 1, side).when(leg == 2, side - d).otherwise(zero)
    return _points(rows, F.col("x0") + x, F.col("y0") + y)


def circle(plans: DataFrame) -> DataFrame:
    """N + 1 points, the first repeated at the end; offsets truncated toward zero."""
    turn = F.when(F.coalesce(F.col("clockwise"), F.lit(False)), -1.0).otherwise(1.0)
    angle = turn * (2.0 * math.pi * F.col("seq") / F.col("n"))
    return _points(_numbered(plans, F.col("n") + 1), F.col("x0") + (F.col("radius_nm") * F.cos(angle)).cast(_BIG),
                   F.col("y0") + (F.col("radius_nm") * F.sin(angle)).cast(_BIG))


def mixed(keys: list[Column]) -> Column:
    """A whole number within [0, ``FIELD``) that depends on all ``keys`` (null counts as 0).

    Each key is added to the state and the sum raised to the fifth power modulo the prime ``FIELD``, which
    permutes the field since 5 does not divide ``FIELD`` - 1.  Products stay below 2**62, so any engine with
    64-bit integers gives the same number.
    """
    def fifth(state: Column, key: Column) -> Column:
        a = (state + key) % FIELD
        square = a * a % FIELD
        return square * square % FIELD * a % FIELD

    halves = [h for k in keys for h in (F.pmod(k, F.lit(FIELD)), F.pmod(F.call_function("div", k, F.lit(FIELD)), F.lit(FIELD)))]
    return F.aggregate(F.array(*[F.coalesce(h, F.lit(0).cast(_BIG)) for h in halves], *[F.lit(c).cast(_BIG) for c in FINISH]),
                       F.lit(0).cast(_BIG), fifth)


def _uniform(seed: int, salt: int) -> Column:
    """A reproducible number in [0, 1) for each (plan, seq), from the plan's number or, for other types, a hash of it."""
    plan = F.expr("CASE WHEN typeof(plan_id) IN ('tinyint', 'smallint', 'int', 'bigint') THEN try_cast(plan_id AS bigint) ELSE xxhash64(plan_id) END")
    return mixed([F.lit(seed).cast(_BIG), F.lit(salt).cast(_BIG), plan, F.col("seq").cast(_BIG)]).cast("double") / F.lit(float(FIELD))


def random_walk(plans: DataFrame, seed: int = 0, min_radius: int = 0) -> DataFrame:
    """I4: the start, then ``n`` independent jumps around it, radius uniform in [min_radius, radius_nm]."""
    angle = _uniform(seed, ANGLE) * 2.0 * math.pi
    length = F.lit(float(min_radius)) + _uniform(seed, RADIUS) * (F.col("radius_nm") - min_radius)
    moved, zero = F.col("seq") > 0, F.lit(0).cast(_BIG)
    return _points(_numbered(plans, F.col("n") + 1),
                   F.col("x0") + F.when(moved, (length * F.cos(angle)).cast(_BIG)).otherwise(zero),
                   F.col("y0") + F.when(moved, (length * F.sin(angle)).cast(_BIG)).otherwise(zero))


def poi_jumps(plans: DataFrame, seed: int = 0) -> DataFrame:
    """``n`` random picks from the plan's ``points`` (array of x, y structs)."""
    pick = F.floor(_uniform(seed, PICK) * F.size("points")).cast("int")
    rows = _numbered(plans, F.col("n")).withColumn("__p", F.get("points", pick))
    return _points(rows, F.col("__p.x"), F.col("__p.y"))


def major_minor(plans: DataFrame) -> DataFrame:
    """For each (major, minor) pair, out to +major, down past -major, back to the start.

    Column ``first_offset`` (optional) lengthens the first pair's way out.
    """
    zero = F.lit(0).cast(_BIG)
    offset = F.coalesce(F.col("first_offset"), zero) if "first_offset" in plans.columns else zero

    def legs(pair: Column, number: Column) -> Column:
        major, minor = pair["major"], pair["minor"]
        up = F.greatest(zero, _ceil_div(major + F.when(number == 0, offset).otherwise(zero), minor))
        low = F.least(up, -_ceil_div(major, minor))
        count = up + (up - low) + F.greatest(zero, -low)
        return F.struct(minor.cast(_BIG).alias("minor"), up.alias("up"), low.alias("low"), count.alias("count"))

    loops = plans.withColumn("__legs", F.transform("pairs", legs))
    before = F.aggregate(F.slice("__legs", F.lit(1), F.col("__k")), zero, lambda a, leg: a + leg["count"])
    numbered = loops.select("plan_id", "axis", "x0", "y0", "__legs", F.posexplode("__legs").alias("__k", "__leg")).select(
        "plan_id", "axis", "x0", "y0", before.alias("__before"),
        *[F.col("__leg")[c].alias(f"__{c}") for c in ("minor", "up", "low", "count")])
    rows = _numbered(numbered, F.col("__count"))
    t, up, low = F.col("seq"), F.col("__up"), F.col("__low")
    down = up - low
    place = F.when(t < up, t + 1).when(t < up + down, up - (t - up) - 1).otherwise(low + (t - up - down) + 1)
    out = rows.withColumn("__o", place * F.col("__minor")).withColumn("seq", t + F.col("__before"))
    return _along(out, F.col("__o"))


def loop_warmup(plans: DataFrame) -> DataFrame:
    """One step of ``range_nm`` back along the axis, forward when ``reset``."""
    d = F.when(F.coalesce(F.col("reset"), F.lit(False)), F.col("range_nm")).otherwise(-F.col("range_nm"))
    return _along(plans.withColumn("seq", F.lit(0)), d)


def spiral_warmup(plans: DataFrame, radius_start: int = 2000, radius_end: int = 3000) -> DataFrame:
    """I8: ``n`` points (at least 2) over two turns with linearly changing radius, truncated."""
    n, t = F.col("n"), F.col("seq")
    checked = plans.where(F.assert_true(n >= 2, F.lit("a spiral needs at least two points")).isNull())
    angle = t / n * (4.0 * math.pi)
    radius = F.lit(float(radius_start)) + F.lit(float(radius_end - radius_start)) * (t / (n - 1))
    return _points(_numbered(checked, n), F.col("x0") + radius * F.cos(angle), F.col("y0") + radius * F.sin(angle))


def linear_warmup(plans: DataFrame, distance: int = 3000, sign_x: int = 1, sign_y: int = -1) -> DataFrame:
    """``n`` points ending exactly at the start point; only that point for n <= 1.

    The later logs approach from (+x, -y) over 3000 nm, the earlier ones from
    (-x, +y) over 2000 nm.
    """
    n = F.greatest(F.col("n"), F.lit(1))
    left = F.when(n > 1, F.lit(1.0) - F.try_divide(F.col("seq"), n - 1)).otherwise(0.0)
    return _points(_numbered(plans, n), F.col("x0") + F.lit(float(sign_x * distance)) * left,
                   F.col("y0") + F.lit(float(sign_y * distance)) * left)


def angle_grid(plans: DataFrame) -> DataFrame:
    """Every angle, then every x, then every y of the plan's lists."""
    by_angle = plans.select("plan_id", F.posexplode("angles").alias("angle_no", "r_target"), "xs", "ys")
    by_x = by_angle.select("plan_id", "angle_no", "r_target", F.posexplode("xs").alias("x_no", "x_nm"), "ys")
    by_y = by_x.select("plan_id", "angle_no", "x_no", "r_target", "x_nm", F.posexplode("ys").alias("y_no", "y_nm"))
    whole = ("angle_no", "x_no", "y_no", "x_nm", "y_nm")
    return by_y.select("plan_id", "r_target", *[F.col(c).cast(_BIG).alias(c) for c in whole])


def stepwise_lines(plans: DataFrame) -> DataFrame:
    """A start and a list of further offsets along the axis, one task per point."""
    stops = F.concat(F.array(F.col("start").cast(_BIG)), F.col("offsets").cast("array<bigint>"))
    rows = plans.select("plan_id", "axis", "x0", "y0", F.posexplode(stops).alias("seq", "__o"))
    return _along(rows, F.col("__o"))


def step_out_and_back(plans: DataFrame) -> DataFrame:
    """``n`` steps out, ``n`` back and a final row at the start (2n + 1 rows).

    ``x_move`` and ``y_move`` are one step's components (see ``rotate_move``).
    """
    n, t = F.col("n"), F.col("seq")
    k = F.when(t < n, t + 1).when(t < 2 * n, 2 * n - t - 1).otherwise(0)
    rows = _numbered(plans, 2 * n + 1)
    step = F.when(t == 2 * n, "final").otherwise(t.cast("string"))
    return rows.select(
        "plan_id", "seq", step.alias("step"), (F.col("x0") + F.col("x_move") * k).cast(_BIG).alias("x_nm"),
        (F.col("y0") + F.col("y_move") * k).cast(_BIG).alias("y_nm"))


def candidate_grid(spark, lo: int = -50, hi: int = 50, step_nm: int = 100) -> DataFrame:
    """Command offsets, x outer, upper bound exclusive; ``ord`` is the search order."""
    n = hi - lo
    return spark.range(n * n).select(
        F.col("id").alias("ord"), ((F.expr(f"id div {n}") + lo) * step_nm).alias("ox"),
        ((F.col("id") % n + lo) * step_nm).alias("oy"))


KINDS = {
    "sawtooth": sawtooth, "square": square, "circle": circle, "random_walk": random_walk, "poi": poi_jumps,
    "major_minor": major_minor, "loop_warmup": loop_warmup, "spiral_warmup": spiral_warmup,
    "linear_warmup": linear_warmup, "lines": stepwise_lines, "out_and_back": step_out_and_back,
}


def expand_plans(plans: DataFrame, kind: str, **options) -> DataFrame:
    """Waypoints of every plan row of one kind."""
    return KINDS[kind](plans, **options)
