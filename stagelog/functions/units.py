"""Scalar conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagelog.schema import NM_PER_PX

_NUMBER = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def filename(path: Column) -> Column:
    """B1: last path component, either slash style."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def with_filename(df: DataFrame, path: str = "img_path") -> DataFrame:
    return df.withColumn("filename", filename(F.col(path)))


def _number(text: Column, unit: str, number: str = _NUMBER) -> Column:
    return F.nullif(F.regexp_extract(text, rf"^\s*{number}\s*{unit}$", 1), F.lit(""))


def to_nm(text: Column, strict: bool = True) -> Column:
    """``nm`` (integers only), ``um``, ``mm`` to integer nanometres."""
    nm = _number(text, "nm", r"([+-]?\d+)").try_cast("bigint")
    um = F.round(_number(text, "um").try_cast("double") * F.lit(1e3)).cast("bigint")
    mm = F.round(_number(text, "mm").try_cast("double") * F.lit(1e6)).cast("bigint")
    value = F.coalesce(nm, um, mm)
    return _or_error(text, value, "not a length in whole nm, um or mm: ", "bigint", strict)


def to_degrees(text: Column, strict: bool = True) -> Column:
    """``deg`` or ``rad`` to degrees."""
    deg = _number(text, "deg").try_cast("double")
    rad = F.degrees(_number(text, "rad").try_cast("double"))
    return _or_error(text, F.coalesce(deg, rad), "not an angle in deg or rad: ", "double", strict)


def _or_error(text: Column, value: Column, message: str, kind: str, strict: bool) -> Column:
    if not strict:
        return value
    bad = F.raise_error(F.concat(F.lit(message), text)).cast(kind)
    return F.when(text.isNotNull() & value.isNull(), bad).otherwise(value)


def px_to_nm(px: Column, pixel_size: Column | float = NM_PER_PX) -> Column:
    """A drift in pixels to nanometres, halves away from zero."""
    return F.round(px * pixel_size).cast("bigint")


def mosaic_to_nm(px: Column, ref_px: Column, ref_nm: Column, sign: int, nm_per_px: float = NM_PER_PX) -> Column:
    """Mosaic pixel to stage nanometres, halves to even; ``sign`` -1 for x, +1 for y."""
    return F.bround(ref_nm + F.lit(float(sign)) * (px - ref_px) * F.lit(float(nm_per_px))).cast("bigint")


def rotate_move(df: DataFrame, move: str = "move", degrees: str = "r_target") -> DataFrame:
    """Components of a move along an angle, truncated toward zero."""
    angle = F.radians(F.col(degrees))
    return df.withColumns({
        "x_move": (F.col(move) * F.cos(angle)).cast("bigint"),
        "y_move": (F.col(move) * F.sin(angle)).cast("bigint"),
    })


def safe_label(value: Column) -> Column:
    """Integers padded to four digits, other characters outside the safe set become ``_``."""
    text = value.cast("string")
    number = text.try_cast("bigint")
    digits = F.abs(number).cast("string")
    width = F.greatest(F.lit(4) - (number < 0).cast("int"), F.length(digits))
    padded = F.concat(F.when(number < 0, F.lit("-")).otherwise(F.lit("")), F.lpad(digits, width, F.lit("0")))
    return F.when(text.rlike(r"^-?\d+$") & number.isNotNull(), padded).otherwise(
        F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"))


def field_of_view(exposure: DataFrame, correction: DataFrame, keys: list[str]) -> DataFrame:
    """Physical size of both images, their ratio and the masked radius in pixels."""
    e = exposure.select(*keys, *[F.col(c).alias(f"e_{c}") for c in ("pixel_size", "width", "height")])
    c = correction.select(*keys, *[F.col(x).alias(f"c_{x}") for x in ("pixel_size", "width", "height")])
    out = e.join(c, keys)
    size = {
        f"{side}_{axis}_nm": px_to_nm(F.col(f"{side}_{dim}"), F.col(f"{side}_pixel_size"))
        for side in "ec" for axis, dim in (("x", "width"), ("y", "height"))}
    out = out.withColumns(size).withColumns({
        "ratio_x": F.col("e_x_nm") / F.col("c_x_nm"), "ratio_y": F.col("e_y_nm") / F.col("c_y_nm")})
    half_x, half_y = F.col("ratio_x") * F.col("c_width") / 2, F.col("ratio_y") * F.col("c_height") / 2
    return out.withColumn("radius_px", F.sqrt(half_x * half_x + half_y * half_y))
