"""Exact percentiles without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], *, accuracy: int = 10_000,
    many_keys: bool = False,
) -> DataFrame:
    """Linear-interpolated exact percentiles per key.

    A mergeable sketch brackets each wanted rank; values outside the bracket are
    only counted, and the few distinct values inside are ranked exactly.  Groups
    of at most ``accuracy`` values use their full range.  With ``many_keys`` the
    brackets, one row a key, are never broadcast.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    margin = 5.0 / accuracy
    names = list(probs)
    edges = [min(1.0, max(0.0, probs[n] + s * margin)) for n in names for s in (-1, 1)]
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        F.percentile_approx("__v", edges, accuracy).alias("__b"))
    small = F.col("__n") <= accuracy
    wanted = F.array(*[
        F.struct(
            F.lit(n).alias("name"),
            (F.lit(float(probs[n])) * (F.col("__n") - 1)).alias("rank"),
            F.when(small, F.col("__min")).otherwise(F.col("__b")[2 * k]).alias("lo"),
            F.when(small, F.col("__max")).otherwise(F.col("__b")[2 * k + 1]).alias("hi"),
        ) for k, n in enumerate(names)])
    brackets = stats.select(*keys, wanted.alias("__w"))
    brackets = brackets.hint("merge") if many_keys else brackets
    hits = (
        rows.join(brackets, keys)
        .select(*keys, "__v", F.explode("__w").alias("__w"))
        .where(F.col("__v") <= F.col("__w.hi"))
        .groupBy(*keys, "__w.name", "__w.rank",
                 F.when(F.col("__v") >= F.col("__w.lo"), F.col("__v")).alias("__v"))
        .agg(F.count("*").alias("__k"))
    )
    upto = W.partitionBy(*keys, "name").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(
        W.unboundedPreceding, 0)
    ranked = hits.withColumn("__end", F.sum("__k").over(upto))
    below, above = F.floor("rank"), F.ceil("rank")

    def at(index):
        here = (F.col("__end") - F.col("__k") <= index) & (index < F.col("__end"))
        return F.max(F.when(here, F.col("__v")))

    per_name = ranked.groupBy(*keys, "name", "rank").agg(at(below).alias("lo"), at(above).alias("hi"))
    exact = F.when(
        F.col("lo").isNull() | F.col("hi").isNull(),
        F.raise_error(F.lit("percentile bracket missed its rank")).cast("double"),
    ).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("rank") - F.floor("rank")))
    return per_name.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == n, exact)).alias(n) for n in names])
