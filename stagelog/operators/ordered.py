"""Ordered scans that never put a whole run into one task.

A plain ``Window.partitionBy(run)`` sends a run to a single task, which fails
when one run holds a third of the data.  Each function here cuts a run into
chunks of at most ``width`` consecutive order values, scans the chunks
independently, and joins in one carried value per chunk.  The chunk table is
``rows / width`` long, so its own window stays small.  Where order values are
far apart, :func:`row_chunks` cuts by numbers of rows instead.

Rows without a key form a group of their own; rows without an order value come
first.  For that, null keys are filled and marked before rows are dealt out, so
that window and join share one exchange of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from stagelog.session import cut_lineage, release

CHUNK = 1 << 20
_C, _N = "__chunk", "__null"
_FIRST = -(1 << 63)  # chunk of rows without an order value


def chunk_of(order: str, width: int) -> Column:
    return F.expr(f"`{order}` div {int(width)}L")


def _filler(kind: T.DataType) -> Column:
    """Some value of a key's type, for null keys."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.lit(0).cast(kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    raise ValueError(f"a key cannot be of type {kind.simpleString()}")


def _scan(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], width: int, chunk: Column | None,
    within: Callable[[Column, W], Column], of_chunk: Callable[[Column], Column], carry: Callable[[Column, W], Column],
    joined: Callable[[Column, Column], Column], inclusive: bool,
) -> DataFrame:
    """``df`` with, for each of ``values``, what ``joined`` makes of the part in the row's chunk and the part before it."""
    chunk = F.coalesce(chunk_of(order, width), F.lit(_FIRST)) if chunk is None else chunk
    nullable = [k for k in keys if df.schema[k].nullable]
    base = df.withColumns({_C: chunk, **{f"__v_{n}": e for n, e in values.items()}})
    group = list(keys)
    if nullable:
        mark = sum((F.when(F.col(k).isNull(), 1 << n).otherwise(0) for n, k in enumerate(nullable)), F.lit(0))
        base = base.withColumns({_N: mark, **{k: F.coalesce(F.col(k), _filler(df.schema[k].dataType)) for k in nullable}})
        group.append(_N)
    local = W.partitionBy(*group, _C).orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    before = W.partitionBy(*group).orderBy(_C).rowsBetween(W.unboundedPreceding, -1)
    totals = base.groupBy(*group, _C).agg(*[of_chunk(F.col(f"__v_{n}")).alias(f"__t_{n}") for n in values])
    carried = totals.select(*group, _C, *[carry(F.col(f"__t_{n}"), before).alias(f"__c_{n}") for n in values])
    out = base.withColumns({f"__l_{n}": within(F.col(f"__v_{n}"), local) for n in values}).join(carried, [*group, _C])
    out = out.withColumns({n: joined(F.col(f"__l_{n}"), F.col(f"__c_{n}")) for n in values} | {
        k: F.when(F.col(_N).bitwiseAND(F.lit(1 << n)) == 0, F.col(k)) for n, k in enumerate(nullable) if k not in values})
    return out.select(*[c for c in df.columns if c not in values], *values)


def running_sum(
    df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], *,
    inclusive: bool = True, width: int = CHUNK, chunk: Column | None = None,
) -> DataFrame:
    """Add prefix sums of ``sums`` in ``order`` within ``keys``; ``order`` is unique per key."""
    zero = F.lit(0)
    return _scan(
        df, keys, order, sums, width, chunk, lambda v, w: F.coalesce(F.sum(v).over(w), zero), F.sum,
        lambda t, w: F.coalesce(F.sum(t).over(w), zero), lambda here, before: here + before, inclusive)


def dense_position(
    df: DataFrame, keys: list[str], order: str, name: str, *,
    width: int = CHUNK, chunk: Column | None = None,
) -> DataFrame:
    """Add the 0-based rank of each row within ``keys``."""
    return running_sum(df, keys, order, {name: F.lit(1).cast("bigint")}, inclusive=False,
                       width=width, chunk=chunk)


def previous_row(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], *, width: int = CHUNK, chunk: Column | None = None,
) -> DataFrame:
    """Add the values of the preceding row (null for the first row of a key)."""
    row = F.struct(*[e.alias(n) for n, e in values.items()])
    out = last_known(df, keys, order, {"__prev": row}, inclusive=False, width=width, chunk=chunk)
    return out.withColumns({n: F.col("__prev")[n] for n in values}).drop("__prev")


def last_known(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], *,
    inclusive: bool = True, width: int = CHUNK, chunk: Column | None = None,
) -> DataFrame:
    """Add, for each expression, its latest non-null value up to (or before) the row."""
    def latest(v: Column) -> Column:
        return F.max_by(v, F.when(v.isNotNull(), F.struct(order)))

    def before(v: Column, w) -> Column:
        return F.last(v, ignorenulls=True).over(w)

    return _scan(df, keys, order, values, width, chunk, before, latest, before, lambda here, earlier: F.coalesce(here, earlier), inclusive)


def row_chunks(df: DataFrame, keys: list[str], order: str | list[str], name: str, *, rows: int = CHUNK) -> DataFrame:
    """Add a chunk number for ``chunk=``: chunks hold about ``rows`` rows, whatever the order values are.

    Rows are dealt out by sampled ranges of keys and order, each range a chunk, and written once, so that all
    readers see the same chunks.  The order of numbers is that of rows.
    """
    by = [*keys, *([order] if isinstance(order, str) else order)]
    written = cut_lineage(df)
    ranges = max(1, -(-written.count() // rows))
    out = cut_lineage(written.repartitionByRange(ranges, *by).withColumn(name, F.spark_partition_id().cast("bigint")))
    release(written)
    return out


def trailing_rows(
    df: DataFrame, keys: list[str], position: str, row: Column, size: int, name: str, *,
    width: int = CHUNK,
) -> DataFrame:
    """Add an array of the last ``size`` rows up to this one (shorter at the start).

    ``position`` must be dense (0, 1, 2, … per key).  The last ``size - 1`` rows
    of a chunk are repeated at the head of the next one and dropped afterwards.
    """
    width = max(int(width), size)
    home = chunk_of(position, width)
    in_tail = F.pmod(F.col(position), F.lit(width)) >= width - (size - 1)
    base = df.withColumn("__home", home).withColumn(
        _C, F.explode(F.when(in_tail, F.array(F.col("__home"), F.col("__home") + 1))
                      .otherwise(F.array(F.col("__home")))))
    frame = W.partitionBy(*keys, _C).orderBy(position).rowsBetween(-(size - 1), 0)
    out = base.withColumn(name, F.collect_list(row).over(frame))
    return out.where(F.col(_C) == F.col("__home")).drop(_C, "__home")


def first_by(df: DataFrame, keys: list[str], order: str, values: dict[str, Column]) -> DataFrame:
    """One row per key: the values of its first row (map-side combined, no sort)."""
    row = F.struct(*[e.alias(n) for n, e in values.items()])
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("__f")).select(
        *keys, *[F.col("__f")[n].alias(n) for n in values])


def rank_by(df: DataFrame, keys: list[str], order: list[str], name: str, *, start: int = 0) -> DataFrame:
    """Dense rank for order columns of any type; rows with equal ``keys`` + ``order`` get places in a row.

    A range-partitioned sort spreads a large key over many tasks; the sorted
    rows are written once so both passes over them see the same numbering.
    """
    cols = [*keys, *order]
    ids = cut_lineage(df.orderBy(*cols).withColumn("__id", F.monotonically_increasing_id()))
    ranked = dense_position(ids, keys, "__id", name, chunk=F.shiftright("__id", 33)).drop("__id")
    return ranked.withColumn(name, F.col(name) + start)
