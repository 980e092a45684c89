"""Collapse cumulative conversation snapshots, then render what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stagelog.llm.common import cut_lineage

SPAN = 1024  # turn numbers scanned together, and turns rendered into one part
_LANE = (1 << 42) - 1


def _lanes(*columns: Column) -> list[Column]:
    """Two hashes of 42 bits: sums of up to two million of them stay within a long."""
    return [F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit(_LANE)) for seed in (11, 97)]


def turns(chats: DataFrame) -> DataFrame:
    """Distinct turns with their ``position`` and the rolling hash ``h1, h2, n`` of the prefix that ends there.

    The rolling hash is a running sum of hashes of (position, role, text).  A conversation is scanned in
    spans of ``SPAN`` turn numbers, and totals of earlier spans are carried in, so a conversation with a
    large share of all rows is spread over tasks.
    """
    one = F.lit(1).cast("bigint")
    base = chats.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).distinct()
    base = base.withColumn("span", F.coalesce(F.expr(f"`turn` div {SPAN}L"), F.lit(-(1 << 62))))
    base = cut_lineage(base)
    local = W.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    earlier = W.partitionBy("conv_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)

    def carried(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
        spans = df.groupBy("conv_id", "span").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
        return spans.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), *[
            F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in sums])

    def scan(df: DataFrame, sums: dict[str, Column], names: list[str]) -> DataFrame:
        upto = local.rowsBetween(W.unboundedPreceding, 0)
        out = df.withColumns({n: F.sum(e).over(upto) for n, e in sums.items()})
        right = carried(df, sums)
        out = out.join(right, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s")))
        return out.withColumns({n: F.col(n) + F.col(f"before_{n}") for n in sums}).select(*names, *sums)

    names = ["conv_id", "span", "turn", "role", "text"]
    numbered = scan(base, {"n": one}, names)
    h1, h2 = _lanes(F.col("n"), F.col("role"), F.col("text"))
    hashed = cut_lineage(numbered.withColumns({"g1": h1, "g2": h2}))
    return scan(hashed, {"h1": F.col("g1"), "h2": F.col("g2")}, [*names, "n"]).withColumn("position", F.col("n") - 1)


def maximal(scanned: DataFrame) -> DataFrame:
    """``conv_id`` (and its number of turns) of conversations that are a prefix of no longer one.

    Of equal conversations the smallest ``conv_id`` stays (a null id only if there is no other).
    """
    key = ["n", "h1", "h2"]
    last = scanned.groupBy("conv_id").agg(F.max_by(F.struct(*key), "n").alias("k")).select("conv_id", "k.*")
    whole = last.groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    ends = last.select(F.col("conv_id").alias("c"), F.col("n").alias("total"))
    inner = scanned.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).where("n < total").groupBy(*key).agg(F.lit(1).alias("one"))
    return whole.join(inner, key, "left_anti")


def collapse_and_render(chats: DataFrame, *, turn_format: str = "<|im_start|>%s\n%s<|im_end|>\n") -> DataFrame:
    """Maximal conversations as text: ``conv_id, part, n_turns, rendered``.

    A conversation logged again after each turn leaves rows in which one is a prefix of another; only
    those that nothing extends stay, found by anti-joining whole-conversation hashes with the prefix
    hashes of all others (84 bits).  Turns are ordered by (turn, null first; role; text); fully
    repeated rows count once; a null role renders as ``unknown``, a null text as empty; rows with a null
    ``conv_id`` form one conversation.  Conversations of more than ``SPAN`` turns come in several parts,
    so no row grows without bound.  Other columns are ignored.  An empty table gives an empty result.
    """
    scanned = cut_lineage(turns(chats))
    keep = cut_lineage(maximal(scanned)).select(F.col("conv_id").alias("c"))
    rows = scanned.join(keep, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    line = F.struct("position", F.format_string(turn_format, "role", "text").alias("line"))
    return rows.groupBy("conv_id", F.expr(f"position div {SPAN}L").alias("part")).agg(
        F.count("*").alias("n_turns"), F.array_sort(F.collect_list(line)).alias("lines")).select(
        "conv_id", "part", "n_turns", F.array_join(F.col("lines.line"), "").alias("rendered"))


SQL = f"""WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS position FROM t),
c AS (SELECT conv_id, list({{'r': role, 'x': text}} ORDER BY position) AS turns, count(*) AS n FROM p GROUP BY conv_id),
prefixes AS (
  SELECT DISTINCT turns[1:k] AS head FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)),
kept AS (
  SELECT min(conv_id) AS conv_id FROM c
  WHERE NOT EXISTS (SELECT 1 FROM prefixes WHERE prefixes.head = c.turns) GROUP BY turns)
SELECT p.conv_id, p.position // {SPAN} AS part, count(*) AS n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY position) AS rendered
FROM p JOIN kept ON p.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY p.conv_id, p.position // {SPAN}"""
