"""Find benchmark items in documents: SimHash of item-sized windows, a multi-index, an exact check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stagelog.llm.common import cut_lineage, fold, let, words

WORDS = 5
BITS, BLOCK_BITS = 128, 8
BLOCKS = BITS // BLOCK_BITS
RADIUS = 2 * BLOCKS - 1  # within it, some block of two fingerprints differs by one bit at most
LANE, LANES = 21, 3  # bit counters packed into one long, of which the highest bit stays free
ONES = 1 | 1 << LANE | 1 << 2 * LANE  # the lowest bit of each lane
SPREAD = 1 | 1 << (LANE - 1) | 1 << 2 * (LANE - 1)  # times this, bits 0, 1 and 2 stand in lanes 0, 1 and 2, among others
PUNCTUATION = ".,;:!?\"'()[]{}"


def tokens(text: Column) -> Column:
    """Words in lower case (A-Z), without ASCII punctuation."""
    return words(F.translate(fold(text), PUNCTUATION, ""))


def shingles(text: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, in order."""
    def runs(h):
        body = F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0)))
        return F.transform(body, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]))

    return let(F.transform(tokens(text), lambda w: F.xxhash64(w)), runs)


def fingerprints(sets: DataFrame, key: list[str], hashes: str) -> DataFrame:
    """128-bit SimHash (``f0, f1``) of each row's hashes; repeated hashes weigh more.

    Bits are counted in packed lanes: one long sums three of them, up to a million hashes a row.  Three bits are
    spread over the lanes, and three majorities gathered again, by one operation each: written out bit by bit, the
    expressions alone took the driver seconds and hundreds of MB.
    """
    def lanes(half: str, first: int) -> Column:
        three = F.shiftrightunsigned(half, first).bitwiseAND(F.lit((1 << LANES) - 1))
        return (three * F.lit(SPREAD)).bitwiseAND(F.lit(ONES))

    rows = sets.select(*key, F.explode(hashes).alias("x")).withColumn("y", F.xxhash64(F.lit(77), "x"))
    starts = range(0, BITS // 2, LANES)
    # a lane's highest bit gets set where its count, raised by this, is more than half of all
    bias = ((F.lit((1 << (LANE - 1)) - 1) - F.shiftright(F.count("*"), 1)) * F.lit(ONES)).alias("bias")
    counted = rows.groupBy(*key).agg(bias, *[F.sum(lanes(h, k)).alias(f"{h}{k}") for h in ("x", "y") for k in starts])

    def half(h: str) -> Column:
        def three(k: int) -> Column:
            flags = F.shiftrightunsigned(F.col(f"{h}{k}") + F.col("bias"), LANE - 1).bitwiseAND(F.lit(ONES))
            return F.shiftleft(flags % F.lit((1 << (LANE - 1)) - 1), k)  # 2**LANE leaves 2: flags come to stand side by side

        return reduce(lambda a, b: a.bitwiseOR(b), [three(k) for k in starts])

    return counted.select(*key, half("x").alias("f0"), half("y").alias("f1"))


def in_blocks(prints: DataFrame, f0: str, f1: str, near: bool) -> DataFrame:
    """Each row once for every (``block``, ``value``) of its fingerprint; with ``near`` also for all values one bit away."""
    values = [F.shiftrightunsigned(half, k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for half in (f0, f1) for k in range(0, BITS // 2, BLOCK_BITS)]
    rows = prints.select("*", F.posexplode(F.array(*values)).alias("block", "value"))
    if not near:
        return rows
    flips = F.array(*[F.lit(f).cast("bigint") for f in (0, *[1 << k for k in range(BLOCK_BITS)])])
    return rows.withColumn("flip", F.explode(flips)).withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")


def overlap(a: Column, b: Column) -> Column:
    """Common hashes of two arrays, each as often as in the array that has fewer."""
    each = F.transform(F.array_intersect(a, b), lambda x: F.least(
        F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", tenths: int = 8,
) -> DataFrame:
    """Documents that contain a benchmark item: ``doc_id, text_key, item_id, start_word, similarity``.

    A document contains an item of n words if some window of n of its words (the whole document, if it
    is shorter) has a weighted Jaccard similarity of ``tenths``/10 or more with it, over shingles of five
    words counted with repetition; items of fewer words are one shingle and must occur whole.  Windows
    that share no shingle with an item of their size have similarity 0 and are left out; equal windows
    are treated once.  Each window's SimHash meets the items' in an index of 16 blocks with one-bit
    neighbours, which finds all pairs within Hamming distance 31; those get the exact check.  (At
    similarity 0.8 the expected distance is 18 with a deviation of 4.)

    Rows are told apart by (``doc_id``, hash of the text), ``text_key``.  Null or empty texts and items
    never match; repeated items match under each of their ids; repeated documents give one row; other
    columns are ignored.
    """
    items = benchmark.select("item_id", F.col(text).alias("t")).withColumn("size", F.size(tokens(F.col("t")))).where("size > 0")
    items = items.withColumn("width", F.least(F.col("size"), F.lit(WORDS)))
    whole = [items.where(F.col("width") == w).select("item_id", "size", "width", shingles(F.col("t"), w).alias("hashes"))
             for w in range(1, WORDS + 1)]
    items = cut_lineage(reduce(DataFrame.unionByName, whole).distinct())
    sizes = cut_lineage(items.select("width", "size", F.explode("hashes").alias("hash")).distinct())
    parts = [_windows(docs, sizes.where(F.col("width") == r["width"]), r["width"], text)
             for r in sizes.select("width").distinct().orderBy("width").collect()]
    if not parts:
        parts = [_windows(docs, sizes, WORDS, text)]
    windows = cut_lineage(reduce(DataFrame.unionByName, parts))

    content = windows.groupBy("size", "c0", "c1").agg(F.first("hashes").alias("hashes"))
    content = cut_lineage(content)
    key = ["size", "c0", "c1"]
    seen = in_blocks(fingerprints(content, key, "hashes"), "f0", "f1", near=False)
    probes = fingerprints(items.select("item_id", "size", "hashes").withColumn("row", F.xxhash64("hashes")), ["item_id", "size", "row"], "hashes")
    probes = cut_lineage(in_blocks(probes.withColumnsRenamed({"f0": "g0", "f1": "g1"}), "g0", "g1", near=True))
    apart = F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("g1")))
    pairs = seen.join(probes, ["size", "block", "value"]).where(apart <= RADIUS).select(*key, "item_id", "row").distinct()
    exact = pairs.join(content, key).join(
        items.select(F.col("item_id").alias("__i"), F.xxhash64("hashes").alias("__r"), F.col("hashes").alias("wanted")),
        F.col("item_id").eqNullSafe(F.col("__i")) & (F.col("row") == F.col("__r")))
    common = overlap(F.col("hashes"), F.col("wanted"))
    exact = exact.withColumn("common", common).withColumn("all", F.size("hashes") + F.size("wanted") - F.col("common"))
    exact = cut_lineage(exact.where(10 * F.col("common") >= tenths * F.col("all")).select(*key, "item_id", (F.col("common") / F.col("all")).alias("similarity")))
    out = windows.drop("hashes").join(exact, key).groupBy("doc_id", "text_key", "item_id").agg(
        F.max("similarity").alias("similarity"), F.max_by("start", F.struct("similarity", -F.col("start"))).alias("start_word"))
    return out.select("doc_id", "text_key", "item_id", F.col("start_word").cast("bigint").alias("start_word"), "similarity")


def _windows(docs: DataFrame, sizes: DataFrame, width: int, text: str) -> DataFrame:
    """All item-sized windows around shared shingles, with their hashes and a 128-bit key of those."""
    base = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.col(text).alias("t")).where("t is not null")
    every = base.select("doc_id", "text_key", F.posexplode(shingles(F.col("t"), width)).alias("pos", "hash"))
    spots = every.join(sizes.select("hash", "size"), "hash").groupBy("doc_id", "text_key", "size").agg(F.collect_set("pos").alias("spots"))
    spots = cut_lineage(spots.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "size", "spots"))
    rows = base.join(spots.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    rows = rows.select("doc_id", "text_key", "size", "spots", shingles(F.col("t"), width).alias("g"))
    last = F.greatest(F.size("g") + (width - 1) - F.col("size"), F.lit(0))
    span = F.transform("spots", lambda p: F.sequence(F.greatest(p - (F.col("size") - width), F.lit(0)), F.least(p, last)))
    rows = rows.withColumn("start", F.explode(F.array_distinct(F.flatten(span))))
    rows = rows.select("doc_id", "text_key", "size", "start", F.slice("g", F.col("start") + 1, F.col("size") - (width - 1)).alias("hashes"))
    return rows.withColumns({"c0": F.xxhash64("hashes"), "c1": F.xxhash64(F.lit(5), "hashes")})


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents that contain no benchmark item, with all their columns."""
    found = cut_lineage(find_leaks(docs, benchmark, text=text).select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k")).distinct())
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64(text) == F.col("__k")), "left_anti")
