"""Mix sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stagelog.llm.common import cut_lineage, let, numbered, release, words

CAP = 3
DIGIT, LEVELS = 13, 4  # ranks are whole numbers of 52 bits, searched 13 bits at a time
LAST = (1 << 52) - 1


def water_level(sources: DataFrame, total: int) -> tuple[int, int]:
    """(a, b) so that a source gets least(CAP * size, a / b * weight) and all together get ``total``.

    Each round caps the sources above their limit and shares the rest anew by weight.  The level only
    rises, so the capped set only grows and the rounds end.
    """
    a, b, capped = 0, 1, -1
    while True:
        over = (F.lit(CAP) * F.col("source_size") * F.lit(b)) < (F.lit(a) * F.col("weight"))
        row = sources.agg(
            F.sum(F.when(over, F.lit(CAP) * F.col("source_size"))).alias("used"), F.sum(F.when(~over, F.col("weight"))).alias("w"),
            F.count(F.when(over, 1)).alias("n")).first()
        if row["n"] == capped or not row["w"]:
            return a, b
        a, b, capped = total - (row["used"] or 0), row["w"], row["n"]


def uniform(*columns: Column | str) -> Column:
    """A reproducible number of 52 bits within (0, 1) from the row's own values."""
    return (F.xxhash64(*columns).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


def variety(text: Column) -> Column:
    """The share of distinct words among the words of ``text``, 0 without words."""
    return let(words(text), lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0)))


def with_copy_numbers(rows: DataFrame, key: str) -> DataFrame:
    """Add ``__copy``: 0, 1, ... among the rows of equal ``key``.

    Where no key occurs twice that is a column of zeros.  Otherwise the rows are written once; those of
    repeated keys are numbered within (key, partition), where the count of a key in earlier partitions is
    added, so no task holds all rows of a key: its window holds one partition's share or one row a partition.
    """
    several = cut_lineage(rows.groupBy(F.col(key).alias("__same")).agg(F.count("*").alias("__n")).where("__n > 1").select("__same"))
    if several.isEmpty():
        release(several)
        return rows.withColumn("__copy", F.lit(0).cast("bigint"))
    rows = cut_lineage(rows.withColumn("__row", F.monotonically_increasing_id()))
    of_key = rows.select(F.col(key).alias("__same"), F.col("__row").alias("__at"), F.shiftright("__row", 33).alias("__p")).join(several, "__same", "left_semi")
    of_key = cut_lineage(of_key.withColumn("__k", F.row_number().over(W.partitionBy("__same", "__p").orderBy("__at"))))
    ends = of_key.groupBy("__same", "__p").agg(F.max("__k").alias("__n"))
    before = ends.select("__same", "__p", (F.sum("__n").over(W.partitionBy("__same").orderBy("__p")) - F.col("__n")).alias("__before"))
    number = of_key.join(before, ["__same", "__p"]).select("__at", (F.col("__before") + F.col("__k") - 1).alias("__copy"))
    out = rows.join(number, F.col("__row") == F.col("__at"), "left").drop("__row", "__at")
    return out.withColumn("__copy", F.coalesce("__copy", F.lit(0)).cast("bigint"))


def mix(
    docs: DataFrame, *, text: str = "text", source: str = "source", priority: str | Column | None = None,
) -> DataFrame:
    """Add ``size, source_size, target, copies, taken`` to each document.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ...; their targets share the sum of all
    sizes by weight, none above ``CAP`` times its source.  Of a source that gets r = target / size
    copies of itself, each document gets floor(r) copies for certain.  For the rest of the target,
    documents are ranked by random odds over inclusion odds (Pareto sampling) and taken in that order
    up to the number of words nearest to it: a fixed size, counted in words.  A document that crosses the
    size is the last one if that is nearer; otherwise it is passed over and those ranked after it go on
    filling what is left.  Inclusion chances are equal, or in proportion to the column or
    expression ``priority`` (null or below 0: 0), those above 1 being certain.

    The ranks at which sizes are crossed are found digit by digit from sums over (source, digit), so no
    task holds a source.  Null texts have size 0.  The random number depends on the row's id, source and text
    and, among rows equal in these, on a copy number: reruns agree, and of equal rows as many are taken each time.  Columns of these names in ``docs``
    are replaced.  An empty table gives an empty result.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c not in added]
    ident = [F.col(c) for c in kept if c in ("doc_id", source, text)]
    chance = F.lit(1.0)
    if priority is not None:
        chance = F.greatest(F.coalesce((F.col(priority) if isinstance(priority, str) else priority).cast("double"), F.lit(0.0)), F.lit(0.0))
    base = docs.select(*kept, F.size(words(F.col(text))).cast("bigint").alias("size"), F.xxhash64(*ident).alias("__h"), chance.alias("__w"))
    base = with_copy_numbers(base, "__h")
    base = base.withColumn("__u", F.when(F.col("__copy") == 0, uniform(*ident)).otherwise(uniform("__h", "__copy"))).drop("__h", "__copy")
    small = cut_lineage(base.select(F.col(source).alias("__s"), "size", "__u", "__w"))
    sums = cut_lineage(numbered(
        small.groupBy("__s").agg(F.sum("size").alias("source_size")), F.col("__s").asc_nulls_last(), name="ordinal")
                       .withColumn("weight", F.col("ordinal") % 3 + 1))
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    a, b = water_level(sums, total)
    share = (F.lit(a) * F.col("weight")).cast("double") / F.lit(float(b))
    limit = F.lit(CAP) * F.col("source_size")
    plan = sums.select(
        "__s", "source_size", F.least(limit.cast("double"), share).alias("target")).withColumn(
        "copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")).withColumn(
        "left", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = cut_lineage(_with_slope(small, plan, priority is not None))
    ranked = cut_lineage(_on_source(small, plan.select("__s", "slope", "left"), "__s").where("left > 0").select(
        "__s", "size", _rank().alias("__rank")))
    ranges = _ranges(ranked, plan.where("left > 0").select("__s", "left"))
    plan = cut_lineage(_on_source(plan, ranges, "__s", "left"))
    out = _on_source(base, plan.drop("left"), source)
    out = out.withColumn("__rank", _rank())
    chosen = F.exists("ranges", lambda r: (F.col("__rank") > r["lo"]) & (F.col("__rank") <= r["hi"]) & (F.col("size") <= r["most"]))
    more = F.coalesce(chosen, F.lit(False)) & (F.col("copies") < CAP)
    out = out.withColumn("copies", F.col("copies") + more.cast("bigint"))
    for df in (small, sums, ranked):
        release(df)
    return out.select(*kept, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _on_source(left: DataFrame, right: DataFrame, column: str, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("__s", "__key")
    return left.join(right, F.col(column).eqNullSafe(F.col("__key")), how).drop("__key")


def _with_slope(small: DataFrame, plan: DataFrame, unequal: bool) -> DataFrame:
    """Add ``slope``: a document's chance is least(1, slope * weight), and expected words fill ``left``."""
    start = plan.withColumn("slope", F.when(F.col("source_size") > 0, F.col("left") / F.col("source_size")).otherwise(0.0))
    if not unequal:
        return start
    current, certain = plan.withColumn("slope", F.lit(0.0)), -1
    while True:  # documents of chance 1 leave the sum; their set only grows
        sure = F.col("slope") * F.col("__w") >= 1
        found = _on_source(small, current.select("__s", "slope"), "__s").groupBy("__s").agg(
            F.sum(F.when(sure, F.col("size"))).alias("fixed"), F.sum(F.when(~sure, F.col("size") * F.col("__w"))).alias("rest"),
            F.count(F.when(sure, 1)).alias("n"))
        found = cut_lineage(found)
        n = found.agg(F.sum("n")).first()[0] or 0
        if n == certain:
            return current
        certain = n
        current = cut_lineage(_on_source(plan, found, "__s", "left").withColumn("slope", F.when(
            F.col("rest") > 0, (F.col("left") - F.coalesce("fixed", F.lit(0))) / F.col("rest")).otherwise(0.0)).drop("fixed", "rest", "n"))


def _rank() -> Column:
    """Random odds over inclusion odds, mapped to whole numbers of 52 bits in the same order."""
    p = F.least(F.col("slope") * F.col("__w"), F.lit(1.0))
    q = F.col("__u") * (1 - p) / (F.col("__u") * (1 - p) + (1 - F.col("__u")) * p)
    return F.when(p <= 0, F.lit(LAST)).otherwise(F.least(F.floor(q * float(1 << 52)), F.lit(LAST))).cast("bigint")


def _ranges(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """(``__s``, ``ranges``): documents of a rank in (lo, hi] and a size up to ``most`` are taken.

    Each round goes on behind the document that was passed over, with the words left and the documents
    that can still be taken: those of at most twice as many words.  What is left shrinks below half of the
    one passed over, so the rounds are few.  Documents without a chance do not fill what another left.
    """
    state, rest, steps = plan.withColumn("lo", F.lit(-1).cast("bigint")), ranked, []
    while True:
        state = cut_lineage(state)
        older, rest = rest, cut_lineage(_on_source(rest, state, "__s").where(
            (F.col("size") <= 2 * F.col("left")) & (F.col("__rank") > F.col("lo")) & ((F.col("lo") < 0) | (F.col("__rank") < LAST))
        ).select("__s", "size", "__rank"))
        if steps:
            release(older)
        found = _crossing(rest, state.select("__s", "left")).withColumnRenamed("left", "__left")
        nearer = F.col("after") - F.col("left") <= F.col("left") - F.col("before")
        end = F.when(F.col("lo") < 0, F.lit(LAST)).otherwise(F.lit(LAST - 1))
        step = cut_lineage(_on_source(state, found, "__s", "left").select(
            "__s", "left", "lo", "last", "before", nearer.alias("nearer"),
            F.when(F.col("last").isNull(), end).when(nearer, F.col("last")).otherwise(F.col("last") - 1).cast("bigint").alias("hi")))
        steps.append(step.select("__s", F.struct("lo", "hi", (2 * F.col("left")).alias("most")).alias("r")))
        state = step.where("NOT nearer AND left > before").select("__s", (F.col("left") - F.col("before")).alias("left"), F.col("last").alias("lo"))
        if state.isEmpty():
            break
    release(rest)
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    return cut_lineage(every.groupBy("__s").agg(F.collect_list("r").alias("ranges")))


def _crossing(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """The rank at which each source's sizes pass ``left``: (``__s``, ``left``, ``last``) with the sums before and after it, absent where all are less.

    Each level sums sizes by the next digit of the rank, within the digits already fixed, and fixes
    the digit in which the sum passes ``left``; the window holds one source's digits, 2**13 rows at most.
    """
    state = plan.withColumns({"prefix": F.lit(0).cast("bigint"), "before": F.lit(0).cast("bigint")})
    for level in range(LEVELS):
        shift = DIGIT * (LEVELS - 1 - level)
        inside = _on_source(ranked, state, "__s").where(F.shiftright("__rank", shift + DIGIT) == F.col("prefix"))
        sums = inside.groupBy("__s", "left", "before", F.shiftright("__rank", shift).alias("digit")).agg(F.sum("size").alias("n"))
        upto = W.partitionBy("__s").orderBy("digit")
        sums = sums.withColumn("after", F.col("before") + F.sum("n").over(upto))
        first = sums.where(F.col("after") >= F.col("left")).groupBy("__s", "left").agg(F.min_by(F.struct("digit", "n", "after"), "digit").alias("f"))
        state = cut_lineage(first.select("__s", "left", F.col("f.digit").alias("prefix"), (F.col("f.after") - F.col("f.n")).alias("before"),
                                         F.col("f.after").alias("after")))
        if level < LEVELS - 1:
            state = state.drop("after")
    return state.withColumnRenamed("prefix", "last")
