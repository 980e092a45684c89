"""Quality rules learned as an ordered list of threshold conjunctions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from stagelog.llm.common import cut_lineage, let, release, words

WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["upper_share", "symbol_share", "mark_share", "word_length", "dup_line_share", "repeat_share", "variety", "log_words"]
CUTS = [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995]


def repeated_words(tokens: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes of word hashes.  Only rows with a repeated window sort theirs.
    """
    def windows(h):
        body = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return F.transform(body, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    def covered(starts):
        step = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeats(ordered):
        return F.transform(ordered, lambda x, i: F.when(
            (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]), x["i"]))

    def count(g):
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = F.sort_array(F.filter(let(ordered, repeats), lambda p: p.isNotNull()))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(starts, covered))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count)).cast("bigint")


def statistics(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts and shares of each whole text; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = keep if keep is not None else [c for c in docs.columns if c not in (*COUNTS, *FEATURES)]
    base = docs.select(*kept, t.alias("__t"))
    kept = base.columns[:-1]
    base = base.withColumn("__w", words(F.col("__t")))
    t, w = F.col("__t"), F.col("__w")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select(
        *kept, F.size(w).cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("__l"),
        repeated_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("__d"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).alias("__u"),
        (F.length(t) - F.length(F.translate(t, "!?", ""))).alias("__m"))

    def share(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    n, chars = F.col("n_words"), F.col("word_chars")
    return base.withColumn("n_dup_lines", (F.col("__l.n") - F.col("__l.d")).cast("bigint")).withColumns({
        "upper_share": share(F.col("__u"), chars), "symbol_share": share(F.col("n_symbols"), n), "mark_share": share(F.col("__m"), n),
        "word_length": share(chars, n), "dup_line_share": share(F.col("n_dup_lines"), F.col("__l.n")),
        "repeat_share": share(F.col("n_repeat_words"), n), "variety": share(F.col("__d"), n), "log_words": F.log1p(n.cast("double")),
    }).select(*kept, *COUNTS, *FEATURES)


@dataclass
class Rule:
    """A conjunction of (feature, above, threshold); rows that meet all of it get ``verdict``."""

    tests: list[tuple[str, bool, float]] = field(default_factory=list)
    verdict: bool = False

    def condition(self) -> Column:
        out = F.lit(True)
        for name, above, cut in self.tests:
            out = out & ((F.col(name) > cut) if above else (F.col(name) <= cut))
        return out

    def __str__(self):
        return " and ".join(f"{n} {'>' if a else '<='} {c:g}" for n, a, c in self.tests) + f" -> {'keep' if self.verdict else 'reject'}"


def apply_rules(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the first rule that fits decides, otherwise keep."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.condition(), F.lit(rule.verdict)).otherwise(out)
    return out


def learn(
    labelled: DataFrame, *, max_tests: int = 4, purity: float = 0.95, least: float = 0.005,
) -> list[Rule]:
    """Sequential covering over rows with ``FEATURES``, ``bad`` (0/1) and ``part`` (0, 1: grow; 2: prune).

    A rule grows by the test of highest information gain until it covers bad rows only, then drops final
    tests as long as that raises (bad - good) / (bad + good) on the pruning rows.  It is accepted when it
    covers ``purity`` bad rows on the pruning part and ``least`` of all bad rows; covered rows leave, and the
    next rule starts with all tests open.  A rule that is not accepted bars its first test's feature and
    direction from coming first, and the next best start is tried, so covering ends when no start is left:
    small pure kinds behind a large impure one are found.  Each accepted rule covers at least ``least`` of the
    bad rows, which bounds their number.  Candidate thresholds lie halfway between neighbouring quantiles, so
    every step is one aggregate over all rows whose result has features x quantiles rows.
    """
    data = cut_lineage(labelled)
    grid = {}
    marks = data.agg(*[F.percentile_approx(F.when(F.col("bad") == b, F.col(f)), CUTS, 1000).alias(f"{f}_{b}") for f in FEATURES for b in (0, 1)]).first()
    for f in FEATURES:
        seen = sorted({*(marks[f"{f}_0"] or []), *(marks[f"{f}_1"] or [])})
        grid[f] = [(a + b) / 2 for a, b in zip(seen, seen[1:])]
    bins = F.array(*[F.struct(F.lit(f).alias("f"), sum((F.col(f) > c).cast("int") for c in grid[f]) if grid[f] else F.lit(0))
                     for f in FEATURES]).cast("array<struct<f:string,b:int>>")
    binned = cut_lineage(data.withColumn("bins", bins))
    total = binned.agg(F.sum("bad")).first()[0] or 0
    rules: list[Rule] = []
    left, barred, start = F.lit(True), set(), None
    while total:
        rows = binned.where(left & (F.col("part") < 2))
        start = start or _counts(rows)
        rule = _grow(rows, grid, max_tests, start, barred)
        if not rule.tests:
            break
        first = rule.tests[0][:2]
        rule, bad, good = _prune(binned.where(left & (F.col("part") == 2)), rule)
        if not rule.tests or bad < purity * (bad + good) or 3 * bad < least * total:
            barred.add(first)
            continue
        rules.append(rule)
        left, barred, start = left & ~rule.condition(), set(), None
    release(data)
    release(binned)
    return rules


def _counts(rows: DataFrame) -> list:
    """Bad and good rows of each feature's bins."""
    return rows.select("bad", F.explode("bins").alias("x")).groupBy("x.f", "x.b").agg(
        F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()


def _grow(rows: DataFrame, grid: dict[str, list[float]], max_tests: int, start: list, barred: set[tuple[str, bool]]) -> Rule:
    """The rule grown from the counts ``start`` of all rows; its first test is none of ``barred``."""
    import math

    rule = Rule()
    while len(rule.tests) < max_tests:
        counts = _counts(rows.where(rule.condition())) if rule.tests else start
        bad = sum(r["bad"] for r in counts if r["f"] == FEATURES[0])
        good = sum(r["good"] for r in counts if r["f"] == FEATURES[0])
        if not bad or not good:
            break
        best, chosen = 0.0, None
        for f in FEATURES:
            for k, cut in enumerate(grid[f]):
                p = sum(r["bad"] for r in counts if r["f"] == f and r["b"] > k)
                n = sum(r["good"] for r in counts if r["f"] == f and r["b"] > k)
                for above, p, n in ((True, p, n), (False, bad - p, good - n)):
                    if not rule.tests and (f, above) in barred:
                        continue
                    if p and (gain := p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))) > best:
                        best, chosen = gain, (f, above, cut)
        if chosen is None:
            break
        rule.tests.append(chosen)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    if not rule.tests:
        return rule, 0, 0
    heads = [Rule(rule.tests[:k]) for k in range(1, len(rule.tests) + 1)]
    row = rows.agg(*[F.sum(F.when(h.condition(), c)).alias(f"{n}{k}") for k, h in enumerate(heads)
                     for n, c in (("bad", F.col("bad")), ("good", 1 - F.col("bad")))]).first()
    scored = [((b - g) / (b + g), -k, b, g) for k in range(len(heads)) if (b := row[f"bad{k}"] or 0) + (g := row[f"good{k}"] or 0)]
    if not scored:
        return Rule(), 0, 0
    _, k, bad, good = max(scored)
    return heads[-k], bad, good


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, *, text: str = "text", keep: list | None = None) -> tuple[DataFrame, list[Rule]]:
    """Statistics of every document with ``base_failed`` and ``kept``, and the learned rules.

    A document is kept if it does not fail the base and the first learned rule that fits it, if any, does
    not reject.  Rules are learned from all rows of ``labels`` with a quality whose document passes the
    base; a document labelled twice counts twice; without labels there are no rules.  A null text counts
    as empty and fails the base; repeated rows are judged alike; ``doc_id`` may be null (never labelled).
    """
    stats = cut_lineage(statistics(docs, text=text, keep=keep or ["doc_id"]).withColumn("base_failed", base_failed()))
    marked = labels.where("quality is not null").select(F.col("doc_id").alias("__id"), (F.col("quality") == 0).cast("int").alias("bad"))
    rows = stats.where(~F.col("base_failed")).join(marked, F.col("doc_id") == F.col("__id")).select(
        *FEATURES, "bad", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)).alias("part"))
    rules = learn(rows)
    return stats.withColumn("kept", ~F.col("base_failed") & apply_rules(rules)), rules
