"""Exact Jaccard join of shingle sets, as connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stagelog.llm import hashing
from stagelog.llm.common import cut_lineage, release
from stagelog.operators.graph import connected_components

HOT = 1 << 16  # shingles ordered by frequency; all others are ordered by hash
SEEN = 1 << 19  # vertices a task remembers so that copies are indexed once
TALLY = 1 << 21  # shingles counted together before counts are sent on
LIST = ["token", "size_class"]
MEMBER = ["v", "n", "pos", "own", "r", "shared"]  # a set in a list: its key, size, place, size class, and the members it shares before and in all
MARKS = [f"s{k}" for k in range(4)]  # 256 bits: whether an odd number of a set's shingles falls on each


def _encoded(batch, text):
    return [(t or "").encode() for t in batch.column(text).to_pylist()]


def _vertex(s: np.ndarray) -> tuple[int, int]:
    a = hashing.mix(s).sum(dtype=np.uint64)
    return int(np.int64(hashing.mix(np.array([a + np.uint64(len(s))]))[0].astype(np.int64))), len(s)


def _marks(s: np.ndarray) -> np.ndarray:
    odd = (np.bincount((s & np.uint64(64 * len(MARKS) - 1)).astype(np.int64), minlength=64 * len(MARKS)) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _may_link(left: str = "a", right: str = "b") -> Column:
    """Whether the marks of two sets leave room for a link.

    Each bit in which they differ stands for at least one shingle that only one set has, so twice the overlap
    is at most the sum of the sizes less those bits.  No pair that links is lost.
    """
    apart = sum(F.bit_count(F.col(f"{m}{left}").bitwiseXOR(F.col(f"{m}{right}"))) for m in MARKS)
    return 9 * apart <= F.col(f"n{left}") + F.col(f"n{right}")


def _room() -> Column:
    """Whether a shared member at places ``posa`` and ``posb`` leaves room for a link, in the larger set's list.

    Common members before it stand in both prefixes, so both sets share them with others: they are at most as many
    as the members ``ra``, ``rb`` that the sets share with any set before these places.  So are all members of
    both prefixes at most the ``shareda``, ``sharedb`` that the sets share with any set.
    """
    overlap = F.least("ra", "rb") + F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb"))
    return ((F.col("size_class") == F.greatest("owna", "ownb")) & (5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb"))
            & (9 * overlap >= 4 * (F.col("na") + F.col("nb"))) & _reachable(F.least("shareda", "sharedb")))


def prefix_length(n: int) -> int:
    """Two sets with a Jaccard similarity of 0.8 share one of so many first members."""
    return n - (4 * n + 4) // 5 + 1


def vertices(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, text_key, v, n`` and ``MARKS``: a key of each row's shingle set, its size and marks; empty sets have size 0."""
    added = ["v", "n", *MARKS]

    def run(batches):
        for b in batches:
            found = [(*_vertex(s), *_marks(s).tolist()) for s in _sets(_encoded(b, text))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *[pa.array([f[k] for f in found], pa.int64()) for k in range(len(added))]], ["doc_id", "text_key", *added])

    key = _text_key(text).alias("text_key")
    schema = docs.select("doc_id", key, *[F.lit(0).cast("bigint").alias(c) for c in added]).schema
    return docs.select("doc_id", text, key).mapInArrow(run, schema)


def _text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _sets(texts: list[bytes]):
    for a, b in hashing.pieces(texts):
        yield from hashing.shingle_sets(texts[a:b])


def hot_shingles(docs: DataFrame, text: str = "text", most: int = HOT) -> np.ndarray:
    """The ``most`` most frequent shingles, rare first; counted over all documents.

    Only shingles found four times within one task's ``TALLY`` shingles are passed on, so the order is
    approximate.  It decides what is indexed, never what is linked: any order gives the same links.
    """
    def run(batches):
        held, size = [], 0
        for b in batches:
            for s in _sets(_encoded(b, text)):
                held.append(s)
                size += len(s)
                if size > TALLY:
                    yield tally(held)
                    held, size = [], 0
        if held:
            yield tally(held)

    def tally(held):
        u, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u[c >= 4].astype(np.int64)), pa.array(c[c >= 4].astype(np.int64))], ["token", "c"])

    counts = docs.select(text).mapInArrow(run, "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c"))
    rows = counts.orderBy(F.desc("c"), "token").limit(most).collect()
    return np.array([r["token"] for r in reversed(rows)], dtype=np.int64).astype(np.uint64)


def index_entries(docs: DataFrame, hot: np.ndarray, text: str = "text") -> DataFrame:
    """``token, v, n, pos, hot``: the first members of each set in the common order, with their positions.

    ``hot`` marks the shingles given.
    """
    order = np.argsort(hot)
    keys, ranks = hot[order], order.astype(np.uint64) + np.uint64(1 << 63)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            rows = []
            for s in _sets(_encoded(b, text)):
                v, n = _vertex(s)
                if not n or v in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(v)
                rank = s >> np.uint64(1)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    rank = np.where(keys[at] == s, ranks[at], rank)
                p = prefix_length(n)
                first = np.argpartition(rank, p - 1)[:p] if p < n else np.arange(n)
                first = first[np.argsort(rank[first], kind="stable")]
                rows.append((s[first], np.full(p, v), np.full(p, n), np.arange(p), rank[first] >> np.uint64(63) != 0))
            if rows:
                token, v, n, pos, frequent = (np.concatenate(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(frequent)], ["token", "v", "n", "pos", "hot"])

    return docs.select(text).mapInArrow(run, "token bigint, v bigint, n int, pos int, hot boolean")


def shared_lists(entries: DataFrame) -> DataFrame:
    """``token, v, n, pos, x, y``: the entries of lists with two sets or more, x and y being a list's least and greatest.

    Lists of frequent shingles are summed up first and joined, so none is held by one task.  All other
    lists are met in one exchange.  They are short: a shingle that a thousandth of the sets have is counted in
    a task, and only 65,536 of those can be more frequent.
    """
    of_list = W.partitionBy("token")
    short = entries.where("NOT hot").select("token", "v", "n", "pos", F.min("v").over(of_list).alias("x"), F.max("v").over(of_list).alias("y"))
    frequent = cut_lineage(entries.where("hot").select("token", "v", "n", "pos"))
    ends = frequent.groupBy("token").agg(F.min("v").alias("x"), F.max("v").alias("y"))
    return short.unionByName(frequent.join(ends.hint("merge"), "token")).where("x < y")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Overlap ``o`` of each pair (a, b), from whole texts: they take less room than their sets."""
    one = texts.select(F.col("v").alias("a"), F.col("t").alias("ta"))
    two = texts.select(F.col("v").alias("b"), F.col("t").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ta", "tb")

    def run(batches):
        b_text, b_set = None, None
        for batch in batches:
            rows = batch.select(["a", "b", "na", "nb"]).to_pydict()
            o, right = [], batch.column("tb")
            for k, (a, b, s) in enumerate(zip(rows["a"], rows["b"], _sets(_encoded(batch, "ta")))):
                if right[k] != b_text:  # pairs of one leader arrive together
                    b_text, b_set = right[k], next(_sets([(right[k].as_py() or "").encode()]))
                same = _vertex(s)[0] == a and _vertex(b_set)[0] == b
                o.append(len(np.intersect1d(s, b_set, assume_unique=True)) if same else 0)
            yield pa.RecordBatch.from_pydict(rows | {"o": o}, schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("o", pa.int32())])
    return both.mapInArrow(run, "a bigint, b bigint, na int, nb int, o int")


def _linked() -> Column:
    return 9 * F.col("o") >= 4 * (F.col("na") + F.col("nb"))


def _texts_of(docs: DataFrame, ids: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """``v, t``: the text of each wanted vertex, that of the smallest id and text key; null ids come last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("d")
    rep = cut_lineage(ids.join(wanted, "v", "left_semi").groupBy("v").agg(first).select("v", F.col("d.doc_id").alias("d"), F.col("d.text_key").alias("tk")))
    rows = docs.select("doc_id", _text_key(text).alias("text_key"), F.col(text).alias("t"))
    return cut_lineage(rows.join(rep.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("tk"))).select("v", "t"))


def components(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Texts (A-Z in lower case) become sets of five-word shingles.  Rows link when 100 * intersection >= 80 *
    union; ``component_id`` is the smallest ``doc_id`` reachable by links.  Shingles and sets are compared by
    64-bit hashes.  Equal sets are one vertex.  An inverted index holds the first members of each set in a
    common order, frequent ones last.  Lists are blocked by size class, so sets that cannot be similar in
    size never meet, and by position: a pair is skipped where the members left after its positions, and those
    before them that each shares with any other set, cannot reach the overlap needed.

    First each list's sets meet four leaders of the list only, one of them the set that shares the largest part
    of its prefix, since most of a group of near copies link with those in its middle.  A set that proves highly
    similar to a leader takes over the leader's component, that is its answers; only pairs across components are
    left.
    Where two sets share lists that follow one another in both, as those of a common passage do, just the
    first and the last of such a run name the pair, with their places, so the number of shared lists is known.
    Of these pairs, one is skipped where its answer follows from the leader's: the overlap with y is at most
    the leader's overlap with y plus the members that the leader lacks.  The rest is computed in full.
    Every set carries 256 marks, which bound a pair's overlap from above: pairs that cannot link by them are dropped in
    the join of lists and before any text is read.  The bound is weak for sets of a thousand shingles and more.
    A list's sets are compared across components only, and every link between different components is found.

    Null, empty and blank texts have no shingles and link with nothing: their component is their own id.
    Fully repeated rows each get a row; null ids count only where a component has no other id; other
    columns are ignored.
    """
    rows = _grouped(docs, text)
    least = cut_lineage(rows.where("n > 0").groupBy("g").agg(F.min("doc_id").alias("least")).withColumnRenamed("g", "k"))
    out = rows.join(least, (F.col("g") == F.col("k")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _grouped(docs: DataFrame, text: str) -> DataFrame:
    """``doc_id, text_key, n, g`` of every row: the size of its set and the key of its component."""
    ids = cut_lineage(vertices(docs, text))
    hot = hot_shingles(docs, text)
    top = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    active = shared_lists(index_entries(docs, hot, text)).select("token", "v", "n", "pos", top.alias("own"), "x", "y").distinct()
    own_lists = W.partitionBy("v").orderBy("x", "y", "token")
    active = cut_lineage(active.select(
        "token", "v", "n", "pos", "own", F.lag("token").over(own_lists).alias("before"), F.lead("token").over(own_lists).alias("after"),
        F.row_number().over(own_lists).alias("k"), (F.row_number().over(W.partitionBy("v").orderBy("pos")) - 1).alias("r"),
        F.count("*").over(W.partitionBy("v")).cast("int").alias("shared")))
    classed = active.withColumn("size_class", F.explode(F.array("own", F.col("own") + 1)))

    size_of = cut_lineage(ids.join(active.select("v").distinct(), "v", "left_semi").groupBy("v").agg(*[F.first(c).alias(c) for c in ("n", *MARKS)]))
    # a set that shares much of its prefix stands near the middle of its group
    middle, member = F.struct(F.col("shared") / F.col("n"), "v"), F.struct(*MEMBER)
    pairs = _met(classed, [F.min(member), F.max(member), F.max_by(member, middle), F.max_by(member, F.xxhash64("v"))])
    known = _compared(pairs, size_of, docs, ids, text)
    labels = _merged(size_of.select("v", F.col("v").alias("c")), known.where(_linked()))

    labelled = active.join(size_of.select("v", *MARKS), "v").join(labels, "v")
    labelled = cut_lineage(labelled.withColumn("size_class", F.explode(F.array("own", F.col("own") + 1))))
    # the same columns on both sides, so that both read one exchange
    sides = (*MEMBER, "c", "before", "after", "k", *MARKS)
    x, y = (labelled.select(*LIST, *[F.col(c).alias(f"{c}{end}") for c in sides]) for end in "ab")
    begins, ends = ~F.col("beforea").eqNullSafe(F.col("beforeb")), ~F.col("aftera").eqNullSafe(F.col("afterb"))
    begins, ends = begins | F.col("beforea").isNull(), ends | F.col("aftera").isNull()
    rest = x.join(y, LIST).where((F.col("va") < F.col("vb")) & (F.col("ca") != F.col("cb")) & _room() & (begins | ends) & _may_link())
    places = F.col("ka") + F.col("kb")  # a run is as long in one set's lists as in the other's
    run = F.when(ends, places + 2).otherwise(0) - F.when(begins, places).otherwise(0)
    rest = rest.groupBy(F.col("va").alias("a"), F.col("vb").alias("b")).agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.shiftright(F.sum(run), 1).alias("m"))
    rest = rest.where(_reachable(F.col("m"))).drop("m").join(known.select("a", "b"), ["a", "b"], "left_anti")
    rest = cut_lineage(_not_derived(rest, known))
    found = _links(rest, _texts_of(docs, ids, rest.select(F.explode(F.array("a", "b")).alias("v")).distinct(), text))
    final = _merged(labels, found.where(_linked()))
    for df in (active, labelled, size_of, known, labels, rest):
        release(df)

    rows = ids.join(final, "v", "left").withColumn("g", F.coalesce("c", "v"))
    return cut_lineage(rows.select("doc_id", "text_key", "n", "g"))


def _met(entries: DataFrame, leaders: list[Column]) -> DataFrame:
    """``a, b``: pairs of a set and one of the ``leaders`` of its lists that may link."""
    names = [f"l{k}" for k in range(len(leaders))]
    found = entries.groupBy(*LIST).agg((F.min("v") < F.max("v")).alias("shared"), *[x.alias(name) for x, name in zip(leaders, names)]).where("shared")
    found = found.select(*LIST, F.explode(F.array_distinct(F.array(*names))).alias("l"))
    both = entries.select(*LIST, *[F.col(c).alias(f"{c}a") for c in MEMBER]).join(found.select(*LIST, *[F.col(f"l.{c}").alias(f"{c}b") for c in MEMBER]), LIST)
    return both.where((F.col("va") != F.col("vb")) & _room()).select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b")).distinct()


def _compared(pairs: DataFrame, size_of: DataFrame, docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """``a, b, na, nb, o``: the overlaps of those pairs that may link by their marks."""
    pairs = cut_lineage(_sized(pairs, size_of).where(_may_link()).select("a", "b", "na", "nb"))
    texts = _texts_of(docs, ids, pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), text)
    out = cut_lineage(_links(pairs, texts))
    release(pairs)
    release(texts)
    return out


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``v, c``: the components ``c`` of sets, joined along links ``a, b``."""
    edges = links.join(labels.select(F.col("v").alias("a"), F.col("c").alias("i")), "a").join(labels.select(F.col("v").alias("b"), F.col("c").alias("j")), "b")
    edges = cut_lineage(edges.where("i <> j").select("i", "j").distinct())
    found = connected_components(edges, by=())
    out = cut_lineage(labels.join(found.withColumnRenamed("tile_id", "c"), "c", "left").select("v", F.coalesce("component", "c").alias("c")))
    release(edges)
    return out


def _sized(pairs: DataFrame, size_of: DataFrame) -> DataFrame:
    for end in "ab":
        pairs = pairs.join(size_of.select(F.col("v").alias(end), *[F.col(c).alias(f"{c}{end}") for c in ("n", *MARKS)]), end)
    return pairs


def _reachable(shared: Column) -> Column:
    """Whether ``shared`` common prefix members and all that follows the prefixes could make a link."""
    after = [F.col(n) - (F.col(n) - F.expr(f"(4 * {n} + 4) div 5") + 1) for n in ("na", "nb")]
    return 9 * (shared + F.greatest(*after)) >= 4 * (F.col("na") + F.col("nb"))


def _not_derived(rest: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs whose answer does not follow from a set that is linked with one of them."""
    sides = known.select("a", "b", "na", "nb", "o", _linked().alias("yes"))
    sides = cut_lineage(sides.unionByName(sides.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb"), "o", "yes")))
    close = sides.where("yes").select(F.col("a").alias("x"), F.col("b").alias("r"), (F.col("na") - F.col("o")).alias("lacks"))
    far = sides.where("not yes").select(F.col("a").alias("z"), F.col("b").alias("q"), F.col("o").alias("oz"))
    out = rest
    for near, away in (("a", "b"), ("b", "a")):
        bound = out.join(close, F.col(near) == F.col("x")).join(far, (F.col(away) == F.col("z")) & (F.col("r") == F.col("q")))
        settled = bound.where(9 * (F.col("oz") + F.col("lacks")) < 4 * (F.col("na") + F.col("nb"))).select("a", "b").distinct()
        out = out.join(settled, ["a", "b"], "left_anti")
    return out


def one_of_each(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """One row of each component, with all columns, and all rows without shingles.

    The row has the component's smallest (doc_id, text hash), null ids last.  Rows that repeat that id and
    text are one row; which one is arbitrary where their other columns differ.
    """
    rows = _grouped(docs.select("doc_id", text), text)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("d")
    kept = rows.where("n > 0").groupBy("g").agg(first).select(F.col("d.doc_id").alias("__d"), F.col("d.text_key").alias("__t"), F.lit(True).alias("__one"))
    bare = rows.where("n = 0").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"), F.lit(False).alias("__one")).distinct()
    keyed = docs.withColumn("__k", _text_key(text))
    found = keyed.join(cut_lineage(kept.unionByName(bare)).hint("merge"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__k") == F.col("__t")))
    return found.where("NOT __one").select(*docs.columns).unionByName(
        found.where("__one").dropDuplicates(["doc_id", "__k"]).select(*docs.columns))
