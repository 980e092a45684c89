"""Katz backoff scores: Good-Turing discounted word pairs that back off to discounted words."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stagelog.llm import hashing
from stagelog.llm.common import cut_lineage, numbered, release

LARGEST = 5  # counts up to this are discounted
END = np.uint64(1)  # hash of the end of a text
START_ID, UNKNOWN = 0xFFFFFFFE, 0xFFFFFFFF
CHUNK = 4096  # documents of neighbouring ids that are encoded together
FLUSH = 1 << 18  # rows a task holds before it sends them on
TALLY = 1 << 21  # words or pairs a task looks through together
FREQUENT = 1 << 16  # pairs that are added up apart
_ENTRY = [("w1", np.uint32), ("w2", np.uint32), ("row", np.int64), ("n", np.uint32)]
TEXT, UNSEEN, CONTEXT, COUNTS, PAIRS = range(5)  # kinds of parts
_TIMES = [f"m{r}" for r in range(1, LARGEST + 1)]
_PART = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("x", pa.float64()), *[(m, pa.int32()) for m in _TIMES], ("data", pa.binary())])
PART = "kind tinyint, a bigint, b bigint, n bigint, x double, " + ", ".join(f"{m} int" for m in _TIMES) + ", data binary"


def good_turing(counts: dict[int, int]) -> dict[int, float]:
    """Discounts d of counts r up to ``LARGEST`` from the numbers of items with each count.

    Katz's rule, with the largest limit for which all discounts lie in (0, 1); half a count is taken off
    single items where there is none, as in tiny corpora.
    """
    for k in range(LARGEST, 0, -1):
        if all(counts.get(r, 0) for r in range(1, k + 2)):
            rest = (k + 1) * counts[k + 1] / counts[1]
            d = {r: ((r + 1) * counts[r + 1] / (r * counts[r]) - rest) / (1 - rest) for r in range(1, k + 1)} if rest != 1 else {}
            if d and all(0 < v < 1 for v in d.values()):
                return d | {r: 1.0 for r in range(k + 1, LARGEST + 1)}
    return {1: 0.5} | {r: 1.0 for r in range(2, LARGEST + 1)}


class Words:
    """Counts and backoff probabilities of words by id: ids follow falling counts, so few steps tell them.

    There are at most sqrt(2 N) different counts among N tokens.
    """

    def __init__(self, steps: list[tuple[int, int]], texts: int):
        self.counts = np.array([c for c, _ in steps], dtype=np.float64)
        self.ends = np.cumsum([n for _, n in steps]) if steps else np.zeros(0, np.int64)
        self.n = int(sum(c * n for c, n in steps))
        self.v = int(sum(n for _, n in steps))
        self.texts = texts
        self.discount = good_turing({c: n for c, n in steps})
        kept = np.array([self.discount.get(int(c), 1.0) * c for c in self.counts]) / (self.n + 1)
        self.unknown = 1 - float((kept * [n for _, n in steps]).sum()) if steps else 1.0
        self.log = np.append(np.log10(kept), math.log10(self.unknown))
        self.all = np.append(self.counts, 0.0)

    def step(self, ids):
        return np.searchsorted(self.ends, ids, side="right")

    def count(self, ids):
        return self.all[self.step(ids)]

    def contexts(self, ids):
        """How often a word, or the start, is followed by something."""
        return np.where(ids == START_ID, float(self.texts), self.count(ids))

    def log_p(self, ids):
        return self.log[self.step(ids)]


def _hashed(texts: list[bytes]):
    """For pieces of ``texts``: the word hashes of all their texts, an end after each, and how many each text has."""
    for s, e in hashing.pieces(texts):
        h, counts = hashing.word_hashes(texts[s:e])
        yield np.insert(h, np.cumsum(counts), END), counts + 1


def _texts(batch):
    return [t or b"" for t in batch.column("t").cast(pa.binary()).to_pylist()]


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, c``: training words (ends included) and their counts."""
    def run(batches):
        held, size = [], 0
        for b in batches:
            for h, _ in _hashed(_texts(b)):
                held.append(h)
                size += len(h)
            if size > FLUSH:
                yield tally(held)
                held, size = [], 0
        if held:
            yield tally(held)

    def tally(held):
        u, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(c)], ["h", "c"])

    return docs.where("not held_out").select("t").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def as_ids(docs: DataFrame, vocabulary: DataFrame, words: Words) -> DataFrame:
    """Each row with its word ids and what they alone decide.

    Texts are dealt out in chunks.  Every chunk asks for the ids of its distinct words, which is far less than
    a join of all tokens, and is then encoded together with the answers.
    """
    def ask(batches):
        held: dict[int, list] = {}
        size = 0
        for b in batches:
            chunks, at = b.column("chunk").to_numpy(zero_copy_only=False), 0
            for h, counts in _hashed(_texts(b)):
                own = chunks[at:at + len(counts)]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))  # texts of one chunk mostly stand together
                for chunk, part in zip(own[first].tolist(), np.split(h, np.concatenate([[0], np.cumsum(counts)])[first[1:]])):
                    held.setdefault(chunk, []).append(np.unique(part))
                at, size = at + len(counts), size + len(h)
            if size > TALLY:
                yield asked(held)
                held, size = {}, 0
        if held:
            yield asked(held)

    def asked(held):
        sets = {k: np.unique(np.concatenate(v)) for k, v in held.items()}
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(list(sets), [len(v) for v in sets.values()]).astype(np.int64)),
            pa.array(np.concatenate(list(sets.values())).astype(np.int64))], ["chunk", "h"])

    def encode(left: pa.Table, right: pa.Table) -> pa.Table:
        h = right.column("h").to_numpy()
        order = np.argsort(h)
        h, ids = h[order], right.column("id").to_numpy()[order]
        out = {n: [] for n in ("n_tokens", "n_known", "base", "ids")}
        known_log = np.log10((words.all + 1) / (words.n + words.v + 1))
        for own, counts in _hashed(_texts(left)):
            own = own.astype(np.int64)
            at = np.minimum(np.searchsorted(h, own), max(0, len(h) - 1))
            found = np.where(h[at] == own, ids[at], UNKNOWN) if len(h) else np.full(len(own), UNKNOWN)
            cut = np.cumsum(counts)[:-1]
            out["n_tokens"].extend(counts.tolist())
            out["n_known"].extend(np.add.reduceat((found != UNKNOWN).astype(np.int64), np.concatenate([[0], cut])).tolist())
            out["base"].extend(float(part.sum()) for part in np.split(known_log[words.step(found)], cut))
            out["ids"].extend(part.tobytes() for part in np.split(found.astype(np.uint32), cut))
        return pa.table([left.column("doc_id"), left.column("held_out"), pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64()),
                         pa.array(out["base"], pa.float64()), pa.array(out["ids"], pa.binary())], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "ids"])

    asks = docs.select("chunk", "t").mapInArrow(ask, "chunk bigint, h bigint").join(vocabulary.select("h", "id").hint("merge"), "h").select("chunk", "h", "id")
    schema = docs.select("doc_id", "held_out").withColumns({n: F.lit(None).cast(t) for n, t in (
        ("n_tokens", "bigint"), ("n_known", "bigint"), ("base", "double"), ("ids", "binary"))}).schema
    coded = docs.groupBy("chunk").cogroup(asks.groupBy("chunk")).applyInArrow(encode, schema)
    return cut_lineage(coded.withColumn("row", F.monotonically_increasing_id()))


def _pairs(texts: list[bytes]):
    """For pieces of ``texts``: each word after the one before it, as one number a pair, and the text's place in the list."""
    for s, e in hashing.pieces(texts):
        sizes = np.array([len(ids) // 4 for ids in texts[s:e]])
        w2 = np.frombuffer(b"".join(texts[s:e]), np.uint32).astype(np.uint64)
        w1 = np.concatenate([np.zeros(1, np.uint64), w2[:-1]])
        w1[(np.cumsum(sizes) - sizes)[sizes > 0]] = START_ID
        yield (w1 << np.uint64(32)) | w2, np.repeat(np.arange(s, e), sizes)


class Frequent:
    """Pairs with their counts and values; ``places`` looks up others among them."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, words: Words):
        self.pairs, self.counts = pairs, counts
        self.w1, self.w2 = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.values = np.log10(counts) - np.log10(words.contexts(self.w1) + 1)

    def places(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair is one of these, and the places of those that are."""
        if not len(self.pairs):
            return np.zeros(len(pairs), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        hit = self.pairs[at] == pairs
        return hit, at[hit]


def frequent_pairs(coded: DataFrame, words: Words, most: int = FREQUENT, least: int = 8) -> Frequent:
    """The ``most`` most frequent training pairs and their counts over all training texts.

    Such a pair stands in a large share of the texts, so one task could not hold its rows.  Candidates are pairs
    found ``least`` times among ``TALLY`` pairs of one task; each is then counted in full.  Which pairs are
    taken decides where they are added up, never what is counted.
    """
    train = coded.where("not held_out").select("ids")

    def piles(batches):
        held, size = [], 0
        for b in batches:
            for pair, _ in _pairs(b.column("ids").to_pylist()):
                held.append(pair)
                size += len(pair)
                if size > TALLY:
                    yield np.concatenate(held)
                    held, size = [], 0
        if held:
            yield np.concatenate(held)

    def often(batches):
        for pile in piles(batches):
            u, c = np.unique(pile, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u[c >= least].astype(np.int64)), pa.array(c[c >= least].astype(np.int64))], ["pair", "c"])

    found = train.mapInArrow(often, "pair bigint, c bigint").groupBy("pair").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "pair").limit(most)
    pairs = np.sort(np.array([r["pair"] for r in found.collect()], dtype=np.int64).astype(np.uint64))
    candidates = Frequent(pairs, np.ones(len(pairs)), words)

    def count(batches):
        sums = np.zeros(len(pairs), np.int64)
        for pile in piles(batches):
            sums += np.bincount(candidates.places(pile)[1], minlength=len(pairs))
        k = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(sums[k])], ["k", "c"])

    counts = np.zeros(len(pairs), np.int64)
    if len(pairs):
        for r in train.mapInArrow(count, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c")).collect():
            counts[r["k"]] = r["c"]
    kept = counts > LARGEST + 1
    return Frequent(pairs[kept], counts[kept], words)


def _with_frequent(coded: DataFrame, frequent: Frequent) -> DataFrame:
    """``row, x``: what frequent pairs give each text."""
    def run(batches):
        for b in batches:
            x = np.zeros(b.num_rows)
            for pair, text in _pairs(b.column("ids").to_pylist()):
                hit, at = frequent.places(pair)
                x += np.bincount(text[hit], frequent.values[at], b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(x)], ["row", "x"])

    return coded.select("row", "ids").mapInArrow(run, "row bigint, x double")


def pair_parts(coded: DataFrame, words: Words, frequent: Frequent, buckets: int) -> DataFrame:
    """Counts of all but the frequent word pairs, bucket by bucket, and what they give texts and contexts.

    Kinds: ``TEXT`` (a: row; x and, by count, m1 to m5: its pairs seen in training), ``UNSEEN`` (a: row, b: context,
    n: times; x), ``CONTEXT`` (a: word; n: count beyond ``LARGEST``, m1 to m5: pairs by count, x: probability of its
    successors as words), ``COUNTS`` (a: count, n: number of pairs that have it) and ``PAIRS`` (the table of counts itself).
    """
    def spread(batches):
        held, size = [], 0
        for b in batches:
            rows, out = b.column("row").to_numpy(), b.column("held_out").to_numpy(zero_copy_only=False)
            for pair, text in _pairs(b.column("ids").to_pylist()):
                rare = ~frequent.places(pair)[0]
                rare &= ~out[text] | ((pair >> np.uint64(32) != UNKNOWN) & (pair & np.uint64(0xFFFFFFFF) != UNKNOWN))
                held.append((pair[rare], rows[text[rare]], out[text[rare]]))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield sent(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield sent(*map(np.concatenate, zip(*held)))

    def sent(pair, row, out):
        order = np.argsort(pair, kind="stable")  # a text's equal pairs stay together
        at = (hashing.mix(pair) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint64)
        order = order[np.argsort(at[order], kind="stable")]
        pair, row, out, at = pair[order], row[order], out[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])])) if len(pair) else np.zeros(0, np.int64)
        e = np.empty(len(first), _ENTRY)
        e["w1"], e["w2"], e["row"] = pair[first] >> np.uint64(32), pair[first] & np.uint64(0xFFFFFFFF), row[first]
        e["n"] = 2 * np.diff(np.append(first, len(pair))) + out[first]
        at = at[first]
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        data = [_planes(e[s:t]) for s, t in zip(cut, np.append(cut[1:], len(at)))]
        return pa.RecordBatch.from_arrays([pa.array(at[cut].astype(np.int32)), pa.array(data, pa.binary())], ["bucket", "data"])

    def gather(batches):
        bucket, held, sums = None, [], Sums(words)
        for b in batches:
            for key, data in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist()):
                if key != bucket:
                    if held:
                        yield from sums.add(bucket, np.concatenate(held))
                    bucket, held = key, []
                held.append(_from_planes(data))
        if held:
            yield from sums.add(bucket, np.concatenate(held))
        yield from sums.rest()

    parts = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent_rows = coded.select("row", "held_out", "ids").mapInArrow(spread, "bucket int, data binary")
    return sent_rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, PART)


def _planes(e: np.ndarray) -> bytes:
    """Fields one after the other and byte by byte, which the exchange's compression likes."""
    return b"".join(np.ascontiguousarray(e[f]).view(np.uint8).reshape(len(e), -1).T.tobytes() for f, _ in _ENTRY)


def _from_planes(data: bytes) -> np.ndarray:
    n = len(data) // sum(np.dtype(t).itemsize for _, t in _ENTRY)
    out, at = np.empty(n, _ENTRY), 0
    for f, t in _ENTRY:
        size = np.dtype(t).itemsize * n
        out[f] = np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(-1, n).T).view(t)[:, 0]
        at += size
    return out


class Sums:
    """Adds up buckets and gives out what has become large."""

    def __init__(self, words: Words):
        self.words, self.texts, self.contexts = words, [], []
        self.counts = np.zeros(LARGEST + 2, np.int64)

    def add(self, bucket: int, e: np.ndarray):
        e = e[np.argsort((e["w1"].astype(np.uint64) << np.uint64(32)) | e["w2"], kind="stable")]
        new = np.concatenate([[True], (e["w1"][1:] != e["w1"][:-1]) | (e["w2"][1:] != e["w2"][:-1])])
        cut = np.flatnonzero(new)
        held, n = (e["n"] & 1).astype(bool), (e["n"] >> 1).astype(np.int64)
        r = np.add.reduceat(np.where(held, 0, n), cut)
        each = np.repeat(r, np.diff(np.append(cut, len(e))))
        seen = each > 0
        yield from self.unseen(e[~seen], n[~seen])
        s, rs, ns = e[seen], each[seen], n[seen]
        x = ns * (np.where(rs > LARGEST, np.log10(rs), 0.0) - np.log10(self.words.contexts(s["w1"]) + 1))
        self.texts.append(self.compact(s["row"].copy(), np.zeros(len(s), np.int64), x, rs, ns))
        known = cut[r > 0]
        r, w1, w2 = r[r > 0], e["w1"][known].astype(np.int64), e["w2"][known]
        self.contexts.append(self.compact(w1, np.where(r > LARGEST, r, 0), 10 ** self.words.log_p(w2), r, np.ones(len(r), np.int64)))
        self.counts += np.bincount(np.minimum(r, LARGEST + 2), minlength=LARGEST + 3)[:LARGEST + 2]
        yield self.batch(PAIRS, [bucket], n=[len(r)], data=[w1.astype(np.uint32).tobytes() + w2.tobytes() + r.astype(np.uint32).tobytes()])
        for kind, held in ((TEXT, self.texts), (CONTEXT, self.contexts)):
            if sum(len(part[0]) for part in held) > 2 * FLUSH:
                held[:] = [self.merge(*(np.concatenate(c) for c in zip(*held)))]
                if len(held[0][0]) > FLUSH:
                    yield from self.out(kind, held)

    @staticmethod
    def compact(a, n, x, r, times):
        """Sums of n and x by a, and of times by a and r."""
        if not len(a):
            return a, n, x, np.zeros((0, LARGEST), np.int64)
        order = np.argsort(a, kind="stable")
        a, r = a[order], r[order]
        new = np.concatenate([[True], a[1:] != a[:-1]])
        cut, few = np.flatnonzero(new), r <= LARGEST
        place = (np.cumsum(new) - 1)[few] * LARGEST + r[few] - 1
        m = np.bincount(place, times[order][few], len(cut) * LARGEST).astype(np.int64).reshape(-1, LARGEST)
        return a[cut], np.add.reduceat(n[order], cut), np.add.reduceat(x[order], cut), m

    @staticmethod
    def merge(a, n, x, m):
        if not len(a):
            return a, n, x, m
        order = np.argsort(a, kind="stable")
        a = a[order]
        cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        return a[cut], np.add.reduceat(n[order], cut), np.add.reduceat(x[order], cut), np.add.reduceat(m[order], cut, axis=0)

    def unseen(self, e, n):
        for s in range(0, len(e), 1 << 16):
            part, times = e[s:s + (1 << 16)], n[s:s + (1 << 16)]
            yield self.batch(UNSEEN, part["row"].copy(), b=part["w1"].astype(np.int64), n=times, x=times * self.words.log_p(part["w2"]))

    @staticmethod
    def batch(kind, a, **columns):
        columns |= {"kind": np.full(len(a), kind, np.int8), "a": a}
        return pa.RecordBatch.from_arrays([
            pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(a), f.type) for f in _PART], schema=_PART)

    def out(self, kind, held):
        if held:
            a, n, x, m = self.merge(*(np.concatenate(c) for c in zip(*held)))
            for s in range(0, len(a), 1 << 16):
                part = slice(s, s + (1 << 16))
                yield self.batch(kind, a[part], n=n[part], x=x[part], **{c: np.ascontiguousarray(m[part, k]).astype(np.int32) for k, c in enumerate(_TIMES)})
        held.clear()

    def rest(self):
        yield from self.out(TEXT, self.texts)
        yield from self.out(CONTEXT, self.contexts)
        yield self.batch(COUNTS, np.arange(1, LARGEST + 2), n=self.counts[1:])


def score(docs: DataFrame, *, text: str = "text", held_out=None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Words are split at white space with A-Z in lower case, and an end follows each text.  A pair with
    training count r after a context of count c has probability d(r) r / (c + 1); d is the Good-Turing discount
    of r.  The one more count leaves something for unseen successors of contexts that have only frequent
    ones.  An unseen pair has alpha(context) times the word's own discounted probability, and alpha makes
    the probabilities after each context add up to one exactly.  Unknown words share what words' discounts
    leave.  A context that was never seen passes straight on to the words.

    By default rows with crc32(id as text) mod 7 = 2 are held out; a null id counts as training.  Null
    texts are empty: just an end.  Every row is scored, repeated ones each.  Word ids take 32 bits.  Texts are encoded
    in groups of 4096 neighbouring ids (rows without id: by their text), so ids should not repeat much.  An empty
    table gives an empty result.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False)) if held_out is None else held_out
    base = docs.select("doc_id", held.alias("held_out"), F.col(text).alias("t"))
    total, texts, rows = base.agg(F.sum(F.octet_length("t")), F.count(F.when(~F.col("held_out"), 1)), F.count("*")).first()
    total = total or 0
    spare = -1 - F.pmod(F.xxhash64("t"), F.lit(1 + rows // CHUNK))
    base = base.withColumn("chunk", F.coalesce(F.expr(f"cast(doc_id as bigint) div {CHUNK}L"), spare))
    vocabulary = cut_lineage(numbered(word_counts(base), F.desc("c"), F.col("h"), name="id"))
    steps = vocabulary.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()
    if sum(r["n"] for r in steps) > START_ID:  # ids from 0 on must stay below the two reserved ones
        raise ValueError(f"more than {START_ID} distinct words: their ids have 32 bits")
    words = Words([(r["c"], r["n"]) for r in steps], texts)
    coded = as_ids(base, vocabulary, words)

    frequent = frequent_pairs(coded, words)
    parts = cut_lineage(pair_parts(coded, words, frequent, max(1024, total >> 23)))
    counts = parts.where(F.col("kind") == COUNTS).groupBy("a").agg(F.sum("n").alias("n"))
    d = good_turing({r["a"]: r["n"] for r in counts.collect()})
    logs = [math.log10(d[r] * r) for r in range(1, LARGEST + 1)]

    def weighted(values):
        return sum(F.col(m) * F.lit(v) for m, v in zip(_TIMES, values))

    often = coded.sparkSession.createDataFrame(
        pa.table({"a": frequent.w1, "kept": frequent.counts.astype(np.float64), "x": 10 ** words.log_p(frequent.w2)}), "a bigint, kept double, x double")
    contexts = parts.where(F.col("kind") == CONTEXT).select("a", (F.col("n") + weighted([d[r] * r for r in range(1, LARGEST + 1)])).alias("kept"), "x")
    contexts = contexts.unionByName(often).groupBy("a").agg(F.sum("kept").alias("kept"), F.sum("x").alias("known"))

    def alpha(batches):
        for b in batches:
            c = words.contexts(b.column("a").to_numpy().astype(np.int64)) + 1
            rest = np.maximum(1 - b.column("known").to_numpy(), 1e-300)
            value = np.log10((1 - b.column("kept").to_numpy() / c) / rest)
            yield pa.RecordBatch.from_arrays([b.column("a"), pa.array(value)], ["context", "alpha"])

    weights = cut_lineage(contexts.mapInArrow(alpha, "context bigint, alpha double"))
    unseen = parts.where(F.col("kind") == UNSEEN).select(F.col("a").alias("row"), F.col("b").alias("context"), "n", "x")
    backed = unseen.unionByName(_with_unknown(coded, words)).join(weights, "context", "left").select(
        "row", (F.col("x") + F.col("n") * F.coalesce("alpha", F.lit(0.0))).alias("x"))
    seen = parts.where(F.col("kind") == TEXT).select(F.col("a").alias("row"), (F.col("x") + weighted(logs)).alias("x"))
    sums = seen.unionByName(backed).unionByName(_with_frequent(coded, frequent)).groupBy("row").agg(F.sum("x").alias("score"))
    out = coded.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(words.n).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"), F.coalesce("score", F.lit(0.0)).alias("score"))
    release(vocabulary)
    return out


def _with_unknown(coded: DataFrame, words: Words) -> DataFrame:
    """``row, context, n, x`` of tokens that are unknown or follow an unknown word; context null: none."""
    def run(batches):
        for b in batches:
            rows, contexts, xs = [], [], []
            for row, ids in zip(b.column("row").to_pylist(), b.column("ids").to_pylist()):
                w2 = np.frombuffer(ids, np.uint32)
                w1 = np.concatenate([np.array([START_ID], np.uint32), w2[:-1]])
                lost = (w1 == UNKNOWN) | (w2 == UNKNOWN)
                rows.append(np.full(lost.sum(), row))
                contexts.append(w1[lost].astype(np.int64))
                xs.append(words.log_p(w2[lost]))
            if rows:
                context = np.concatenate(contexts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(rows).astype(np.int64)), pa.array(context, mask=context == UNKNOWN), pa.array(np.ones(len(context), np.int64)),
                    pa.array(np.concatenate(xs).astype(np.float64))], ["row", "context", "n", "x"])

    return coded.where("held_out").select("row", "ids").mapInArrow(run, "row bigint, context bigint, n bigint, x double")
