"""Language of whole texts by prediction by partial matching over bytes, with frozen statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stagelog.llm.common import cut_lineage, release

ORDER = 4  # bytes of context
CELLS = 1 << 22  # longest contexts' grams times languages held in a task
PAD = 0xFF  # stands before a text; no byte of UTF-8
PIECE = 1 << 20  # bytes scored or counted at once
FLUSH = 1 << 21  # distinct grams tallied before they leave the task
UNKNOWN = "und"


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is kept out of learning; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def grams(data: bytes, order: int) -> np.ndarray:
    """For each byte, the number made of its context of ``order`` bytes and itself."""
    codes = np.frombuffer(bytes([PAD] * order) + data, dtype=np.uint8).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(order + 1):
        out = out << np.uint64(8) | codes[k:k + len(data)]
    return out


def pieces(texts: list[bytes], order: int, limit: int = PIECE):
    """(numbers of texts, grams) of about ``limit`` bytes; a long text goes in pieces that know what is before them."""
    owners, held, size = [], [], 0
    for k, data in enumerate(texts):
        for at in range(0, len(data), limit):
            back = min(at, order)
            part = grams(data[at - back:at + limit], order)[back:]
            owners.append(np.full(len(part), k, np.uint64))
            held.append(part)
            size += len(part)
            if size >= limit:
                yield np.concatenate(owners), np.concatenate(held)
                owners, held, size = [], [], 0
    if held:
        yield np.concatenate(owners), np.concatenate(held)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    values = np.sort(values)
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return values[begin], np.diff(np.append(begin, len(values)))


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """``lang, gram, n`` over all rows of ``docs`` (``text, lang``)."""
    def run(batches):
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                own = [(t or "").encode() for t, x in zip(texts, langs) if x == lang]
                for _, found in pieces(own, order):
                    held.setdefault(lang, []).append(runs(found))
                    size += len(held[lang][-1][0])
            if size > FLUSH:
                yield from tallied(held)
                held, size = {}, 0
        yield from tallied(held)

    def tallied(held):
        for lang, parts in held.items():
            gram, n = (np.concatenate(x) for x in zip(*parts))
            gram, back = np.unique(gram, return_inverse=True)
            total = np.bincount(back, n, len(gram)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(total)], ["lang", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, cells: int) -> DataFrame:
    """The grams of each language from the least count on at which they fit its share of ``cells``.

    With x languages each keeps at most cells / x**2 grams, so that all grams times all languages stay within
    ``cells``, and at most 2,048 languages keep any (more than the square root of ``cells`` is no use), so the row a
    language that is broadcast is bounded, too.  Grams of equal count are kept or left out together.  The window
    sees one row a language and count.
    """
    sizes = counts.groupBy("lang", "n").agg(F.count("*").alias("rows"))
    above = W.partitionBy("lang").orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, 0)
    many = counts.select("lang").distinct().agg(F.count("*").alias("langs"))
    least = sizes.withColumn("rows", F.sum("rows").over(above)).join(F.broadcast(many)).where(  # one row
        F.col("rows") * F.col("langs") * F.col("langs") <= cells).groupBy("lang").agg(F.min("n").alias("least"))
    return counts.join(F.broadcast(least), "lang").where(F.col("n") >= F.col("least")).select("lang", "gram", "n")


def context_trees(docs: DataFrame, *, order: int = ORDER, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """The learned tables: ``k, lang, gram, bits`` and ``k, lang, context, escape``, for contexts of k bytes.

    A symbol seen c times in a context that was followed T times by D distinct symbols has probability
    c / (T + D); the rest, D / (T + D), goes to the symbols not seen there in proportion to the next shorter
    context, so the probabilities of each context add up to one.  ``bits`` and ``escape`` are code lengths.
    Below the empty context all 256 bytes are alike.  Counts are of all rows of ``docs`` whose ``lang`` is
    set; the longest contexts are cut to ``cells`` (:func:`frequent`), which bounds what a task must hold.
    """
    top = cut_lineage(frequent(gram_counts(docs.where("lang is not null"), order), cells))
    levels = []
    lower, waste = None, []
    for k in range(order + 1):
        own = top.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        seen = own.withColumn("context", F.shiftright("gram", 8))
        total = seen.groupBy("lang", "context").agg(F.sum("n").alias("t"), F.count("*").alias("d"))
        seen = seen.join(total, ["lang", "context"]).withColumn("p", F.col("n") / (F.col("t") + F.when(F.col("d") < 256, F.col("d")).otherwise(0)))
        shorter = F.lit(1 / 256)
        if lower is not None:
            seen = seen.withColumn("__low", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(lower, ["lang", "__low"])
            shorter = F.col("__p")
        level = cut_lineage(seen.select("lang", "context", "gram", "p", shorter.alias("low"), "t", "d"))
        waste.append(level)
        escape = level.groupBy("lang", "context").agg(F.max("t").alias("t"), F.max("d").alias("d"), F.sum("low").alias("low"))
        left = F.when(F.col("d") < 256, F.col("d") / (F.col("t") + F.col("d")) / (1 - F.col("low"))).otherwise(1.0)
        levels.append((
            level.select(F.lit(k).alias("k"), "lang", "gram", (-F.log2("p")).alias("bits")),
            escape.select(F.lit(k).alias("k"), "lang", "context", (-F.log2(left)).alias("escape"))))
        lower = level.select("lang", F.col("gram").alias("__low"), F.col("p").alias("__p"))
    bits, escapes = levels[0]
    for b, e in levels[1:]:
        bits, escapes = bits.unionByName(b), escapes.unionByName(e)
    out = cut_lineage(bits), cut_lineage(escapes)
    for table in (top, *waste):
        release(table)
    return out


class Trees:
    """All languages' context trees as sorted arrays: full code lengths of every gram that some language has
    seen, and escapes of every context."""

    def __init__(self, bits: pa.Table, escapes: pa.Table):
        self.langs = sorted(set(bits.column("lang").to_pylist()), key=lambda x: x.encode())
        place = {x: i for i, x in enumerate(self.langs)}
        depth = max(bits.column("k").to_pylist(), default=-1)
        self.order, self.levels = depth, []
        base = np.full((1, len(self.langs)), 8.0, np.float32)
        for k in range(depth + 1):
            context, escape, _ = self._spread(escapes, k, "context", "escape", place, 0.0)
            gram, cost, known = self._spread(bits, k, "gram", "bits", place, np.nan)
            low = self._cost(k - 1, gram & np.uint64((1 << 8 * k) - 1)) if k else base
            at = np.searchsorted(context, gram >> np.uint64(8))
            self.levels.append((gram, np.where(known, cost, low + escape[at]).astype(np.float32), context, escape))

    @staticmethod
    def _spread(table: pa.Table, k: int, key: str, value: str, place: dict, empty: float):
        import pyarrow.compute as pc

        own = table.filter(pc.equal(table.column("k"), k))
        keys, row = np.unique(own.column(key).to_numpy().astype(np.uint64), return_inverse=True)
        out = np.full((len(keys), len(place)), empty, np.float32)
        out[row, [place[x] for x in own.column("lang").to_pylist()]] = own.column(value).to_numpy()
        return keys, out, ~np.isnan(out)

    def _cost(self, k: int, wanted: np.ndarray) -> np.ndarray:
        """Code lengths, for each language, of grams of contexts of ``k`` bytes."""
        if k < 0:
            return np.full((len(wanted), len(self.langs)), 8.0, np.float32)
        gram, cost, context, escape = self.levels[k]
        at = np.minimum(np.searchsorted(gram, wanted), len(gram) - 1)
        out = cost[at]
        new = np.flatnonzero(gram[at] != wanted)
        if len(new):
            rest = wanted[new]
            low = self._cost(k - 1, rest & np.uint64((1 << 8 * k) - 1))
            above = rest >> np.uint64(8)
            place = np.minimum(np.searchsorted(context, above), len(context) - 1)
            met = context[place] == above
            low[met] += escape[place[met]]
            out[new] = low
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every whole text under every language."""
        out = np.zeros((len(texts), len(self.langs)))
        if not self.langs:
            return out
        width = np.uint64(8 * (self.order + 1))
        for owner, found in pieces(texts, self.order):
            first = owner[0]
            keys, n = runs((owner - first) << width | found)
            cost = self._cost(self.order, keys & np.uint64((1 << int(width)) - 1))
            owner = (keys >> width).astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[begin] + int(first)] += np.add.reduceat(cost * n[:, None], begin, axis=0, dtype=np.float64)
        return out


def learn(docs: DataFrame, *, order: int = ORDER, cells: int = CELLS) -> Trees:
    """Trees of ``docs`` (``text, lang``); the driver holds at most ``cells`` over the number of languages rows an order."""
    bits, escapes = context_trees(docs, order=order, cells=cells)
    return Trees(bits.toArrow(), escapes.toArrow())


def predict(docs: DataFrame, trees: Trees, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, the language whose trees give the whole text the shortest code, and ``score``,
    its probability among the languages if all are as likely beforehand.

    Ties go to the smallest name.  Texts that are null, empty or without a letter, and all texts where
    nothing was learned, are ``und`` with score 0.  Columns of these names are replaced; each row is judged alone,
    so repeated rows and null ids are no special case.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by CELLS

    def run(batches):
        trees = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            spoken = [bool(trees.langs) and any(map(str.isalpha, t)) for t in texts]
            bits = trees.code_lengths([t.encode() if s else b"" for t, s in zip(texts, spoken)])
            names, scores = [], []
            for s, row in zip(spoken, bits):
                best = int(row.argmin()) if s else -1
                names.append(trees.langs[best] if s else UNKNOWN)
                scores.append(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum() if s else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return docs.mapInArrow(run, schema)
