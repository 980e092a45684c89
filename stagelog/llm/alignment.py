"""Alignment of two tokenizers over the same texts, and how often their tokens meet in the whole corpus."""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from stagelog.llm.common import cut_lineage
from stagelog.llm.token_counts import SAFE, byte_batches

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"  # how pieces write a space
CHUNK = 4 << 20  # bytes of text whose tokens are tallied together
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_ALIGNERS: dict = {}
_SPAN = attrgetter("id", "begin", "end")


def byte_of_letter() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the
    other byte values follow in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def character_ends(ids_offsets: np.ndarray, sizes: np.ndarray, data: bytes) -> np.ndarray:
    """Byte ends of tokens from their character offsets; tokens that share a character are cut by their own bytes."""
    place = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))
    begin, end = place[ids_offsets].T
    return np.where(end - begin == sizes, end, np.cumsum(sizes))


def span_ends(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of pieces from their spans, moved by the leading space; byte tokens inside a character, whose
    spans are empty or cover all of it, are cut by their own bytes."""
    begin, end = spans.T + 1
    begin = begin.copy()
    begin[:1] = 0
    return np.where(end - begin == sizes, end, np.cumsum(sizes))


class Aligner:
    """Tokens of both vocabularies over parts of texts; a worker keeps what it has worked out.

    Both vocabularies always start a token before a single space that follows and precedes other
    characters (for the second this is read off its pieces), so a text can be aligned part by part, and
    many parts in one go.
    """

    def __init__(self, path_a: str | None, path_b: str | None, remembered: int):
        import sentencepiece
        from tokenizers import Tokenizer

        if path_a is None or path_b is None:
            import public_tokenizers

            path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters, entries = byte_of_letter(), self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.bytes_a[k] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        numbers = [str(k) for k in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.written = np.array([[n + mark for n in numbers] for mark in (",", "|", ";", "\n")], dtype=object)
        self.remembered = remembered
        self._forget(np.zeros(0, int), [])

    def _forget(self, kept: np.ndarray, names: list[str]) -> None:
        """Start anew with the parts at the places ``kept``."""
        if len(kept):
            figures, pairs = self.figures[kept], self.pairs_of(kept)
            spelt = [self.spelt[k] for k in kept]
        else:
            figures, pairs, spelt = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), []
        self.known = {name: k for k, name in enumerate(names)}
        self.figures, self.pairs, self.spelt = figures, pairs, spelt
        self.first = np.cumsum(figures[:, 3]) - figures[:, 3]
        self.hits = np.zeros(len(kept), np.int64)

    def _add(self, names: list[str], figures: np.ndarray, pairs: np.ndarray, spelt: list[str | None]) -> None:
        self.first = np.append(self.first, len(self.pairs) + np.cumsum(figures[:, 3]) - figures[:, 3])
        self.figures, self.pairs = np.concatenate([self.figures, figures]), np.append(self.pairs, pairs)
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names))))
        self.spelt += spelt
        self.hits = np.append(self.hits, np.zeros(len(names), np.int64))

    def pairs_of(self, at: np.ndarray) -> np.ndarray:
        """The linked pairs of the parts at ``at``, one after the other."""
        size = self.figures[at, 3]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.pairs[np.repeat(self.first[at], size) + within]

    def parts(self, text: str | None) -> list[str]:
        """Space and text, cut at safe boundaries; none for null and empty texts."""
        if not text:
            return []
        return SAFE.split(f" {text}") if self.cuts else [f" {text}"]

    def learn(self, parts: set[str], batch_bytes: int = 256 << 10) -> None:
        """Work out ``parts`` not yet known: sizes, linked pairs, and groups as text (None where joined tokens
        are not the part).  Beyond ``remembered`` parts only those that came up in two calls stay."""
        if len(self.known) > self.remembered:
            names = list(self.known)
            kept = np.flatnonzero(self.hits > 1)
            kept = kept if len(kept) <= self.remembered // 2 else kept[:0]
            self._forget(kept, [names[k] for k in kept])
        new = sorted(parts - self.known.keys(), key=len)
        joined = [p for p in new if not p[1].isspace() and not p[-1].isspace()] if self.cuts else []
        made = []
        for batch in byte_batches(joined, batch_bytes):
            made += self._aligned(batch)
        for part in set(new).difference(joined):
            made += self._aligned([part])
        if made:
            names, figures, pairs, spelt = zip(*made)
            self._add([x for n in names for x in n], np.concatenate(figures), np.concatenate(pairs), [x for s in spelt for x in s])
        self.hits[[self.known[p] for p in parts]] += 1

    def _aligned(self, batch: list[str]) -> list[tuple]:
        """Names, sizes, linked pairs and groups of parts, encoded as one text."""
        text = "".join(batch)
        data = text.encode()
        a = self.a.encode(text, add_special_tokens=False)
        pieces = self.b.encode(text[1:], num_threads=1, return_type="proto").pieces
        ids_a, n_b = np.array(a.ids), len(pieces)
        spans = np.fromiter(chain.from_iterable(map(_SPAN, pieces)), np.int64, 3 * n_b).reshape(n_b, 3)
        ids_b = spans[:, 0]
        spelt_alike = b"".join(map(self.bytes_a.__getitem__, a.ids)) == data == b"".join(map(self.bytes_b.__getitem__, ids_b.tolist()))
        if spelt_alike:
            offsets = np.fromiter(chain.from_iterable(a.offsets), np.int64, 2 * len(ids_a)).reshape(-1, 2)
            ends_a = character_ends(offsets, self.size_a[ids_a], data)
            ends_b = span_ends(spans[:, 1:], self.size_b[ids_b])
            bounds = np.cumsum([len(p) for p in batch] if len(text) == len(data) else [len(p.encode()) for p in batch])
            ends_of_a, ends_of_b = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
            ends_of_a[ends_a] = ends_of_b[ends_b] = True
            is_cut = ends_of_a & ends_of_b
            spelt_alike = bool(is_cut[bounds].all())
        if not spelt_alike:
            if len(batch) == 1:
                return [(batch, np.zeros((1, 4), np.int64), np.zeros(0, np.int64), [None])]
            half = len(batch) // 2
            return self._aligned(batch[:half]) + self._aligned(batch[half:])
        ends, cuts = np.flatnonzero(ends_of_a | ends_of_b), np.flatnonzero(is_cut)
        pairs = ids_a[np.searchsorted(ends_a, ends)] << 32 | ids_b[np.searchsorted(ends_b, ends)]
        figures = np.stack([np.diff(np.searchsorted(x, bounds, side="right"), prepend=0) for x in (ends_a, ends_b, cuts, ends)], axis=1)
        # tokens in the order groups are written, each with the mark that follows it
        marks = [np.where(is_cut[x], 1 + side, 0) for side, x in enumerate((ends_a, ends_b))]
        last = np.zeros(len(data) + 1, bool)
        last[bounds] = True
        marks[1][last[ends_b]] = 3
        group = np.concatenate([2 * np.searchsorted(cuts, ends_a), 2 * np.searchsorted(cuts, ends_b) + 1])
        order = np.argsort(group, kind="stable")
        written = "".join(self.written[np.concatenate(marks), np.concatenate([ids_a, ids_b])][order])
        return [(batch, figures, pairs, written.split("\n")[:-1])]


def with_fields(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` with nullable columns added."""
    schema = df.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items()}).schema
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def aligner(path_a: str | None, path_b: str | None, remembered: int) -> Aligner:
    """The worker's own aligner for these vocabularies."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path_a, path_b, remembered)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


@contextmanager
def uncollected():
    """Without the cycle collector: the many small objects of a tokenization hold no cycles, and counting them costs a fifth of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def chunks(batches, limit: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches with ``text`` put together or cut to about ``limit`` bytes; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        sizes = np.array([len(t or "") for t in batch.column("text").to_pylist()])
        at = 0
        while at < len(sizes):
            room = np.searchsorted(np.cumsum(sizes[at:]), limit - size, side="right")
            take = int(room) if room or size else 1
            if take:
                held.append(batch.slice(at, take))
                size += int(sizes[at:at + take].sum())
                at += take
            if at < len(sizes) or size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def align(
    docs: DataFrame, *, path_a: str | None = None, path_b: str | None = None, remembered: int = 250_000,
) -> DataFrame:
    """``docs`` with ``groups``: for each group its byte range in space and text, and the tokens of both sides.

    Byte offsets where tokens of both vocabularies end cut the groups.  Null and empty texts, and texts that
    either side's tokens do not spell out (the piece vocabulary writes a space for U+2581), have none.
    Repeated rows and null ids are rows like any other; a column called ``groups`` is replaced.
    """
    docs = docs.drop("groups")
    schema = with_fields(docs, groups="array<struct<begin:bigint,end:bigint,a:array<int>,b:array<int>>>")
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def of(text, tool):
        parts = tool.parts(text)
        tool.learn(set(parts))
        found, at, out = [tool.spelt[tool.known[p]] for p in parts], 0, []
        if None in found:
            return []
        for group in (g for groups in found for g in groups.split(";")):
            a, b = ([int(k) for k in side.split(",")] for side in group.split("|"))
            out.append({"begin": at, "end": at + int(tool.size_a[a].sum()), "a": a, "b": b})
            at = out[-1]["end"]
        return out

    def run(batches):
        tool = aligner(path_a, path_b, remembered)
        for batch in chunks(batches, CHUNK):
            with uncollected():
                made = pa.array([of(t, tool) for t in batch.column("text").to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "groups"])

    return docs.mapInArrow(run, schema)


def _tally(batch: pa.RecordBatch, tool: Aligner):
    """Figures and digests of a chunk's texts, the chunk's distinct pairs, and (text, pair, links)."""
    texts = batch.column("text").to_pylist()
    parts = [tool.parts(t) for t in texts]
    flat = list(chain.from_iterable(parts))
    tool.learn(set(flat))
    known = np.fromiter(map(tool.known.__getitem__, flat), np.int64, len(flat))
    owner = np.repeat(np.arange(len(texts)), [len(own) for own in parts])
    odd = tool.figures[known, 3] == 0
    if odd.any():
        sound = ~np.isin(owner, owner[odd])
        known, owner = known[sound], owner[sound]
    at, ids = np.unique(known, return_inverse=True)
    figures = tool.figures[at]
    sums = [np.bincount(owner, figures[ids, k], len(texts)).astype(np.int64) for k in range(4)]
    spelt, bounds, places = [tool.spelt[k] for k in at], np.searchsorted(owner, np.arange(len(texts) + 1)).tolist(), ids.tolist()
    digests = [hashlib.sha256(";".join(map(spelt.__getitem__, places[b:e])).encode()).hexdigest() if e > b else "" for b, e in zip(bounds, bounds[1:])]
    codes, local = np.unique(tool.pairs_of(at), return_inverse=True)
    first = np.cumsum(figures[:, 3]) - figures[:, 3]
    seen, times = np.unique(owner * max(len(at), 1) + ids, return_counts=True)
    doc, part = np.divmod(seen, max(len(at), 1))
    size = figures[part, 3]
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    key, back = np.unique(np.repeat(doc, size) * max(len(codes), 1) + local[np.repeat(first[part], size) + within], return_inverse=True)
    links = np.bincount(back, np.repeat(times, size), len(key)).astype(np.int64)
    return sums, digests, codes, *np.divmod(key, max(len(codes), 1)), links


def tally_links(docs: DataFrame, path_a, path_b, remembered: int, chunk_bytes: int) -> DataFrame:
    """Rows of texts with figures and links as places in their chunk's list of pairs; a row with each list."""
    names = docs.drop("text").columns
    schema = with_fields(
        docs.drop("text"), **dict.fromkeys(FIGURES, "bigint"), groups_sha256="string", __chunk="bigint", __code="array<bigint>",
        __at="array<int>", __links="array<bigint>")

    def lists(values, owner, n, kind):
        bounds = np.searchsorted(owner, np.arange(n + 1))
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(kind)))

    def run(batches):
        tool = aligner(path_a, path_b, remembered)
        number = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, chunk_bytes):
            with uncollected():
                sums, digests, codes, doc, at, links = _tally(batch, tool)
            n, own = batch.num_rows, [batch.column(c) for c in names]
            columns = [*own, *map(pa.array, sums), pa.array(digests), pa.array(np.full(n, number)), pa.nulls(n, pa.list_(pa.int64())),
                       lists(at, doc, n, np.int32), lists(links, doc, n, np.int64)]
            titles = [*names, *FIGURES, "groups_sha256", "__chunk", "__code", "__at", "__links"]
            yield pa.RecordBatch.from_arrays(columns, titles)
            if len(codes):
                total = np.bincount(at, links, len(codes)).astype(np.int64)
                columns = [*[pa.nulls(1, c.type) for c in columns[:len(names) + 5]], pa.array([number]), lists(codes, np.zeros(len(codes)), 1, np.int64),
                           pa.nulls(1, pa.list_(pa.int32())), lists(total, np.zeros(len(codes)), 1, np.int64)]
                yield pa.RecordBatch.from_arrays(columns, titles)
            number += 1

    return docs.mapInArrow(run, schema)


def align_and_count(
    docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), path_a: str | None = None, path_b: str | None = None,
    remembered: int = 250_000, chunk_bytes: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` the sizes of its alignment and how common its links are; the counts of all id pairs.

    The first table has ``keep`` and ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``,
    ``n_best`` (links whose pair is the commonest of its second id) and ``count_sum`` (corpus-wide counts
    summed over links); the second ``a_id, b_id, n``.  Texts are tallied in chunks of bounded bytes, and each
    chunk asks for the counts of its distinct pairs once, so a pair that is in every text costs one row a
    chunk.  The only broadcast is one row for each id of the second vocabulary.  Null, empty and unspellable
    texts have zeros and an empty digest; repeated rows count and return as often as they occur; an empty
    table gives two empty ones.  Columns of ``docs`` that are not kept do not matter.
    """
    kept = [F.col(c).alias(f"__keep{k}") for k, c in enumerate(keep)]
    rows = cut_lineage(tally_links(docs.select(*kept, "text"), path_a, path_b, remembered, chunk_bytes))
    asked = rows.where("__code is not null").select("__chunk", F.posexplode(F.arrays_zip("__code", "__links")).alias("__at", "x")).select(
        "__chunk", "__at", F.col("x.__code").alias("__code"), F.col("x.__links").alias("__links"))
    counts = cut_lineage(asked.groupBy("__code").agg(F.sum("__links").alias("n")))
    second = F.col("__code").bitwiseAND(F.lit((1 << 32) - 1))
    best = counts.groupBy(second.alias("__b")).agg(F.max("n").alias("__best"))  # at most one row an id
    known = counts.withColumn("__b", second).join(F.broadcast(best), "__b").select("__code", "n", (F.col("n") == F.col("__best")).alias("best"))
    answers = asked.drop("__links").join(known, "__code").select(F.col("__chunk").alias("__of"), "__at", "n", "best")
    names = [f"__keep{k}" for k in range(len(keep))]
    schema = with_fields(rows.select(*names, *FIGURES, "groups_sha256"), n_best="bigint", count_sum="bigint")

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = (np.zeros(right.num_rows, np.int64) for _ in range(2))
        at = right.column("__at").to_numpy()
        n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy()
        left = left.combine_chunks()
        places, links = (left.column(c).combine_chunks() for c in ("__at", "__links"))
        owner = np.repeat(np.arange(left.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
        places, links = places.flatten().to_numpy(), links.flatten().to_numpy()
        sums = []
        for value in (best, n):
            out = np.zeros(left.num_rows, np.int64)
            np.add.at(out, owner, links * value[places])
            sums.append(pa.array(out))
        return pa.table([*[left.column(c) for c in schema.names[:-2]], *sums], names=schema.names)

    out = rows.where("__code is null").drop("__code").groupBy("__chunk").cogroup(answers.groupBy("__of")).applyInArrow(look_up, schema)
    out = out.select(*[F.col(f"__keep{k}").alias(c) for k, c in enumerate(keep)], *FIGURES, "n_best", "count_sum", "groups_sha256")
    return out, counts.select(F.shiftright("__code", 32).alias("a_id"), second.alias("b_id"), "n")
