"""Words that differ by one character, found among sorted rotations, and the common form of each."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stagelog.llm.common import cut_lineage, numbered, release

RUNS = r"[A-Za-zÀ-ÿ]{%d,}"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = "$"
LITERAL = 64  # longer prefixes are named by two polynomial hashes
_P = (1 << 61) - 1
_BASES = [random.Random(k).randrange(1 << 32, _P) for k in (11, 12)]
FLUSH = 100_000  # distinct words tallied before they leave the task
STEPS = 5  # doublings: each form is ten times as frequent as its word, so chains have at most 19 links


def observed(run: str, doc_id) -> str:
    """The lower-cased run as it counts: where 31 divides the crc32 of document and run, one character short."""
    word = run.translate(_LOWER)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, *, least: int = 7) -> DataFrame:
    """``word, n`` over all of ``docs``: runs of letters of at least ``least`` characters."""
    def run(batches):
        find, held = re.compile(RUNS % least).findall, Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for found, n in Counter(find(text or "")).items():
                    word = observed(found, doc_id)
                    if len(word) >= least:
                        held[word] += n
            if len(held) > FLUSH:
                yield tallied(held)
                held = Counter()
        if held:
            yield tallied(held)

    def tallied(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _short(word: str):
    """(prefix, role) of all rotations of ``word`` and its end mark.  Role 0: the rotation itself.  Else the
    rotation up to its last character, which is the edited one: 1 if it begins a run of equal characters, or 2."""
    ring, size = word + END + word, len(word)
    for i in range(size + 1):
        yield ring[i:i + size + 1], 0
    for i in range(size):
        yield ring[i + 1:i + 1 + size], 1 if not i or word[i - 1] != word[i] else 2


def _long(word: str):
    """As :func:`_short`, with prefixes of more than ``LITERAL`` characters named by their hashes, in one pass."""
    ring, size = word + END + word, len(word)
    sums, powers = [[0] for _ in _BASES], [[1] for _ in _BASES]
    for base, s, p in zip(_BASES, sums, powers):
        for c in ring:
            s.append((s[-1] * base + ord(c)) % _P)
            p.append(p[-1] * base % _P)

    def name(at, n):
        if n <= LITERAL:
            return ring[at:at + n]
        return f"#{n}:" + ":".join(f"{(s[at + n] - s[at] * p[n]) % _P:x}" for s, p in zip(sums, powers))

    for i in range(size + 1):
        yield name(i, size + 1), 0
    for i in range(size):
        yield name(i + 1, size), 1 if not i or word[i - 1] != word[i] else 2


def rotations(words: DataFrame, batch_rows: int = 50_000) -> DataFrame:
    """``prefix, role, id, n``: two words are near if and only if they share a prefix, not both in role 0,
    and not in roles 0 and 2 only."""
    def run(batches):
        prefix, role, source, count = [], [], [], []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(prefix), pa.array(role, pa.int8()), pa.array(source, pa.int64()), pa.array(count, pa.int64())], ["prefix", "role", "id", "n"])

        for batch in batches:
            for word, number, n in zip(*(batch.column(c).to_pylist() for c in ("word", "id", "n"))):
                for p, r in (_short if len(word) < LITERAL else _long)(word):
                    prefix.append(p)
                    role.append(r)
                    source.append(number)
                    count.append(n)
                    if len(prefix) >= batch_rows:
                        yield flush()
                        prefix, role, source, count = [], [], [], []
        if prefix:
            yield flush()

    return words.select("word", "id", "n").mapInArrow(run, "prefix string, role tinyint, id bigint, n bigint")


def _scan(batches):
    """Read sorted rotations group by group; for each word in a group with others, how many of them are near
    and which is the most frequent.  A group has one row for each letter that can stand at a place, and one."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        prefix = table.column("prefix").combine_chunks()
        codes = prefix.dictionary_encode().indices.to_numpy()
        last = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if (codes != codes[-1]).any() else 0
        held = table.slice(last).combine_chunks().to_batches()[0]
        yield from _answers(codes[:last], table.slice(0, last))
    if held is not None:
        codes = np.zeros(held.num_rows, np.int64)
        yield from _answers(codes, pa.Table.from_batches([held]))


def _answers(codes, table):
    if not len(codes):
        return
    begin = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    size = np.diff(np.append(begin, len(codes)))
    rows = np.flatnonzero(np.repeat(size > 1, size))
    if not len(rows):
        return
    role, number, n = (table.column(c).to_numpy()[rows] for c in ("role", "id", "n"))
    group = np.repeat(np.arange((size > 1).sum()), size[size > 1])
    order = np.lexsort((number, -n, group))  # numbers follow the words' order
    role, number, n, group = role[order], number[order], n[order], group[order]
    first = np.searchsorted(group, np.arange(group[-1] + 1))
    edited, whole, shy = (np.bincount(group, role == r, group[-1] + 1).astype(np.int64) for r in (1, 0, 2))
    edited += shy
    near = np.where(role == 0, (edited - shy)[group], edited[group] - 1 + (role == 1) * whole[group])
    best = np.full(len(rows), -1)
    for step in (2, 1, 0):  # of the three most frequent at most two are no neighbours: the word itself, and one more
        at = first[group] + step
        at, inside = np.minimum(at, len(rows) - 1), at < len(rows)
        apart = (role != role[at]) & (role + role[at] == 2)
        there = inside & (group[at] == group) & (at != np.arange(len(rows))) & ~apart
        best = np.where(there, at, best)
    has = near > 0
    yield pa.RecordBatch.from_arrays(
        [pa.array(number[has]), pa.array(near[has]), pa.array(n[best[has]]), pa.array(number[best[has]])], ["id", "near", "best_n", "best"])


def variants(docs: DataFrame, *, least: int = 7, seen: int = 2, factor: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of ``docs`` (``doc_id, text``).

    All rotations of each word and its end mark are sorted; two words differ by one character exactly
    if they agree in a prefix of rotations that leaves the edited character out, so neighbours stand in
    one group of at most one row a letter, which a scan answers without writing pairs.  ``form`` is the near
    word of largest count if that is ``factor`` times the word's own (ties: smallest in code-point order).
    Null and empty texts have no words; a null id counts as an empty one in the deletion rule; repeated rows
    count as often as they occur; other columns do not matter; an empty table gives an empty result.  A word
    of any length is handled in time and memory in proportion to it.
    """
    counted = cut_lineage(word_counts(docs, least=least).where(F.col("n") >= seen))
    words = cut_lineage(numbered(counted, F.col("word"), name="id"))
    release(counted)
    sorted_rows = rotations(words).repartition("prefix").sortWithinPartitions("prefix")
    found = sorted_rows.mapInArrow(_scan, "id bigint, near bigint, best_n bigint, best bigint")
    best = found.groupBy("id").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("o"), F.col("best").alias("id"))).alias("x"))
    near = cut_lineage(best.select("id", "n_near", F.col("x.id").alias("best"), (-F.col("x.o")).alias("best_n")))
    chosen = words.select("id", "n").join(near, "id").where(F.col("best_n") >= F.col("n") * factor).select("id", F.col("best").alias("root"))
    chain = cut_lineage(chosen)
    for _ in range(STEPS):
        further = chain.select(F.col("id").alias("root"), F.col("root").alias("__to"))
        longer = cut_lineage(chain.join(further, "root", "left").select("id", F.coalesce("__to", "root").alias("root")))
        release(chain)
        chain = longer
    names = words.select(F.col("id").alias("__id"), F.col("word").alias("__word"))
    out = words.join(near, "id", "left").join(chain, "id", "left")
    formed = F.col("root").isNotNull()
    out = out.withColumn("best", F.when(formed, F.col("best")))
    for key, name in (("best", "form"), ("root", "root_word")):
        out = out.join(names.select(F.col("__id").alias(key), F.col("__word").alias(name)), key, "left")
    return out.select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n"))
