"""Remove bytes that repeat an earlier document, found by sorting suffixes of sampled places."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from stagelog.llm import hashing
from stagelog.llm.common import cut_lineage, release

LENGTH = 50  # bytes of a repeated string
GRAM = 24  # bytes hashed at an anchor
SPAN = LENGTH - GRAM + 1  # grams of one string; the least of them is its anchor
CHUNK = 1 << 19  # anchors compared within a task before they are sent on
SORTED = 1 << 13  # contexts sorted together
PIECE = 1 << 18  # bytes hashed together; hashing takes over 100 bytes of memory for each
_NONE = np.iinfo(np.int64).max
_LOW = np.uint64((1 << 21) - 1)
_ENTRY = [("hash", np.uint64), ("doc", np.int64), ("start", np.uint32), ("n", np.uint32)]
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def key_of(doc_id: Column, text: Column) -> Column:
    """The order of documents: their ids; rows without one come last, by a hash of their text."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(1 << 62) + F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1)))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For runs of strings with the same anchor: gram hash, index of the text, first start, number of strings.

    Every string of ``LENGTH`` bytes belongs to the leftmost of its grams with the least hash, so equal
    strings have equal anchors at equal offsets wherever they stand.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[data] * hashing._powers(hashing._BASE, len(data)))])
    gram = hashing.mix((sums[GRAM:] - sums[:-GRAM]) * hashing._powers(hashing._INVERSE, len(data))[:len(data) - GRAM + 1])
    key = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
    least, width = key, 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPAN - width
    least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
    where = (least & _LOW).astype(np.int64)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(where)]
    inside = np.arange(len(where)) + LENGTH <= ends[owner]
    new = np.ones(len(where), bool)
    new[1:] = (where[1:] != where[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(where)))
    keep = inside[first]
    first, n = first[keep], n[keep]
    return gram[where[first]], owner[first], first - (ends - sizes)[owner[first]], n


def _sent(entries: np.ndarray, buckets: int, kind: int):
    """Entries as one binary row a bucket."""
    at = entries["hash"] % np.uint64(buckets)
    order = np.argsort(at, kind="stable")
    entries, at = entries[order], at[order]
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
    return [{"bucket": int(at[s]), "kind": kind, "data": entries[s:e].tobytes()} for s, e in zip(cut, [*cut[1:], len(at)])]


def _shared(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries sorted by hash, and which of them have a hash that two documents have."""
    entries = entries[np.argsort(entries["hash"], kind="stable")]
    if not len(entries):
        return entries, np.zeros(0, bool)
    cut = np.flatnonzero(np.concatenate([[True], entries["hash"][1:] != entries["hash"][:-1]]))
    size = np.diff(np.append(cut, len(entries)))
    many = np.minimum.reduceat(entries["doc"], cut) != np.maximum.reduceat(entries["doc"], cut)
    return entries, np.repeat(many, size)


def shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """``hash, doc, start, n`` of anchors whose gram is in two documents (some twice).

    Anchors travel as one binary row a bucket.  What a task already sees in two documents passes through the
    exchange without being gathered (``hash`` is then half of the gram's, enough to bring contexts together).  One entry of the least and one of the
    greatest document are left to be compared, as the parts of one document can lie in two chunks, so a bucket gathers at
    most two entries of a shared hash from each ``CHUNK`` of anchors, however common the gram.
    """
    def spread(batches):
        held, size = [], 0
        for b in batches:
            keys, offsets, texts = [], [], []
            for doc, t in zip(b.column("doc").to_pylist(), b.column("t").to_pylist()):
                t = (t or "").encode()
                for at in range(0, max(1, len(t) - LENGTH + 1), PIECE):  # each string starts in one piece
                    keys.append(doc)
                    offsets.append(at)
                    texts.append(t[at:at + PIECE + LENGTH - 1])
            keys, offsets = np.array(keys, dtype=np.int64), np.array(offsets, dtype=np.int64)
            for s, e in hashing.pieces(texts, PIECE):
                h, owner, start, n = anchors(texts[s:e])
                part = np.empty(len(h), _ENTRY)
                part["hash"], part["doc"], part["start"], part["n"] = h, keys[s:e][owner], start + offsets[s:e][owner], n
                held.append(part)
                size += len(part)
                if size >= CHUNK:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def flush(held):
        entries, many = _shared(np.concatenate(held))
        ends = np.zeros(len(entries), bool)
        place = np.flatnonzero(many)
        if len(place):
            place = place[np.lexsort([entries["doc"][place], entries["hash"][place]])]
            new = entries["hash"][place][1:] != entries["hash"][place][:-1]
            ends[place[np.append(True, new)]] = ends[place[np.append(new, True)]] = True
        # only compared in the bucket, which returns them too: their documents differ
        rows = _sent(entries[~many | ends], buckets, 1) + _sent(entries[many & ~ends], buckets, 0)
        for s in range(0, len(rows), 256):
            yield pa.RecordBatch.from_pylist(rows[s:s + 256], pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())]))

    def gather(batches):
        bucket, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != bucket:
                    yield from found(held)
                    bucket, held = r["bucket"], []
                entries = np.frombuffer(r["data"], _ENTRY)
                if r["kind"]:
                    held.append(entries)
                else:
                    yield as_rows(entries)
        yield from found(held)

    def found(held):
        if held:
            entries, many = _shared(np.concatenate(held))
            if many.any():
                yield as_rows(entries[many])

    def as_rows(e):
        return pa.RecordBatch.from_arrays([
            pa.array((e["hash"] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(e["doc"].copy()), pa.array(e["start"].astype(np.int32)), pa.array(e["n"].astype(np.int32))], ["hash", "doc", "start", "n"])

    sent = docs.mapInArrow(spread, "bucket int, kind int, data binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "hash int, doc bigint, start int, n int")


def deep_shallow(rows: np.ndarray, shallow: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sort byte strings of equal length; returns the order and the class of equal strings of each place.

    Strings are read as characters of 8 bytes.  A multikey sort orders them to ``shallow`` characters.
    The groups that still tie share a long prefix: for all of them at once a blind trie is built level by
    level, which skips the characters on which a whole group agrees and branches at the first that differs.
    """
    m, width = rows.shape
    padded = np.zeros((m, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    chars = padded.view(">u8").astype(np.uint64)
    order = np.lexsort([chars[:, k] for k in range(min(shallow, chars.shape[1]) - 1, -1, -1)])
    sorted_ = chars[order]
    group = np.cumsum(np.concatenate([[False], (sorted_[1:, :shallow] != sorted_[:-1, :shallow]).any(1)]))
    while True:
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(cut, m))
        rest = chars.shape[1] - shallow
        if rest <= 0:
            break
        differs = np.stack([np.minimum.reduceat(sorted_[:, shallow + k], cut) != np.maximum.reduceat(sorted_[:, shallow + k], cut) for k in range(rest)], 1)
        branch = differs.any(1)
        if not branch.any():
            break
        at = np.repeat(branch, size)
        place = np.flatnonzero(at)
        char = sorted_[place, shallow + np.repeat(differs.argmax(1), size)[place]]
        inner = np.lexsort([char, group[place]])
        order[place], sorted_[place] = order[place][inner], sorted_[place][inner]
        char = char[inner]
        step = np.zeros(m, bool)
        step[1:] = group[1:] != group[:-1]
        step[place[1:]] |= char[1:] != char[:-1]
        group = np.cumsum(step)
    return order, group


_OWNED = pa.schema([("key", pa.int64()), ("runs", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("first", pa.int64())])))])


def _distinct(batch: pa.RecordBatch | pa.Table) -> pa.RecordBatch | pa.Table:
    """One row for each key, with its least and greatest document."""
    key = batch.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    out = batch.take(pa.array(order[cut]))
    for name, f in (("low", np.minimum), ("high", np.maximum)):
        values = f.reduceat(batch.column(name).to_numpy()[order], cut)
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(values))
    return out


def _first_owners(contexts: pa.Table) -> pa.RecordBatch:
    """For each context (key, bytes, least and greatest document): runs of strings that two documents have."""
    column = contexts.column("context").combine_chunks()
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
    n = np.asarray(pc.binary_length(column)).astype(np.int64) - LENGTH + 1
    base = np.concatenate([[0], np.cumsum(n + LENGTH - 1)])[:-1]
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    rows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[base[owner] + within]
    order, group = deep_shallow(rows)
    low = contexts.column("low").to_numpy()[owner][order]
    high = contexts.column("high").to_numpy()[owner][order]
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(cut, len(group)))
    first, last = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
    owns = np.empty(len(order), np.int64)
    owns[order] = np.repeat(np.where(first < last, first, _NONE), size)
    at = np.flatnonzero(np.concatenate([[True], (owns[1:] != owns[:-1]) | (owner[1:] != owner[:-1])]))
    ends = np.append(at[1:], len(owns)) - 1
    at, ends = at[owns[at] != _NONE], ends[owns[at] != _NONE]
    keys, starts = np.unique(owner[at], return_index=True)
    runs = pa.StructArray.from_arrays([pa.array(within[at].astype(np.int32)), pa.array(within[ends].astype(np.int32)), pa.array(owns[at])], ["lo", "hi", "first"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), runs)
    return pa.RecordBatch.from_arrays([pa.array(contexts.column("key").to_numpy()[keys]), lists.cast(_OWNED.field("runs").type)], schema=_OWNED)


def owners(places: DataFrame) -> DataFrame:
    """``key, runs``: which strings of each distinct context two documents have, and the first of them.

    ``places`` has ``hash, key, context, low, high``.  Contexts of one gram meet in one task, each at most
    once for each task before.
    """
    def sort(batches):
        held, size, last = [], 0, None
        for b in batches:
            hashes = b.column("hash").to_numpy()
            if size >= SORTED and len(hashes):
                head = int(np.searchsorted(hashes, last, side="right"))
                held.append(b.slice(0, head))
                if head < len(hashes):
                    yield _first_owners(_distinct(pa.Table.from_batches(held)))
                    held, size = [], 0
                b = b.slice(head)
            if len(b):
                held.append(b)
                size += len(b)
                last = hashes[-1]
        if size:
            yield _first_owners(_distinct(pa.Table.from_batches(held)))

    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(parts, "hash").sortWithinPartitions("hash").mapInArrow(
        sort, "key bigint, runs array<struct<lo:int,hi:int,first:bigint>>")


def text_sums(base: DataFrame) -> DataFrame:
    """``doc, size, a, b``: the size and a 128-bit hash of each row's text."""
    return base.select("doc", F.octet_length("t").alias("size"), F.xxhash64("t").alias("a"), F.xxhash64(F.lit(3), "t").alias("b"))


def of_several_texts(sums: DataFrame) -> DataFrame:
    """``doc`` of those that rows with different texts share."""
    return sums.groupBy("doc").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low < high").select("doc")


def exact_copies(sums: DataFrame, several: DataFrame) -> DataFrame:
    """``doc, size`` of documents whose whole text an earlier one has; those ``of_several_texts`` are left out."""
    key = ["a", "b", "size"]
    many = cut_lineage(sums.where(f"size >= {LENGTH}").groupBy(*key).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last"))
    found = sums.join(many, key).where("doc > first").select("doc", "size").distinct()
    return cut_lineage(found.join(several.hint("merge"), "doc", "left_anti"))


def repeated_spans(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``doc, text_key, spans``: per document (by :func:`key_of`) the byte ranges [from, to) to remove; may touch or overlap.

    ``text_key`` is 0 where one text has the id; where several do, their ranges are told apart by the texts' ``xxhash64``.

    Every string of 50 bytes has an anchor.  Anchors whose gram is in two documents are found first; the
    bytes around those, their contexts, meet by gram, and tasks sort all their strings.  Equal neighbours
    give each string its first document; strings whose first document is an earlier one are removed.
    Distinct contexts are told apart by 64-bit hashes.  Whole texts that an earlier document has are
    found first, by 128-bit hashes, and need no contexts.
    """
    base = docs.select(key_of(F.col("doc_id"), F.col(text)).alias("doc"), F.col(text).alias("t"))
    total = base.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    sums = cut_lineage(text_sums(base))
    several = cut_lineage(of_several_texts(sums))
    copies = exact_copies(sums, several)
    found = cut_lineage(shared_anchors(base, max(1024, total >> 23)))
    spots = found.join(copies.hint("merge"), "doc", "left_anti").groupBy("doc").agg(F.collect_list(F.struct("start", "n", "hash")).alias("spots"))
    spots = spots.join(several.select("doc", F.lit(True).alias("several")).hint("merge"), "doc", "left")
    rows = base.join(spots.hint("merge"), "doc").withColumn("text_key", F.when(F.col("several"), F.xxhash64("t")).otherwise(F.lit(0).cast("bigint")))

    def contexts(batches):
        for b in batches:
            lists = b.column("spots")
            at, flat = lists.offsets.to_numpy(), lists.values
            start, n, hashes = (flat.field(k).to_numpy() for k in range(3))
            docs, keys, pieces, keep = b.column("doc").to_numpy(), b.column("text_key").to_numpy(), [], []
            for k, t in enumerate(b.column("t").to_pylist()):
                t, s = (t or "").encode(), slice(at[k], at[k + 1])
                a = start[s]
                e = a + n[s] + (LENGTH - 1)
                pieces += [t[x:y] for x, y in zip(a.tolist(), e.tolist())]
                keep.append(e <= len(t))
            if keep:
                keep = np.flatnonzero(np.concatenate(keep))
                own, kind = np.repeat(docs, np.diff(at)), np.repeat(keys, np.diff(at))
                out = pa.RecordBatch.from_arrays([pa.array(hashes[at[0]:at[-1]]), pa.array(own), pa.array(kind), pa.array(start[at[0]:at[-1]]), pa.array(pieces, pa.binary())], ["hash", "doc", "text_key", "start", "context"])
                yield out.take(pa.array(keep))

    def once(batches):
        for b in batches:
            if len(b):
                yield _distinct(b)

    places = rows.mapInArrow(contexts, "hash int, doc bigint, text_key bigint, start int, context binary").withColumn("key", F.xxhash64("context"))
    distinct = places.select("hash", "key", "context", F.col("doc").alias("low"), F.col("doc").alias("high")).mapInArrow(
        once, "hash int, key bigint, context binary, low bigint, high bigint")
    owned = cut_lineage(owners(distinct))
    hits = places.select("key", "doc", "text_key", "start").join(owned.hint("merge"), "key").select("doc", "text_key", "start", F.explode(F.filter("runs", lambda r: r["first"] < F.col("doc"))).alias("r"))
    spans = hits.groupBy("doc", "text_key").agg(F.collect_list(F.struct(
        (F.col("start") + F.col("r.lo")).alias("a"), (F.col("start") + F.col("r.hi") + LENGTH).alias("b"))).alias("spans"))
    whole = copies.select("doc", F.lit(0).cast("bigint").alias("text_key"), F.array(F.struct(F.lit(0).alias("a"), F.col("size").cast("int").alias("b"))).alias("spans"))
    spans = cut_lineage(spans.unionByName(whole))
    for df in (found, owned, sums, several, copies):
        release(df)
    return spans


def _merged(lists: pa.ListArray, sizes: list[int]) -> list[list[tuple[int, int]]]:
    """Each list's ranges, clipped to the size, sorted and joined where they touch."""
    at = lists.offsets.to_numpy()
    count = np.where(np.asarray(lists.is_null()), 0, np.diff(at))
    start, end = (lists.values.field(k).to_numpy() for k in range(2))
    out = []
    for k, n in enumerate(sizes):
        if not count[k]:
            out.append([])
            continue
        s = slice(at[k], at[k + 1])
        order = np.argsort(start[s], kind="stable")
        a, b = start[s][order], np.maximum.accumulate(np.minimum(end[s][order], n))
        new = np.concatenate([[True], a[1:] > b[:-1]])
        last = np.append(np.flatnonzero(new)[1:], len(a)) - 1
        out.append([(x, y) for x, y in zip(a[new].tolist(), b[last].tolist()) if x < y])
    return out


def remove_repeats(docs: DataFrame, *, text: str = "text", digest: bool = True, rest: bool = False, rest_text: bool = False) -> DataFrame:
    """Each document without the bytes covered by a 50-byte string that an earlier document also has.

    Texts are UTF-8 bytes and strings are judged on the input.  Adds ``n_bytes, n_removed, n_spans`` and, as
    asked, ``kept_sha256``, ``rest`` (the remaining bytes) and ``rest_text`` (the same as text; parts of cut
    characters become replacement characters).  Documents are ordered by ``doc_id``; rows without
    one come last, by a hash of their text; rows with the same id do not remove each other's bytes;
    each is cut by its own repeats.  (Texts of one id look at each other's places, too, which costs time where an
    id has very many texts.)  Null texts are empty.
    Existing columns of these names are replaced.
    """
    added = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint"} | ({"kept_sha256": "string"} if digest else {}) | ({"rest": "binary"} if rest else {}) | ({"rest_text": "string"} if rest_text else {})
    spans = repeated_spans(docs, text=text)
    names = [c for c in docs.columns if c not in added]
    base = docs.select(*names, key_of(F.col("doc_id"), F.col(text)).alias("__k"))
    spans = spans.select(F.col("doc").alias("__d"), F.col("text_key").alias("__t"), F.col("spans").alias("__spans"))
    own = (F.col("__k") == F.col("__d")) & ((F.col("__t") == 0) | (F.col("__t") == F.xxhash64(text)))
    joined = base.join(spans.hint("merge"), own, "left").drop("__k", "__d", "__t")
    schema = docs.select(*names).withColumns({n: F.lit(None).cast(t) for n, t in added.items()}).schema

    def run(batches):
        for b in batches:
            out = {n: [] for n in added}
            texts = [(t or "").encode() for t in b.column(text).to_pylist()]
            for t, merged in zip(texts, _merged(b.column("__spans"), [len(t) for t in texts])):
                bounds = [0, *[x for m in merged for x in m], len(t)]
                left = b"".join(t[bounds[k]:bounds[k + 1]] for k in range(0, len(bounds), 2))
                values = {"n_bytes": len(t), "n_removed": len(t) - len(left), "n_spans": len(merged), "kept_sha256": hashlib.sha256(left).hexdigest() if digest else None, "rest": left, "rest_text": left.decode("utf-8", "replace") if rest_text else None}
                for n in added:
                    out[n].append(values[n])
            kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *[pa.array(out[n], kinds[t]) for n, t in added.items()]], [*names, *added])

    return joined.mapInArrow(run, schema)
