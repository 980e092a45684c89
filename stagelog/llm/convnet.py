"""Quality probability of whole texts by a small convolutional network over bytes, in numpy."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FILTERS, WIDTH = 16, 5
BLOCK = 512  # a chunk is two neighbouring blocks, so chunks overlap by half
PAD = 256
SAMPLE = 2000  # labelled rows of each class that the network is fitted on
PIECE = 1 << 17  # positions whose responses are held at once


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by ``WIDTH`` pads, and the start of each text."""
    gap = [PAD] * WIDTH
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + WIDTH)])
    codes = np.full(starts[-1], PAD, dtype=np.int16)
    for t, s in zip(texts, starts):
        codes[s:s + len(t)] = np.frombuffer(t, dtype=np.uint8)
    return np.concatenate([codes, gap]).astype(np.int16), starts


def block_starts(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks begin, and the text each belongs to; a text's last pads belong to its last block."""
    sizes = np.maximum(1, np.diff(starts) - WIDTH)
    counts = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[:-1][owner] + within * BLOCK, owner


class Network:
    """Filters as one table a byte position; block maxima, chunk maxima, and a logistic unit on top."""

    def __init__(self, tables, bias, top, level):
        self.tables, self.bias, self.top, self.level = tables, bias, top, level

    @classmethod
    def fresh(cls, seed: int = 1):
        rng = np.random.default_rng(seed)
        tables = rng.normal(0, 0.15, (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
        tables[:, PAD] = 0
        return cls(tables, np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def parameters(self):
        return [self.tables, self.bias, self.top, self.level]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *self.parameters())
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes):
        held = np.load(io.BytesIO(data))
        return cls(*[held[f"arr_{k}"] for k in range(4)])

    def responses(self, codes: np.ndarray, start: int, end: int) -> np.ndarray:
        out = np.take(self.tables[0], codes[start:end], axis=0)
        for k in range(1, WIDTH):
            out += np.take(self.tables[k], codes[start + k:end + k], axis=0)
        out[codes[start:end] == PAD] = 0  # pads respond as pads, whatever text follows them
        return out

    def block_maxima(self, codes, starts) -> tuple[np.ndarray, np.ndarray]:
        begin, owner = block_starts(starts)
        out = np.empty((len(begin), FILTERS), np.float32)
        done = 0
        while done < len(begin):
            last = max(done + 1, int(np.searchsorted(begin, begin[done] + PIECE)))
            end = begin[last] if last < len(begin) else starts[-1]
            piece = self.responses(codes, begin[done], end)
            out[done:last] = np.maximum.reduceat(piece, begin[done:last] - begin[done], axis=0)
            done = last
        return np.maximum(out + self.bias, 0), owner

    @staticmethod
    def pooled(blocks: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """The largest and the mean chunk value of each filter and text."""
        first = np.searchsorted(owner, np.arange(n))
        alone = np.bincount(owner, minlength=n)[owner] == 1
        paired = np.append(owner[1:] == owner[:-1], False)
        chunks = blocks.copy()
        chunks[:-1][paired[:-1]] = np.maximum(blocks[:-1], blocks[1:])[paired[:-1]]
        is_chunk = (paired | alone)[:, None]
        mean = np.add.reduceat(chunks * is_chunk, first, axis=0) / np.add.reduceat(is_chunk.astype(np.float32), first, axis=0)
        return np.concatenate([np.maximum.reduceat(blocks, first, axis=0), mean], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        codes, starts = joined(texts)
        blocks, owner = self.block_maxima(codes, starts)
        logit = self.pooled(blocks, owner, len(texts)) @ self.top + self.level[0]
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, *, epochs: int = 6, batch: int = 48, rate: float = 0.01, seed: int = 1) -> Network:
    """Adam on the logistic loss; gradients flow to the positions that won the maxima."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            grads = _gradients(net, [texts[i] for i in chosen], labels[chosen])
            step += 1
            for p, g, m, v in zip(net.parameters(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-6)
            net.tables[:, PAD] = 0
    return net


def _gradients(net: Network, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    codes, starts = joined(texts)
    begin, owner = block_starts(starts)
    ends = np.append(begin[1:], starts[-1])
    where = np.empty((len(begin), FILTERS), np.int64)
    top = np.empty((len(begin), FILTERS), np.float32)
    for k, (s, e) in enumerate(zip(begin, ends)):
        r = net.responses(codes, s, e)
        arg = r.argmax(0)
        where[k], top[k] = s + arg, r[arg, np.arange(FILTERS)]
    blocks = np.maximum(top + net.bias, 0)
    v = net.pooled(blocks, owner, len(texts))
    p = 1 / (1 + np.exp(-np.clip(v @ net.top + net.level[0], -30, 30)))
    d = ((p - y) / len(texts)).astype(np.float32)
    dv = d[:, None] * net.top[None]
    counts = np.bincount(owner, minlength=len(texts))
    dz = np.zeros_like(blocks)
    starts_of = np.cumsum(counts) - counts
    cols = np.arange(FILTERS)
    for i, (s, n) in enumerate(zip(starts_of, counts)):
        own = blocks[s:s + n]
        dz[s + own.argmax(0), cols] += dv[i, :FILTERS]
        share = dv[i, FILTERS:] / max(1, n - 1)
        if n == 1:
            dz[s] += share
        else:
            winner = np.arange(n - 1)[:, None] + (own[1:] > own[:-1])
            np.add.at(dz, (s + winner, np.broadcast_to(cols, winner.shape)), share)
    dz *= blocks > 0
    flow = dz * (codes[where] != PAD)
    tables = np.zeros_like(net.tables)
    for k in range(WIDTH):
        np.add.at(tables[k], (codes[where + k].astype(np.int64), np.broadcast_to(cols, where.shape)), flow)
    return [tables, dz.sum(0), d @ v + 1e-4 * net.top, np.array([d.sum()], np.float32)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", sample: int = SAMPLE) -> bytes | None:
    """Fit on at most ``sample`` labelled rows of each class, those of smallest hashed id, never held-out ones.

    The sample is joined to its texts and fitted in one task; weights (about 100 KB) come back.  None where a
    class is missing.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    ids = None
    for y in (0, 1):
        one = known.where(F.col("quality") == y).select(F.col("doc_id").alias("__id"), "quality").orderBy(F.xxhash64("__id"), "__id").limit(sample)
        ids = one if ids is None else ids.unionByName(one)
    rows = docs.select("doc_id", text).join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("doc_id", F.col(text).alias("t"), "quality")

    def run(batches):
        got = sorted((r["doc_id"], r["t"] or "", r["quality"]) for b in batches for r in b.to_pylist())
        y = np.array([r[2] for r in got], dtype=np.float32)
        if len(set(y.tolist())) == 2:
            yield pa.RecordBatch.from_pydict({"weights": [fit([r[1].encode() for r in got], y).dump()]})

    found = rows.repartition(1).mapInArrow(run, "weights binary").collect()
    return bytes(found[0]["weights"]) if found else None


def classify(docs: DataFrame, weights: bytes | None, *, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability that a whole text is of good quality.

    Filters run over every byte; maxima are taken over overlapping chunks of two blocks that cover the text,
    and the largest and mean chunk values of each filter make one probability.  Null and empty texts are
    scored as a single pad; without weights every score is 0.5; a column called ``name`` is replaced.
    """
    rest = [c for c in docs.columns if c not in (name, text)]
    schema = docs.select(*rest, text).withColumn(name, F.lit(0.0)).schema

    def run(batches):
        net = Network.load(weights) if weights else None
        for b in batches:
            texts = [(t or "").encode() for t in b.column(text).to_pylist()]
            scores = net.score(texts) if net else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, name])

    return docs.select(*rest, text).mapInArrow(run, schema)
