"""Token counts of whole texts by a published vocabulary, computed in Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Before a single space between two non-space characters the vocabulary's
# pattern always starts a new piece, so counts of the parts add up.
SAFE = re.compile(r"(?<=\S)(?= \S)")
VOCABULARY = "byte_bpe_50k.json"


def byte_batches(pieces: list[str], limit: int) -> Iterator[list[str]]:
    """Cut ``pieces`` into batches of about ``limit`` bytes; a larger piece is a batch of its own."""
    batch, held = [], 0
    for piece in pieces:
        n = len(piece.encode())
        if batch and held + n > limit:
            yield batch
            batch, held = [], 0
        batch.append(piece)
        held += n
    if batch:
        yield batch


class Lengths:
    """Token counts of texts; each distinct part is encoded once while it is remembered."""

    def __init__(self, path: str, batch_bytes: int, remembered: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch_bytes, self.remembered, self.known = batch_bytes, remembered, {}

    def __call__(self, texts: list[str]) -> list[int]:
        parts = [SAFE.split(t) if t else [] for t in texts]
        if len(self.known) > self.remembered:
            self.known.clear()
        new = sorted(set().union(*parts) - self.known.keys(), key=len)
        for batch in byte_batches(new, self.batch_bytes):
            encoded = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
            self.known.update(zip(batch, map(len, encoded)))
        count = self.known.__getitem__
        return [sum(map(count, p)) for p in parts]


def count_tokens(
    docs: DataFrame, *, text: str = "text", path: str | None = None, batch_bytes: int = 256 << 10,
    remembered: int = 300_000, name: str = "n_tokens",
) -> DataFrame:
    """Add the number of tokens of each whole text.

    Texts are cut at safe boundaries, distinct parts are encoded in batches balanced by bytes, and only
    lengths leave the task.  No shuffle: each scan split is one task.  Null and empty texts have 0
    tokens; repeated rows keep one result each; an existing column called ``name`` is replaced.
    ``path`` is the vocabulary file, by default the installed one, looked up on the executor.
    """
    rest = [c for c in docs.columns if c not in (name, text)]
    schema = docs.select(*rest, text).withColumn(name, F.lit(0).cast("bigint")).schema

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        file = path
        if file is None:
            import public_tokenizers

            file = public_tokenizers.path(VOCABULARY)
        lengths = Lengths(file, batch_bytes, remembered)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lengths(texts), pa.int64())], [*batch.schema.names, name])

    return docs.select(*rest, text).mapInArrow(run, schema)
