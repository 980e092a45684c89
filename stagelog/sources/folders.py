"""Text in one folder a key: its many small files are written, listed and read by tasks.

Spark's writer and file index cost milliseconds a folder and keep the name of every file in the driver.  Here the
driver sees counts only.  This holds for file systems that the machines mount; other stores go through Spark.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

RANGE = 8 << 20  # bytes of a file that a task reads at a time
BATCH = 1 << 20
_BLOCK = 1 << 16
_NO_KEY = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
_QUOTED = re.compile(r"""[\x00-\x20\x7f"#%<>?\[\]\\^`{|}]""")
_FILES = re.compile(r"([^*?\[\]{}\\]+?)((?:/\*)+)/\*(\.(?:json|jsonl|txt))")


def _hex(found: re.Match) -> str:
    return f"%{ord(found[0]):02X}"


def _store(spark: SparkSession, path: str):
    """The Hadoop file system and path of ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def mounted(spark: SparkSession, path: str) -> str | None:
    """``path`` as the machines see it, or none where only Spark reaches its store."""
    store, at = _store(spark, path)
    uri = store.makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def folder_name(key: str, value: str | None) -> str:
    """The name Spark gives the folder of a value."""
    return f"{key}={_ESCAPED.sub(_hex, value) if value else _NO_KEY}"


def folder_value(name: str) -> str | None:
    """The value in the name of a folder."""
    value = name.partition("=")[2]
    return None if value == _NO_KEY else re.sub("%([0-9A-Fa-f]{2})", lambda found: chr(int(found[1], 16)), value)


def write_folders(lines: DataFrame, out: str, keys: list[str], ending: str, overwrite: bool = False) -> None:
    """The column ``value`` of ``lines`` as text, in the order of its partitions, in folders of the values of ``keys``.

    Rows of one folder that follow each other in a partition make one file.  The files come into being beside ``out``, under names
    that a repeated task takes again, and ``out`` appears when all are there.
    """
    spark = lines.sparkSession
    store, at = _store(spark, out)
    if store.exists(at) and not overwrite:
        raise FileExistsError(f"{out} already exists")
    mark = uuid.uuid4().hex
    parent = at.getParent()
    store.mkdirs(parent)
    made = spark._jvm.org.apache.hadoop.fs.Path(parent, f".{at.getName()}-{mark}")
    store.mkdirs(made)
    top = mounted(spark, made.toString())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        hidden = f".{context.taskAttemptId()}-{mark}"
        file, folder, last, files = None, "", None, 0

        def finish():
            if file is not None:
                file.close()
                os.replace(f"{folder}/{hidden}", f"{folder}/part-{context.partitionId():05d}-{files:09d}-{mark}{ending}")

        for batch in batches:
            text = batch.column(len(keys)).to_pylist()
            of = list(zip(*[batch.column(k).to_pylist() for k in range(len(keys))]))
            begin = 0
            for key, same in groupby(of):
                end = begin + sum(1 for _ in same)
                if file is None or key != last:
                    finish()
                    folder, last, files = "/".join([top, *map(folder_name, keys, key)]), key, files + 1
                    try:
                        os.mkdir(folder)
                    except OSError:  # it is there, or the folder above it is not
                        os.makedirs(folder, exist_ok=True)
                    file = open(f"{folder}/{hidden}", "wb")
                file.write(b"\n".join([line or b"" for line in text[begin:end]]) + b"\n")
                begin = end
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    try:
        rows = lines.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("value").cast("binary").alias("value"))
        rows.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()
        store.create(spark._jvm.org.apache.hadoop.fs.Path(made, "_SUCCESS")).close()
        if overwrite:
            store.delete(at, True)
        if not store.rename(made, at):
            raise OSError(f"{made.toString()} cannot be renamed to {out}")
    except BaseException:
        store.delete(made, True)
        raise


def _left_out(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _below(folder: str, levels: int, ending: str) -> Iterator[tuple[str, str, int]]:
    """Folder, name and size of the files so many levels below a folder; a folder that has the ending stands for what is in it."""
    with os.scandir(folder) as found:
        for e in found:
            if levels:
                if e.is_dir():
                    yield from _below(e.path, levels - 1, ending)
            elif e.name.endswith(ending) and not _left_out(e.name):
                if e.is_dir():
                    yield from _below(e.path, 0, "")
                else:
                    yield folder, e.name, e.stat().st_size


def _cut(file, begin: int, end: int, size: int, separator: bytes) -> tuple[int, list[bytes]]:
    """The pieces that start in ``begin..end`` of a file, and where the first does; the last runs on to its separator."""
    at = max(begin - 1, 0)
    file.seek(at)
    data = file.read(end - at)
    if begin:
        first = data.find(separator, 0, len(data) - 1) + 1
        if not first:
            return at, []
        at, data = at + first, data[first:]
    if end < size and not data.endswith(separator):
        more = [data]
        while block := file.read(_BLOCK):
            stop = block.find(separator)
            more.append(block if stop < 0 else block[:stop])
            if stop >= 0:
                break
        data = b"".join(more)
    pieces = data.split(separator)
    if not pieces[-1]:
        pieces.pop()
    return at, pieces


def folder_pieces(spark: SparkSession, path: str | list[str], separator: str, keys: tuple[str, ...] = ()) -> DataFrame | None:
    """Text pieces of the files ``path`` matches, with file, block and order, and the values in their folders' names as ``keys``.

    Only for ``folder/*/*.ending`` (or more levels) in a mounted file system and where a file is found; else none.
    """
    parts = _FILES.fullmatch(path) if isinstance(path, str) else None
    top = mounted(spark, parts[1]) if parts else None
    if top is None or not os.path.isdir(top):
        return None
    levels, ending, sep = len(parts[2]) // 2, parts[3], separator.encode()
    if next(_below(top, levels, ending), None) is None:
        return None

    def folders(batches):
        for _ in batches:
            with os.scandir(top) as found:
                names: list[str] = []
                for e in found:
                    if e.is_dir():
                        names.append(e.path)
                    if len(names) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(names)], ["folder"])
                        names = []
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names)], ["folder"])

    ranges = "folder string, name string, begin bigint, end bigint, size bigint"

    def files(batches):
        rows: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_pylist([dict(zip(("folder", "name", "begin", "end", "size"), r)) for r in rows], pa.schema(
                [("folder", pa.string()), ("name", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("size", pa.int64())]))

        for b in batches:
            for folder in b.column(0).to_pylist():
                for at, name, size in _below(folder, levels - 1, ending):
                    rows += [(at, name, x, min(x + RANGE, size), size) for x in range(0, size, RANGE)]
                    if len(rows) >= 5_000:
                        yield batch()
                        rows = []
        if rows:
            yield batch()

    def read(batches):
        value: list[bytes] = []
        of: list[tuple] = []  # file, block, key values and pieces of each range
        where: list[np.ndarray] = []
        held = 0

        def batch():
            times = [r[-1] for r in of]
            named = [pa.array([r[i] for r in of], pa.string()) for i in (0, *range(2, 2 + len(keys)))]
            each = pa.array(np.repeat(np.arange(len(of)), times))
            block = pa.array(np.repeat(np.array([r[1] for r in of], np.int64), times))
            columns = [pa.array(value, pa.binary()), named[0].take(each), block, pa.array(np.concatenate(where)), *[c.take(each) for c in named[1:]]]
            return pa.RecordBatch.from_arrays(columns, ["value", "file", "block", "piece", *keys])

        for b in batches:
            for folder, name, begin, end, size in zip(*[c.to_pylist() for c in b.columns]):
                with open(f"{folder}/{name}", "rb") as file:
                    at, pieces = _cut(file, begin, end, size, sep)
                if not pieces:
                    continue
                length = np.array([len(p) for p in pieces], np.int64) + len(sep)
                where.append(at + np.cumsum(length) - length)
                value += pieces
                values = [folder_value(n) for n in folder.split("/")[-len(keys):]] if keys else []
                of.append(("file:" + _QUOTED.sub(_hex, f"{folder}/{name}"), begin, *values, len(pieces)))
                held += int(length.sum())
                if held >= BATCH or len(of) >= 2_000:
                    yield batch()
                    value, of, where, held = [], [], [], 0
        if value:
            yield batch()

    named = "".join(f", {k} string" for k in keys)
    found = spark.range(0, 1, 1, 1).mapInArrow(folders, "folder string")
    found = found.repartition(_tasks(spark)).mapInArrow(files, ranges).repartition(_tasks(spark))
    return found.mapInArrow(read, f"value binary, file string, block bigint, piece bigint{named}").withColumn("value", F.col("value").cast("string"))
