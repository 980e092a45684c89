"""Tailing append-only logs: a streaming source that remembers a byte offset per file (A10)."""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from stagelog.schema import STREAM_STEP

LINES = "file string, offset bigint, value string"
BLOCK = 1 << 16
ROWS = 10_000


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), posixpath.abspath(path))


def log_files(store: fs.FileSystem, path: str, pattern: str) -> dict[str, int]:
    """Sizes of the files at ``path``: itself, or those in and below the folder whose name matches; hidden ones are left out."""
    at = store.get_file_info(path)
    if at.type == fs.FileType.File:
        return {path: at.size}
    if at.type == fs.FileType.NotFound:
        return {}
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    names = {f.path: f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)}
    hidden = [p for p in names if any(x[:1] in "._" for x in posixpath.relpath(p, path).split("/"))]
    return {p: f.size for p, f in names.items() if p not in hidden}


def complete_until(file, begin: int, size: int) -> int:
    """The byte after the last line break in ``begin..size``, or ``begin``; reads backwards from the end."""
    end = size
    while end > begin:
        start = max(begin, end - BLOCK)
        file.seek(start)
        at = file.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return begin


@dataclass
class ByteRange(InputPartition):
    path: str
    begin: int
    end: int  # of the range; lines that start in it are read to their end
    stop: int  # of what is complete


def lines_in(file, begin: int, end: int, stop: int, first: int = 0) -> Iterator[tuple[int, bytes]]:
    """Offset and text of the lines that start in ``begin..end``; a line runs on to its break, at most to ``stop``."""
    at = begin
    if begin > first:  # the line that reaches into the range belongs to the range before
        at = begin - 1
    file.seek(at)
    held = b""
    skip = begin > first
    while True:
        block = file.read(min(BLOCK, stop - at - len(held)))
        if not block:
            return
        held += block
        lines = held.split(b"\n")
        held = lines.pop()
        for line in lines:
            if skip:
                skip = False
            elif at < end:
                yield at, line
            else:
                return
            at += len(line) + 1
        if at >= end and not skip:
            return


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("glob", "*")
        self.range_bytes = int(options.get("rangeBytes", 32 << 20))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The end of the last complete line of every file.  What is known to be complete is not looked at again."""
        store, path = open_store(self.path)
        ends = {}
        for name, size in sorted(log_files(store, path, self.pattern).items()):
            done = self.known.get(name, 0)
            if size < done:
                raise ValueError(f"{name} has shrunk from at least {done} to {size} bytes; a tailed log only grows")
            if size > done:
                with store.open_input_file(name) as file:
                    done = complete_until(file, done, size)
            ends[name] = done
        self.known = ends
        return ends

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        out = []
        for name, stop in end.items():
            begin = start.get(name, 0)
            if stop < begin:
                raise ValueError(f"{name} has shrunk from {begin} to {stop} bytes; a tailed log only grows")
            out += [ByteRange((name, begin), at, min(at + self.range_bytes, stop), stop) for at in range(begin, stop, self.range_bytes)]
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        name, first = partition.path
        store, _ = open_store(self.path)
        rows: list[tuple[int, str]] = []

        def batch():
            offsets, texts = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows)), pa.array(offsets, pa.int64()), pa.array(texts)], ["file", "offset", "value"])

        with store.open_input_file(name) as file:
            for at, line in lines_in(file, partition.begin, partition.end, partition.stop, first):
                rows.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
                if len(rows) >= ROWS:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class TailLines(DataSource):
    """``spark.readStream.format("tail_lines").load(path)``: complete lines of growing files, each exactly once.

    Options: ``glob`` for file names in a folder, ``rangeBytes`` for the bytes a task owns.  A last line
    without a line break is held back until it has one.  The offset, kept in the query's checkpoint, has one
    number a file.  A file that becomes shorter is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


def tail_lines(spark: SparkSession, path: str, *, glob: str = "*", range_bytes: int = 32 << 20) -> DataFrame:
    """A10: ``file, offset, value`` of every complete line appended under ``path``, also to files already read."""
    spark.dataSource.register(TailLines)
    return spark.readStream.format("tail_lines").option("glob", glob).option("rangeBytes", range_bytes).load(path)


def tail_steps(
    spark: SparkSession, path: str, *, schema: T.StructType = STREAM_STEP, mode: str = "strict", glob: str = "*", range_bytes: int = 32 << 20,
) -> DataFrame:
    """A10: records appended to JSON-lines logs under ``path`` as they arrive, with ``file`` and ``offset``.

    Blank lines are no records.  A malformed line stops the query (``strict``) or is left out (``permissive``).
    """
    if mode not in ("strict", "permissive"):
        raise ValueError(f"unknown mode {mode!r}")
    bad = "__bad"
    whole = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    lines = tail_lines(spark, path, glob=glob, range_bytes=range_bytes).withColumn("text", F.regexp_replace("value", r"^[\s\x{FEFF}]+|\s+$", ""))
    parsed = lines.where(F.col("text") != "").withColumn(
        "r", F.from_json("text", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    wrong = F.col("r").isNull() | F.col(f"r.{bad}").isNotNull() | ~F.col("text").startswith("{")
    if mode == "strict":
        parsed = parsed.where(F.assert_true(~wrong, F.concat(F.lit("malformed record in "), F.col("file"), F.lit(": "), F.col("text"))).isNull())
    else:
        parsed = parsed.where(~wrong)
    return parsed.select("file", "offset", *[F.col(f"r.{n}").alias(n) for n in schema.fieldNames()])
