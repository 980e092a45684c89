"""Write web archives, one gzip member a record, and read them back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from stagelog.llm.common import cut_lineage, new_folder

MAGIC = b"\x1f\x8b\x08"
BLOCK = 256 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "tag:stagelog,2026:page/"
MANIFEST = "path string, size bigint, records bigint"
RECORD = ("path string, offset bigint, record_type string, record_id string, refers_to_id string, target_uri string,"
          " payload_bytes bigint, payload_digest string, digest_ok boolean, status string")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def uri(url: str | None, page: int | None) -> str:
    """A header value: characters that would break the line are percent-encoded."""
    if url is None:
        return f"{ID}{'' if page is None else page}"
    return "".join(c if "!" <= c else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def member(page: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'' if page is None else page}>",
        f"WARC-Target-URI: {uri(url, page)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <{ID}{first}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def write_warc(
    pages: DataFrame, folder: str, *, min_revisit_bytes: int = 0, file_bytes: int = 1 << 30,
    date: str = "2026-01-01T00:00:00Z",
) -> DataFrame:
    """Archive ``pages`` (``page_id, url, html``) below ``folder``; returns the list of files.

    Of records with equal payloads of ``min_revisit_bytes`` or more, that with the smallest ``page_id``
    is a response and the others are revisits that refer to it.  A null html is an empty payload; a null
    url becomes an address made of the id; rows that repeat the smallest id are responses as well; a
    null id refers to the smallest of its group, or is a response where there is none.

    Tasks write through the folder's own file system.  A task that is run again writes new files, and
    only files named in the returned list belong to the archive.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sum"))
    first = cut_lineage(base.where(F.length("payload") >= min_revisit_bytes).groupBy("sum").agg(F.min("page_id").alias("first")))
    rows = base.join(first, "sum", "left").select("page_id", "url", "payload", "first", (
        F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))).alias("revisit"))

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, done = None, []

        def close():
            out.close()
            done.append((f"{folder}/{name}", size, records))

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                data = member(r["page_id"], r["url"], r["payload"], r["first"], r["revisit"], date)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "size", "records"), d)) for d in done])

    return cut_lineage(rows.mapInArrow(run, MANIFEST))


class Source:
    """Random reads of one archive in blocks."""

    def __init__(self, path: str, size: int):
        system, name = fs.FileSystem.from_uri(path)
        self.file, self.size, self.start, self.held = system.open_input_file(name), size, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        if not self.start <= pos or pos + n > self.start + len(self.held):
            self.start = pos
            self.held = self.file.read_at(min(max(n, BLOCK), max(0, self.size - pos)), pos) if pos < self.size else b""
        return self.held[pos - self.start:pos - self.start + n]


def inflate(source: Source, pos: int, most: int | None = None) -> tuple[bytes, int] | None:
    """The content of the member at ``pos`` (its first ``most`` bytes) and where it ends; None if it is none."""
    unpack, parts, held, at = zlib.decompressobj(31), [], 0, pos
    try:
        while not unpack.eof:
            data = source.at(at, min(BLOCK, source.size - at))
            if not data:
                return None
            part = unpack.decompress(data) if most is None else unpack.decompress(data, most - held)
            parts.append(part)
            held += len(part)
            at += len(data)
            if most is not None and held >= most:
                break
    except zlib.error:
        return None
    return b"".join(parts), at - len(unpack.unused_data)


def is_record(source: Source, pos: int) -> bool:
    """Whether a member that decodes to a record header starts here."""
    if source.at(pos, 3) != MAGIC:
        return False
    head = inflate(source, pos, 16)
    return head is not None and head[0].startswith(b"WARC/1.")


def first_record(source: Source, start: int, end: int) -> int | None:
    """The first member within [start, end) that is a record: search the magic, then decode its header."""
    pos = start
    while pos < end:
        chunk = source.at(pos, min(BLOCK, end + 2 - pos))
        at = chunk.find(MAGIC)
        if at < 0:
            pos += max(1, len(chunk) - 2)
        elif pos + at < end and is_record(source, pos + at):
            return pos + at
        else:
            pos += at + 1
    return None


def salvage(source: Source, pos: int) -> bytes:
    """What can be read of the member at ``pos``, which is cut off or damaged."""
    unpack, parts, at = zlib.decompressobj(31), [], pos
    try:
        while data := source.at(at, min(64, max(0, source.size - at))):  # small steps: a damaged one gives nothing
            parts.append(unpack.decompress(data))
            at += len(data)
    except zlib.error:
        pass
    return b"".join(parts)


def parse(content: bytes) -> tuple[dict[str, str], bytes, bytes] | None:
    """Header fields in lower case, the HTTP head and the payload."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not gap or not fields.get("content-length", "").isdigit():
        return None
    block = rest[:int(fields["content-length"])]
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        return fields, http, payload
    return fields, b"", block


def records(source: Source, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes, bytes, str]]:
    """The records that start within [start, end), the last one read to its end, each with its status: complete, or
    truncated where the member breaks off or its block is shorter than its header says."""
    pos = first_record(source, start, end)
    while pos is not None and pos < end:
        whole = inflate(source, pos)
        content, after = whole or (salvage(source, pos), pos + 1)
        found = parse(content)
        if found:
            fields, http, payload = found
            held = len(content.partition(b"\r\n\r\n")[2])
            yield pos, fields, http, payload, "complete" if whole and held >= int(fields["content-length"]) else "truncated"
        pos = after if whole and is_record(source, after) else first_record(source, after, end)


def read_warc(files: DataFrame, *, range_bytes: int = 4 << 20, with_payload: bool = True) -> DataFrame:
    """Records of the archives listed in ``files`` (``path, size``; other columns are ignored).

    Files are cut into ranges of ``range_bytes``; a task scans its range for the gzip magic, accepts a
    candidate once its content decodes to a record header, and owns the records that start in the range.
    ``payload_digest`` and ``payload_bytes`` come from the payload; of a revisit, which has none, from
    its header and the HTTP length.  ``digest_ok`` tells whether a payload has the digest it claims.  A
    listed path twice gives its records twice; a null path or an empty file gives none.  A record is
    held whole in memory.  ``status`` is ``truncated`` for a record whose member breaks off or is damaged (what
    can be decoded is returned, if its header can) or whose block is shorter than it says; reading goes on at the next member.
    """
    ranges = files.where("path is not null and size > 0").select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))
    ranges = ranges.repartition(max(1, ranges.count()))
    schema = RECORD + (", payload binary" if with_payload else "")

    def run(batches):
        rows = []
        for batch in batches:
            for r in batch.to_pylist():
                source = Source(r["path"], r["size"])
                for pos, fields, http, payload, status in records(source, r["start"], min(r["size"], r["start"] + range_bytes)):
                    claimed = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    revisit = fields.get("warc-type") == "revisit"
                    n, own = len(payload), claimed
                    if revisit:
                        lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                        n = int(lengths[0]) if lengths else None
                    else:
                        own = digest(payload)
                    row = {
                        "path": r["path"], "offset": pos, "record_type": fields.get("warc-type"),
                        "record_id": fields.get("warc-record-id", "").strip("<>"),
                        "refers_to_id": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                        "target_uri": fields.get("warc-target-uri"), "payload_bytes": n, "payload_digest": own,
                        "digest_ok": own == claimed, "status": status}
                    rows.append(row | ({"payload": payload} if with_payload else {}))
                    if len(rows) >= 200:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    arrow = pa.schema([
        ("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
        ("refers_to_id", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("status", pa.string()), *([("payload", pa.binary())] if with_payload else [])])
    return ranges.mapInArrow(run, schema)


def page_of(record_id) -> F.Column:
    """The page id within a record's id; null where there is none."""
    rest = F.substring(record_id, len(ID) + 1, 40)
    return F.when(record_id.startswith(ID) & (rest != ""), rest).cast("bigint")


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new folder of the shared one and read the archives back, without payloads."""
    return read_warc(write_warc(pages, new_folder(pages.sparkSession, "warc"), **options), with_payload=False)
