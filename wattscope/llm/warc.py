"""Web archives in WARC 1.1: written with revisit records, read back by a reader that salvages.

Writing: a page is a response or, where an equal payload has a smaller page_id, a revisit that refers to
it. Records are gzip members of their own; files are a few dozen MB, so that one fits into a task. Files go
through Spark's text writer, so any file system Spark knows will do: a row is one finished member, and the
separator between rows is the gzip member of nothing, which readers pass over.

Reading: a member or plain record counts only if it is whole (gzip checksum, version line, Content-Length,
closing line breaks, block and payload digests). Where one fails, the reader searches for the next gzip
member or version line at which a valid record begins, goes on from there, and reports the bytes between as
a quarantined gap. Every byte of a file is in a record, a member of nothing, or a gap.

A member may hold several records. If some of them fail, the others count, and the parts of the content between
are gaps with ``inner_offset`` and ``inner_length`` in the content. Of a truncated or damaged member the content
that can still be inflated, up to where the reader goes on, is read the same way; ``reason`` stands at its
records too, and where the member is damaged a record counts only if a digest confirms it.

Defined cases: a null html is an empty payload; a null url has the page's own name as target; a page without
page_id refers to the page with the smallest one of equal payload, and is a response if there is none; rows
repeating the smallest page_id are all responses; an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Printable ASCII may stand in a header as it is.
PRINTABLE = "".join(map(chr, range(33, 127)))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NOTHING = gzip.compress(b"", mtime=0)
CHUNK = 1 << 16
READ = ("file string, offset long, length long, kind string, reason string, record_id string, record_type string, "
        "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, inner_offset long, inner_length long")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_name(page_id: int | None) -> str:
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if refers_to is not None else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{page_name(page_id)}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {quote(url, safe=PRINTABLE) if url else page_name(page_id)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{page_name(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compress: bool = True,
                  file_bytes: int = 32 << 20) -> None:
    """One record for each row of ``page_id, url, html``. Plain files hold the same records uncompressed."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("same", F.unhex(F.sha2("html", 256)))
    # Only payloads that occur again take part; copies of a hot payload collapse before the shuffle.
    first = (rows.groupBy("same").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").drop("n"))
    size = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    records = rows.join(first, "same", "left").select("page_id", "url", "html", refers.alias("refers_to"))

    def encode(batches):
        for batch in batches:
            out = [record_bytes(p, u, h.encode(), r, date) for p, u, h, r in
                   zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True)]
            if compress:
                out = [gzip.compress(x, 6, mtime=0) for x in out]
            else:
                out = [x[:-4] for x in out]  # the closing line breaks are the separator
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (records.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1") if compress else "\r\n\r\n")
     .option("maxRecordsPerFile", max(1, int(file_bytes / max(size, 1))))
     .mode("overwrite").text(path))


TRUNCATED, DAMAGED = "truncated member", "damaged member"


class Broken(Exception):
    """Why bytes are not a valid record."""


def _unzip(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at``, and where it ends."""
    inflate, out, end = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof:
            if end >= len(data):
                raise Broken(TRUNCATED)
            part = data[end:end + CHUNK]
            out.append(inflate.decompress(part))
            end += len(part)
    except zlib.error as e:
        raise Broken(DAMAGED) from e
    return b"".join(out), end - len(inflate.unused_data)


def _inflated(data: bytes, at: int, end: int) -> bytes:
    """What can be inflated of the broken gzip member in ``data[at:end]``."""
    inflate, out = zlib.decompressobj(31), []
    for k in range(at, end, CHUNK):
        part, before = data[k:min(end, k + CHUNK)], inflate.copy()
        try:
            out.append(inflate.decompress(part))
        except zlib.error:
            try:
                for i in range(len(part)):
                    out.append(before.decompress(part[i:i + 1]))
            except zlib.error:
                pass
            break
    return b"".join(out)


VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def _record(data: bytes, at: int, digest: bool = False) -> tuple[dict, int]:
    """The record whose version line is at ``at``, checked in full, and where it ends; with ``digest`` it must have one."""
    if not (m := VERSION.match(data, at)):
        raise Broken("no version line")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise Broken("truncated header")
    fields = {}
    for line in data[m.end():head_end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("bad header")
        fields[name.strip().lower()] = value.strip()
    if not {"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(fields):
        raise Broken("missing field")
    length = fields["content-length"]
    if not (length.isascii() and length.isdigit()):
        raise Broken("bad length")
    start = head_end + 4
    end = start + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Broken("truncated block" if end + 4 > len(data) else "bad length")
    block = data[start:end]
    said = fields.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != sha1_base32(block):
        raise Broken("block digest")
    confirmed = said.startswith("sha1:")
    kind = fields.get("warc-type", "")
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise Broken("bad http header")
        stated = re.search(rb"\r\ncontent-length:\s*(\d+)", http.lower())
        size = int(stated[1]) if kind == "revisit" and stated else len(payload)
    named = fields.get("warc-payload-digest", "")
    if kind != "revisit" and named.startswith("sha1:") and named[5:] != sha1_base32(payload):
        raise Broken("payload digest")
    if digest and not confirmed and (kind == "revisit" or not named.startswith("sha1:")):
        raise Broken("no digest")
    strip = lambda x: None if x is None else x.removeprefix("<").removesuffix(">")
    return {"record_id": strip(fields.get("warc-record-id")), "record_type": kind,
            "target_uri": fields.get("warc-target-uri"), "refers_to": strip(fields.get("warc-refers-to")),
            "payload_digest": named.removeprefix("sha1:") or sha1_base32(payload), "payload_bytes": size,
            "payload": None if kind == "revisit" else payload}, end + 4


def _content(content: bytes, digest: bool = False) -> list[dict]:
    """Rows for a member's content: records, and gaps by their place in it."""
    rows, at = [], 0
    while at < len(content):
        try:
            record, end = _record(content, at, digest)
            rows.append({"kind": "record"} | record)
        except Broken as e:
            end = len(content)
            for found in VERSION.finditer(content, at + 1):
                try:
                    if content[found.start() - 1:found.start()] == b"\n":
                        _record(content, found.start(), digest)
                        end = found.start()
                        break
                except Broken:
                    continue
            rows.append({"kind": "gap", "reason": str(e), "inner_offset": at, "inner_length": end - at})
        at = end
    return rows


def _holds(rows: list[dict]) -> bool:
    return any(r["kind"] == "record" for r in rows)


def _unit(data: bytes, at: int) -> tuple[list[dict], int]:
    """Rows of the member, or the plain record, at ``at``, and where it ends; a member of nothing has none."""
    if data[at:at + 2] == b"\x1f\x8b":
        content, end = _unzip(data, at)
        rows = _content(content)
        if rows and not _holds(rows):
            raise Broken(rows[0]["reason"])
        return rows, end
    record, end = _record(data, at)
    return [{"kind": "record"} | record], end


def _remains(data: bytes, at: int, end: int, reason: str) -> list[dict]:
    """Rows of what a truncated or damaged member in ``data[at:end]`` still holds, its loss last; none without a record."""
    if reason not in (TRUNCATED, DAMAGED):
        return []
    content = _inflated(data, at, end)
    rows = _content(content, digest=reason == DAMAGED)
    if not _holds(rows):
        return []
    rows = [r if r["kind"] == "gap" else r | {"reason": reason} for r in rows]
    return [*rows, {"kind": "gap", "reason": reason, "inner_offset": len(content)}]


def _begins(data: bytes, at: int) -> bool:
    """Whether a unit with something to read is at ``at``."""
    try:
        _unit(data, at)
        return True
    except Broken as e:
        return bool(_remains(data, at, len(data), str(e)))


START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def salvage(data: bytes) -> Iterator[dict]:
    """Rows of READ for a file's bytes, without ``file``: records, and gaps where none could be read."""
    at = 0
    while at < len(data):
        try:
            rows, end = _unit(data, at)
        except Broken as e:
            gap, reason = at, str(e)
            at = len(data)
            for found in START.finditer(data, gap + 1):
                if found[0][0] != 0x1f and data[found.start() - 1:found.start()] != b"\n":
                    continue  # a version line begins a line
                if _begins(data, found.start()):
                    at = found.start()
                    break
            for row in _remains(data, gap, at, reason) or [{"kind": "gap", "reason": reason}]:
                yield {"offset": gap, "length": at - gap} | row
            continue
        for row in rows:
            yield {"offset": at, "length": end - at} | row
        at = end


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps (``kind``) of all files under ``path``; ``payloads=False`` leaves the content out."""
    schema = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t])
                        for c, t in (x.split() for x in READ.split(", "))])

    def read(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for row in salvage(data.as_py()):
                    rows.append(row | {"file": name} | ({} if payloads else {"payload": None}))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(read, READ)
