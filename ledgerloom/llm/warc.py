"""WARC: writing per-record compressed archives, and a splittable reader.

Writer: records with equal payloads of ``min_revisit`` bytes or more become one
response, that with the largest id, and revisits of it. Each record is a gzip
member of its own. Tasks write one archive each, named by partition.

Reader: archives are cut into byte ranges. A task scans its range for the gzip
magic, accepts a candidate member only if it inflates to a WARC version line
and headers, and owns the records whose member starts inside its range,
reading past the end for the last one.

Defined cases: a null or empty html is an empty payload, a response; a null url
is written as ``about:blank``; control characters and spaces in urls are
percent-encoded; a null id is below every other; rows repeated exactly are
responses alike; an empty table writes no archive and reads as an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import filesystem, written
from .store import shared_dir, spread_join, stored

_MAGIC = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"
_BLOCK = 1 << 20
_NAMESPACE = uuid.UUID("6f1ee1bc-3f0a-5d6f-9a52-0b7a4f1d6c11")
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, path string, offset bigint"


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: bool, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisits else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: {_urn(page_id, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or 'about:blank')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisits:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def marked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000) -> DataFrame:
    """_id, _url, _html, _digest, _refers_to (the id of the response; null for responses)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), html.alias("_html"), F.sha1(F.encode(html, "UTF-8")).alias("_digest"))
    long = rows.filter(F.octet_length("_html") >= min_revisit)
    twice = long.groupBy("_digest").agg(F.max("_id").alias("_newest"), F.count("*").alias("_n")).filter("_n > 1").select("_digest", "_newest")
    out = spread_join(rows, stored(twice), "_digest", "_id", salts=8)
    older = F.col("_newest").isNotNull() & ~F.col("_newest").eqNullSafe(F.col("_id"))
    return out.withColumn("_refers_to", F.when(older, F.col("_newest"))).drop("_newest")


def write(pages: DataFrame, to: str | None = None, **columns) -> DataFrame:
    """Writes the archives below ``to`` and returns their stored list: path, bytes, records."""
    to = to or f"{shared_dir(pages.sparkSession)}/warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        path, size, n = f"{to}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0, 0

        def all_batches():
            yield first
            yield from batches

        with written(path) as out:
            for batch in all_batches():
                for page_id, url, html, digest, refers in zip(*(batch.column(i) for i in range(5))):
                    member = record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), refers.is_valid, refers.as_py())
                    out.write(member)
                    size, n = size + len(member), n + 1
        if n:
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    rows = marked(pages, **columns).select("_id", "_url", "_html", "_digest", "_refers_to")
    return stored(rows.mapInArrow(run, "path string, bytes bigint, records bigint"))


class _Window:
    """Bytes of a file from a position on, fetched in blocks and dropped behind."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.start, self.held = file, size, start, bytearray()

    def ensure(self, to: int) -> None:
        to = min(to, self.size)
        have = self.start + len(self.held)
        if to > have:
            self.file.seek(have)
            self.held += self.file.read(max(to - have, min(_BLOCK, self.size - have)))

    def drop(self, before: int) -> None:
        if before > self.start:
            del self.held[: before - self.start]
            self.start = before

    def find(self, start: int, end: int) -> int:
        """The first gzip magic that begins in [start, end), or -1."""
        at = start
        while at < end:
            self.ensure(min(end + 2, at + _BLOCK))
            stop = min(end + 2, self.start + len(self.held))
            got = self.held.find(_MAGIC, at - self.start, stop - self.start)
            if got >= 0:
                return self.start + got
            if stop >= min(end + 2, self.size):
                return -1
            at = stop - 2
            self.drop(at)
        return -1


def _member(w: _Window, at: int) -> tuple[bytes, int] | None:
    """The inflated member at a position and the position after it, or None if it isn't a WARC record."""
    inflate, out, pos = zlib.decompressobj(31), bytearray(), at
    try:
        while not inflate.eof:
            w.ensure(pos + 1)
            held = bytes(w.held[pos - w.start : pos - w.start + _BLOCK])
            if not held:
                return None
            out += inflate.decompress(held)
            pos += len(held) - len(inflate.unused_data)
            if len(out) >= 5 and out[:5] != b"WARC/":
                return None
    except zlib.error:
        return None
    return (bytes(out), pos) if out[:5] == b"WARC/" and b"\r\n\r\n" in out else None


def parse(data: bytes) -> dict | None:
    """Headers, HTTP length and payload of a record; None if its lengths don't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) < int(size):
        return None
    http, _, payload = rest[: int(size)].partition(b"\r\n\r\n")
    length = re.search(rb"(?i)content-length:\s*(\d+)", http)
    return {"fields": fields, "payload": payload, "http_length": int(length[1]) if length else len(payload)}


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """The records whose member begins in [start, end): positions and contents."""
    w, at = _Window(file, size, start), start
    while (at := w.find(at, end)) >= 0:
        w.drop(at)
        got = _member(w, at)
        parsed = parse(got[0]) if got else None
        if parsed is None:
            at += 1
            continue
        yield at, parsed
        at = got[1]
        w.drop(at)


def read(archives: DataFrame, split_bytes: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """Rows of RECORD from archives listed as (path, bytes). Digests of responses are taken from the payload read, those of revisits from the header."""
    n = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = archives.filter("bytes > 0").select("path", "bytes", starts.alias("start")).repartition(min(int(n), 20000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])
        rows, held = [], 0
        for batch in batches:
            for s in batch.to_pylist():
                fs, path = filesystem(s["path"])
                with fs.open_input_file(path) as file:
                    for at, r in records_in(file, s["bytes"], s["start"], min(s["bytes"], s["start"] + split_bytes)):
                        f, payload = r["fields"], r["payload"]
                        again = f.get("warc-type") == "revisit"
                        digest = base64.b32decode(f["warc-payload-digest"].split(":")[-1]).hex() if again else hashlib.sha1(payload).hexdigest()
                        page, refers = f.get("x-page-id"), f.get("x-refers-to-page")
                        rows.append((int(page) if page else None, f.get("warc-target-uri"), f.get("warc-type"), int(refers) if refers else None, r["http_length"] if again else len(payload), digest, payload if payloads and not again else None, s["path"], at))
                        held += len(payload) if payloads else 0
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return splits.mapInArrow(run, RECORD)
