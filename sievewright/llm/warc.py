"""WARC archives: index first, then coalesced byte-range reads.

``write_archives`` writes one WARC/1.1 record per page, each a gzip member of
its own, into files below a shared folder, and an index with file, offset,
length, URL and digest per record.  ``read_records`` takes any selection of
index rows, sorts them by file and offset, joins neighbouring ranges into one
read each, and parses the records.

* Of pages with equal payloads of at least ``min_bytes`` bytes, the one with
  the largest page_id is written in full (``response``), the others as
  ``revisit`` records that refer to it.  Payloads are equal if their size,
  SHA-1 and SHA-256 are.
* A task attempt writes files under a name of its own.  The index is what
  commits them: it holds the rows of the attempts that Spark accepted, so files
  of lost or repeated attempts are never read.
* Files are written and read through pyarrow's file systems by their URI, so
  the folder can be local, HDFS or an object store.
* Only digests are shuffled.  Those that occur more than once come back to the
  pages: up to ``BROADCAST_DIGESTS`` of them (counted) as a broadcast, so that
  every payload is written by the task that reads it; above, pages are shuffled
  to meet them.  A revisit's payload is dropped before Python sees its row.
* Records are written a few at a time (``SLICE_BYTES``), and read back in tasks
  of about ``TASK_BYTES`` of archive, dealt by the records' summed lengths.

Defined cases: null html is the empty payload; null url: no target URI, null
when read; rows without page_id are revisits where another row with their
payload has one, else responses; rows equal in payload and largest page_id
are a response each; records are read back whole, whatever their length;
empty tables give no files and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.shipping import ship

from .common import arrow_bytes, new_path, partitions, quoted, stash, text_or_empty

#: A file is closed, and another begun, when it has this size.
FILE_BYTES = 256 << 20
#: Payloads held as Python objects at once, and in a batch of records read.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch from Spark.
ARROW_BYTES = 16 << 20
#: Archive bytes (compressed) of a reading task: cut into stretches of a
#: quarter of it, which are dealt out.
TASK_BYTES = 32 << 20
#: About 200 bytes each in a hash table; 20 MB at most.
BROADCAST_DIGESTS = 100_000
#: Ranges with at most this between them are read at once, up to a size.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
INDEX = "page_id long, url string, file string, offset long, length long, record_type string, payload_digest string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    """A header value: control characters and spaces as %XX."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def _headers(fields: list[tuple[str, str]], size: int) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {size}\r\n\r\n").encode()


def _member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, keep: int | None, date: str) -> tuple[str, bytes]:
    """(type, record) of a page; ``keep``: the page that it repeats, or None; then the payload isn't needed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if keep is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, url, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if keep is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(keep))]
    block = http if keep is not None else http + payload
    return kind, _headers(fields, len(block)) + block + b"\r\n\r\n"


def _sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in parts of about ``most`` bytes of a string column."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, side="right")))
            yield b.slice(i, j - i)
            i = j


def _written(batches: Iterator[pa.RecordBatch], folder: str, date: str, level: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, sha1, size, keep) rows to records in files; gives their index rows."""
    store, path = pafs.FileSystem.from_uri(folder)
    name, out, at = None, None, 0
    for b in _sliced(batches, 2):
        rows = {c: [] for c in ("page_id", "url", "file", "offset", "length", "record_type", "payload_digest")}
        for page_id, url, html, sha, size, keep in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if out is None or at >= file_bytes:
                if out is not None:
                    out.close()
                store.create_dir(path, recursive=True)
                name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                out = store.open_output_stream(f"{path}/{name}", compression=None)
                head = b"software: sievewright\r\nformat: WARC File Format 1.1\r\n"
                at += out.write(_member(_headers([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], len(head)) + head + b"\r\n\r\n", level))
            digest = base64.b32encode(bytes.fromhex(sha)).decode()
            kind, record = page_record(page_id, url, (html or "").encode(), size, digest, keep, date)
            data = _member(record, level)
            out.write(data)
            for c, v in zip(rows, (page_id, url, f"{folder}/{name}", at, len(data), kind, digest), strict=True):
                rows[c].append(v)
            at += len(data)
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))
    if out is not None:
        out.close()


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives and gives their index."""
    spark = pages.sparkSession
    ship(spark)
    folder = (folder or new_path(spark, "warc")).rstrip("/")
    html = text_or_empty(html_col)
    digest = [F.octet_length(html).alias("size"), F.sha1(html.cast("binary")).alias("sha"), F.sha2(html.cast("binary"), 256).alias("sha2")]
    ids = quoted(id_col).cast("long").alias("page_id")
    seen = pages.select(ids, *digest).where(F.col("size") >= min_bytes).groupBy("size", "sha", "sha2")
    again = stash(seen.agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")).where("n > 1").select(F.col("size").alias("a_size"), F.col("sha").alias("a_sha"), F.col("sha2").alias("a_sha2"), "top"), "warc-again")
    few = again.count() <= BROADCAST_DIGESTS
    rows = pages.select(ids, quoted(url_col).cast("string").alias("url"), html.alias("html"), *digest)
    both = rows.join(F.broadcast(again) if few else again, (F.col("size") == F.col("a_size")) & (F.col("sha") == F.col("a_sha")) & (F.col("sha2") == F.col("a_sha2")), "left")
    keep = F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    dealt = both.select("page_id", "url", F.when(keep.isNull(), F.col("html")).alias("html"), "sha", "size", keep.alias("keep"))
    with arrow_bytes(spark, ARROW_BYTES):
        return stash(dealt.mapInArrow(partial(_written, folder=folder, date=date, level=level, file_bytes=file_bytes), INDEX), "warc-index")


def parse_record(data: bytes) -> dict:
    """A record, without its gzip, to its fields; payload None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    f = {}
    for line in lines[1:]:
        k, _, v = line.partition(":")
        f[k.strip().lower()] = v.strip()
    block = rest[: int(f["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    kind = f["warc-type"]
    number = lambda k: int(f[k]) if k in f else None
    digest = f["warc-payload-digest"].partition(":")[2]
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {f['warc-record-id']} differs from its digest")
    return {"page_id": number("x-page-id"), "url": f.get("warc-target-uri"), "record_type": kind, "payload_bytes": int(size[1]), "payload_digest": digest, "refers_to": number("x-refers-to-page-id"), "payload": payload if kind == "response" else None}


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) to reads (first, end range; offset, length)."""
    out = []
    for i, (o, n) in enumerate(ranges):
        if out and o - (out[-1][2] + out[-1][3]) <= gap and o + n - out[-1][2] <= most:
            a, _, p, q = out[-1]
            out[-1] = (a, i + 1, p, max(q, o + n - p))
        else:
            out.append((i, i + 1, o, n))
    return out


def _records(rows: list[dict]) -> pa.RecordBatch:
    cols = {c: [r[c] for r in rows] for c in ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to")}
    cols["payload"] = [None if r["payload"] is None else r["payload"].decode() for r in rows]
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types, strict=True)], list(cols))


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """(file, offset, length) rows, sorted, to records."""
    file, handle = None, None
    for b in batches:
        files, offsets, lengths = (c.to_pylist() for c in b.columns)
        i = 0
        while i < len(files):
            j = i
            while j < len(files) and files[j] == files[i]:
                j += 1
            if files[i] != file:
                if handle is not None:
                    handle.close()
                store, path = pafs.FileSystem.from_uri(files[i])
                file, handle = files[i], store.open_input_file(path)
            ranges = list(zip(offsets[i:j], lengths[i:j], strict=True))
            for first, end, at, size in coalesced(ranges):
                data = handle.read_at(size, at)
                rows, held = [], 0
                for o, n in ranges[first:end]:
                    rows.append(parse_record(zlib.decompress(data[o - at : o - at + n], 31)))
                    held += len(rows[-1]["payload"] or b"") if with_payload else 0
                    if not with_payload:
                        rows[-1]["payload"] = None
                    if held >= SLICE_BYTES:
                        yield _records(rows)
                        rows, held = [], 0
                if rows:
                    yield _records(rows)
            i = j
    if handle is not None:
        handle.close()


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of index rows: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to, payload (null for revisits, or without ``with_payload``)."""
    spark = index.sparkSession
    ship(spark)
    # stretches of files; each is read by one task, in order
    stretch = F.floor(F.col("offset") / F.lit(TASK_BYTES // 4))
    total, files = index.agg(F.sum("length"), F.countDistinct("file")).first()
    n = max(-(-(total or 0) // TASK_BYTES), min(files, partitions(spark)), 1)
    places = index.select("file", "offset", "length").repartition(n, "file", stretch).sortWithinPartitions("file", "offset")
    return places.mapInArrow(partial(_read, with_payload=with_payload), RECORD)


def archive_round_trip(pages: DataFrame, **kw) -> DataFrame:
    """Writes ``pages`` and reads all records back: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to."""
    return read_records(write_archives(pages, **kw)).drop("payload")
