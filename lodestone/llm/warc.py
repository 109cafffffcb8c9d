"""WARC archives: a writer with one gzip member per record, and a splittable reader.

The writer marks records of equal payloads: the one with the largest page id is a response, the others
are revisits that refer to it and hold no payload again. The reader cuts archives into byte ranges. A
task scans its range for the gzip magic, accepts a candidate only if it inflates to a WARC header, and
owns the records that start inside its range, reading past the range's end for the last of them. Bytes
inside a decoded member are skipped, so a magic number in compressed data is looked at only before the
range's first record, where the header check refuses it.

A revisit's payload is not stored, so its length is, in an extension field of its header; its digest
is the usual ``WARC-Payload-Digest``. A response's length and digest come from the bytes read back.

Defined results: a null html is an empty payload; a null page id is written as an empty id and read
back as null, and is never the one referred to if another exists; rows that repeat a whole page are
responses each if theirs is the largest id; an empty table gives no archives and no records; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from base64 import b32encode
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES, RANGE_BYTES = 256 << 20, 16 << 20
#: Read ahead at once; bytes inflated to tell a record from other data. A header may be of any length.
STEP, FIRST_BYTES = 1 << 20, 1 << 16
VERSION = b"WARC/1."
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return b32encode(sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    n = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


def record(page_id, url: str | None, payload: bytes, first, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member; ``first`` is the page that a revisit refers to, None for a response."""
    target = "".join(c for c in (url or "") if c.isprintable()) or f"urn:page:{page_id}"
    block = HTTP if first is not None else HTTP + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if first is not None:
        head += [f"WARC-Refers-To: {_urn(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages into archives below ``folder``; returns ``(file, bytes, records)``.

    A file bears the number of the attempt that wrote it, so an attempt that is repeated or runs twice
    overwrites nothing; only files of the attempts that Spark accepted are listed.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    ids = rows.select("page_id", "sha", F.octet_length("payload").alias("n"))
    repeated = ids.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    marked = rows.join(repeated, "sha", "left").select("page_id", "url", "payload", F.when(F.col("first") > F.col("page_id"), F.col("first")).when(F.col("page_id").isNull(), F.col("first")).alias("first"))

    def run(batches):
        from pyspark import TaskContext

        task, nth, held, size = TaskContext.get(), 0, [], 0

        def flush():
            path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{nth:04d}.warc.gz"
            shared.write_bytes(path, held)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([len(held)])], names=["file", "bytes", "records"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(*row))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
                    nth, held, size = nth + 1, [], 0
        if held:
            yield flush()

    return shared.save(marked.mapInArrow(run, "file string, bytes long, records long"), "archives")


def member(source, at: int, ahead: bytes = b""):
    """``(inflated bytes, place after the member)`` if a WARC record starts at ``at``, else None."""
    z, out, pos = zlib.decompressobj(31), bytearray(), at
    try:
        while not z.eof:
            source.seek(pos)
            chunk = source.read(STEP) if pos > at or not ahead else ahead
            if not chunk:
                return None
            pos += len(chunk)
            if len(out) < len(VERSION):
                out += z.decompress(chunk, FIRST_BYTES)
                if not out.startswith(VERSION[: len(out)]):
                    return None
                chunk = z.unconsumed_tail
            out += z.decompress(chunk)
    except zlib.error:
        return None
    if not out.startswith(VERSION) or b"\r\n\r\n" not in out:
        return None
    return bytes(out), pos - len(z.unused_data)


def parse(raw: bytes) -> tuple[dict, bytes]:
    """Header fields by lower-case name, and the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    return fields, rest[: int(fields.get("content-length", len(rest)))]


def records(source, start: int, stop: int):
    """Every record that starts in ``[start, stop)``: ``(place, fields, block)``."""
    pos = start
    while pos < stop:
        source.seek(pos)
        buffer = source.read(min(STEP, stop - pos) + len(MAGIC) - 1)
        i, nxt = 0, pos + max(1, len(buffer) - len(MAGIC) + 1)
        while (i := buffer.find(MAGIC, i)) >= 0 and pos + i < stop:
            got = member(source, pos + i)
            if got:
                yield pos + i, *parse(got[0])
                if got[1] >= pos + len(buffer):
                    nxt = got[1]
                    break
                i = got[1] - pos
                nxt = max(nxt, got[1])
            else:
                i += 1
        pos = nxt


def read(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """``files(file, bytes)`` -> a row for each record, payload included unless ``payloads`` is false."""
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = shared.save(ranges, "ranges")
    n = max(1, min(ranges.count(), 8 * spark.sparkContext.defaultParallelism))
    names = ["file", "start", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if payloads else [])]

    def run(batches):
        for b in batches:
            for f, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with shared.open_bytes(f) as x:
                    got, held = [], 0
                    for at, h, block in records(x, start, min(start + range_bytes, size)):
                        kind = h.get("warc-type")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        length = len(payload) if payload is not None else int(h.get("warc-payload-length", 0))
                        mark = digest(payload) if payload is not None else h.get("warc-payload-digest", "").removeprefix("sha1:")
                        row = (f, at, _page(h.get("warc-record-id")), h.get("warc-target-uri"), kind, _page(h.get("warc-refers-to")), length, mark)
                        got.append((*row, payload) if payloads else row)
                        held += len(block)
                        if held > STEP:
                            yield _batch(got, names)
                            got, held = [], 0
                    if got:
                        yield _batch(got, names)

    schema = "file string, start long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if payloads else "")
    return ranges.repartition(n).mapInArrow(run, schema)


_KINDS = {"start": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}


def _batch(rows: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 5 over the whole of ``pages``."""
    files = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared.new_path(spark, "warc"))
    return read(spark, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The digest in base 32: each five hexadecimal digits of the SHA-1 are four characters.
_CHARACTER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> {shift}) & 31) + 1]"
ORACLE = f"""
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h from pages),
marked as (select *, max(page_id) over (partition by h) as last from p)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(list_transform(range(0, 8), lambda g: cast('0x' || substr(h, cast(g * 5 + 1 as int), 5) as int)), lambda v: {" || ".join(_CHARACTER.format(shift=s) for s in (15, 10, 5, 0))}), '') as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to
from marked
"""
