"""Media columns: PNG images in binary columns, and low-frequency cosine-transform hashes of them.

Payload bytes become a greyscale image of 8-bit samples, 64 to a row. The encoder picks one of the
filters none, sub and up for each row with numpy, and streams zlib data into IDAT chunks. The decoder
checks every chunk's CRC-32, inflates the data and unfilters with numpy: runs of rows with the filters
none and up by cumulative sums, sub by a cumulative sum along the row; average and Paeth rows, which
other writers make, sample by sample. The feature is the sign pattern of the 8 x 8 lowest cosine
coefficients of the image reduced to 32 x 32 mean samples, against their median.

Defined results: a null text is an empty payload, one row of zeros; equal texts have equal images and
features; repeated rows are encoded each; damaged or foreign data raises ``ValueError`` in ``decode``;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WIDTH = 64
LEVEL = 4
CHUNK = 1 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Rows go on in batches of about this many bytes.
BATCH_BYTES = 8 << 20


def padded(raw: bytes, width: int = WIDTH) -> bytes:
    """``raw`` with zeros appended up to a positive multiple of ``width``."""
    return raw + bytes(-len(raw) % width or (0 if raw else width))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(samples: np.ndarray, level: int = LEVEL) -> bytes:
    """PNG of a two-dimensional array of 8-bit grey samples."""
    rows, width = samples.shape
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0))]
    z, above, data = zlib.compressobj(level), np.zeros(width, np.uint8), bytearray()
    for i in range(0, rows, 1 << 14):
        part = samples[i : i + (1 << 14)]
        sub = part.copy()
        sub[:, 1:] -= part[:, :-1]
        up = part - np.concatenate([above[None], part[:-1]])
        forms = np.stack([part, sub, up])
        cost = np.minimum(forms, -forms).sum(axis=2, dtype=np.int64)  # sum of least distances from 0
        kind = np.argmin(cost, axis=0)
        lines = np.concatenate([kind[:, None].astype(np.uint8), forms[kind, np.arange(len(part))]], axis=1)
        above = part[-1]
        data += z.compress(lines.tobytes())
        while len(data) >= CHUNK:
            out.append(_chunk(b"IDAT", bytes(data[:CHUNK])))
            del data[:CHUNK]
    data += z.flush()
    out += [_chunk(b"IDAT", bytes(data[i : i + CHUNK])) for i in range(0, len(data), CHUNK)]
    return b"".join([*out, _chunk(b"IEND", b"")])


def chunks(png: bytes):
    """``(kind, data)`` of every chunk, checksums tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("PNG ends early")
        (n,) = struct.unpack_from(">I", png, at)
        kind, data, crc = png[at + 4 : at + 8], png[at + 8 : at + 8 + n], png[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"bad checksum in {kind!r}")
        yield kind, data
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("PNG has no end")


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples from filtered lines, each led by its filter's number."""
    kinds, x = lines[:, 0], lines[:, 1:]
    out = np.empty_like(x)
    above = np.zeros(x.shape[1], np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(kinds)]]), strict=True):
        k = kinds[a] if len(kinds) else 0
        if k == 0:
            out[a:b] = x[a:b]
        elif k == 1:
            out[a:b] = np.cumsum(x[a:b], axis=1, dtype=np.uint8)
        elif k == 2:
            out[a:b] = np.cumsum(np.concatenate([above[None], x[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif k in (3, 4):
            for i in range(a, b):
                prior, left, corner = (out[i - 1] if i else np.zeros(x.shape[1], np.uint8)).tolist(), 0, 0
                row = x[i].tolist()
                for j, up in enumerate(prior):
                    if k == 3:
                        guess = (left + up) >> 1
                    else:
                        p = left + up - corner
                        da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
                        guess = left if da <= db and da <= dc else up if db <= dc else corner
                    left = row[j] = (row[j] + guess) & 255
                    corner = up
                out[i] = row
        else:
            raise ValueError(f"filter {k}")
        above = out[b - 1] if b > a else above
    return out


def decode(png: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG without interlacing."""
    size, z, data = None, zlib.decompressobj(), []
    try:
        for kind, body in chunks(png):
            if kind == b"IHDR":
                width, rows, *rest = struct.unpack(">IIBBBBB", body)
                if rest != [8, 0, 0, 0, 0]:
                    raise ValueError("only 8-bit grey without interlacing is read")
                size = rows, width
            elif kind == b"IDAT":
                data.append(z.decompress(body))
            elif kind != b"IEND" and kind[0] < 97:
                raise ValueError(f"unknown chunk {kind!r}")
    except (zlib.error, struct.error) as e:
        raise ValueError(str(e)) from e
    raw = b"".join([*data, z.flush()])
    if size is None or len(raw) != size[0] * (size[1] + 1):
        raise ValueError("image data and size differ")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1))


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None] * np.arange(k)[:, None])


_COS = _cosines(32, 8)


def _means(x: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Mean of ``n`` parts along an axis; an axis shorter than that has samples repeated."""
    m = x.shape[axis]
    lo = np.arange(n) * m // n
    hi = np.maximum((np.arange(1, n + 1) * m) // n, lo + 1)
    total = np.concatenate([np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis=axis)], axis=axis)
    shape = [1, 1]
    shape[axis] = n
    return (np.take(total, hi, axis) - np.take(total, lo, axis)) / (hi - lo).reshape(shape)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: whether each low-frequency coefficient exceeds their median (the mean level set apart)."""
    small = _means(_means(samples.astype(np.float64), 32, 1), 32, 0)
    c = np.round(_COS @ small @ _COS.T, 6).ravel()
    c[0] = 0.0
    return np.packbits(c > np.median(c)).tobytes()


def images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media binary)`` of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            i, held, sizes, size = 0, [], [], 0
            for j, t in enumerate(b.column(1).to_pylist()):
                raw = t or b""
                held.append(encode(np.frombuffer(padded(raw), np.uint8).reshape(-1, WIDTH)))
                sizes.append(len(raw))
                size += len(raw)
                if size > BATCH_BYTES or j + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(held)), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    i, held, sizes, size = j + 1, [], [], 0

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """``stored(doc_id, n_bytes, media)`` -> digests and features of what the images hold."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "hash"]

    def run(batches):
        for b in batches:
            got = []
            for png in b.column(2).to_pylist():
                x = decode(png)
                raw, h = x.tobytes(), cosine_hash(x)
                got.append((len(raw), sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(png), sha256(png).hexdigest(), h.hex(), h))
            if got:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c) for c in zip(*got, strict=True)]], names=names)

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, hash binary"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op10_media(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 10 over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return features(shared.save(images(docs), "media")).drop("hash")
