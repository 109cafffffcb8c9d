"""Token counts by scanning flat token files for end-of-document identifiers.

``write_tokens`` tokenises documents into flat files of little-endian identifiers of ``width``
bytes: each text's tokens, then one separator; the files have no index. Two bytes hold vocabularies of up
to 65,536 entries; larger ones need four, and an identifier that does not fit fails the write. ``scan`` cuts the files into byte blocks, searches
each block for separators with numpy, and stitches the blocks with a prefix scan over per-block
summaries (separators so far, place of the last one), so a document that spans blocks is counted once.

Blocks are read by range from the shared folder; a lost task reads or writes its block or file again.

Defined results: a null or empty text has 0 tokens; repeated rows are counted each; special-token
strings inside texts are ordinary text, so no text can hold a separator; a file that does not end with
a separator yields its tail as a last document (``closed`` false); an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

TOKENIZERS, VOCABULARY, EOD = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken", 50256
#: Splits a text into pieces before merging: words with a leading blank, numbers, other signs, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_BYTES = 8 << 20
WIDTH = 2
FILE_TOKENS, FILE_DOCUMENTS = 64 << 20, 1_000_000
_ENCODERS: dict = {}


def encoder(path: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once a process."""
    import base64

    import tiktoken

    key = (path, vocabulary)
    if key not in _ENCODERS:
        with open(os.path.join(path, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[key] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def write_tokens(docs: DataFrame, folder: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, eod: int = EOD, file_tokens: int = FILE_TOKENS, file_documents: int = FILE_DOCUMENTS, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write flat token files into ``folder``; returns ``(file, ordinal, doc_id)``, the order of documents.

    A file ends with the document that makes up ``file_tokens`` or ``file_documents``. It bears the number of
    the attempt that wrote it, and only files of accepted attempts are listed.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        enc, task, nth = encoder(tokenizers, vocabulary), TaskContext.get(), 0
        held, ids, size = [], [], 0

        def flush():
            path = f"{folder}/tokens-{task.partitionId():06d}-{task.taskAttemptId()}-{nth:04d}.bin"
            shared.write_bytes(path, held)
            n = sum(map(len, ids))
            cols = [pa.array([path] * n), pa.array(np.arange(n)), pa.concat_arrays(ids)]
            return pa.RecordBatch.from_arrays(cols, names=["file", "ordinal", "doc_id"])

        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                toks = np.array([*enc.encode_ordinary(t or ""), eod], dtype=f"<u{width}")
                held.append(toks.tobytes())
                ids.append(b.column(0).slice(i, 1))
                size += len(toks)
                if size >= file_tokens or len(ids) >= file_documents:
                    yield flush()
                    held, ids, size, nth = [], [], 0, nth + 1
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return shared.save(rows.mapInArrow(run, f"file string, ordinal long, doc_id {kind}"), "order")


def separators(tokens: np.ndarray, eod: int = EOD) -> np.ndarray:
    """Places of the separators."""
    return np.flatnonzero(tokens == eod)


def scan(spark: SparkSession, files: DataFrame, eod: int = EOD, block_bytes: int = BLOCK_BYTES, width: int = WIDTH) -> DataFrame:
    """``files(file)`` -> ``(file, ordinal, first_token, n_tokens, closed)``: a row for each document."""
    block_bytes -= block_bytes % width

    def sizes(batches):
        for b in batches:
            got = []
            for f in b.column(0).to_pylist():
                with shared.open_bytes(f) as x:
                    n = x.size()
                got += [(f, s, min(block_bytes, n - s)) for s in range(0, n, block_bytes)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got, strict=True)], names=["file", "start", "length"])

    def search(batches):
        for b in batches:
            for f, s, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with shared.open_bytes(f) as x:
                    x.seek(s)
                    at = separators(np.frombuffer(x.read(n), dtype=f"<u{width}"), eod) + s // width
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([s // width]), pa.array([(s + n) // width]), pa.array([at], pa.list_(pa.int64()))], names=["file", "start", "stop", "found"])

    parts = files.select("file").distinct().mapInArrow(sizes, "file string, start long, length long")
    parts = shared.save(parts, "blocks")
    n = max(1, min(parts.count(), 8 * spark.sparkContext.defaultParallelism))
    hits = shared.save(parts.repartition(n).mapInArrow(search, "file string, start long, stop long, found array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    marks = hits.select("file", "start", "stop", F.size("found").alias("n"), F.element_at(F.when(F.size("found") > 0, F.col("found")), -1).alias("last"))
    carried = marks.select(
        "file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("passed"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous")
    )
    each = hits.join(carried, ["file", "start"]).select("file", "passed", "previous", "found", F.posexplode("found").alias("i", "at"))
    begins = F.when(F.col("i") == 0, F.col("previous")).otherwise(F.expr("element_at(found, greatest(i, 1))")) + 1
    whole = each.select("file", (F.col("passed") + F.col("i")).alias("ordinal"), begins.alias("first_token"), (F.col("at") - begins).alias("n_tokens"), F.lit(True).alias("closed"))
    ends = marks.groupBy("file").agg(F.max("stop").alias("stop"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"), F.sum("n").alias("ordinal"))
    tails = ends.where("stop > last + 1").select("file", "ordinal", (F.col("last") + 1).alias("first_token"), (F.col("stop") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return whole.unionByName(tails)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``, counted in the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    order = write_tokens(docs, shared.new_path(spark, "tokens"))
    found = scan(spark, order.select("file"))
    return order.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")
