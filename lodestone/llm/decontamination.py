"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of words; positions that the mask leaves out may differ. Hashes
of every window of the benchmark are looked up by every window of every document, and around each hit
the two texts are compared word by word on the hit's diagonal: an ungapped stretch of ``min_words``
words or more (or the whole item, if that is shorter) must have ``identity`` of them equal.

No such stretch is missed at the default ``min_words`` and ``identity``. A stretch of more than 25 words
can be cut into parts of 13 to 25, and one part has as large a share of equal words as the whole; in
13 to 25 words with a fifth unequal at most, wherever these are, one of ``SEEDS`` fits (the tests try all
places). An item of fewer words has an equal run as long as its unequal words cannot break up.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, and each block's hash table is the
only thing sent to tasks, so what is sent is bounded however large the benchmark is; all documents are
scanned against every block and no window is skipped.

Defined results: null or wordless texts and items match nothing; items of equal words are reported
under the least ``item_id`` (nulls last) with ``n_items``; repeated document rows are reported each;
an empty table on either side gives no matches; further columns are passed through by ``clean``
whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: 1 is a word that must agree. Windows of 7 to 11 words, 6 of them compared.
SEEDS = ("1101111", "1100010111", "11011000011", "1111101")
MIN_WORDS, IDENTITY = 13, 0.8
BLOCK_WORDS = 1_000_000
#: Hits looked at together, so that a text of equal words needs no more memory than this.
HITS = 1 << 20
_WORD = re.compile(r"[^\W_]+")
_ODD = (2 * np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def words_of(text: str | None) -> np.ndarray:
    """Hashes of a text's case-folded words."""
    import xxhash

    seen: dict[str, int] = {}
    out = []
    for w in _WORD.findall((text or "").casefold()):
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def window_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """One hash for every window: only the words under a 1 of the mask take part."""
    n = len(words) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), dtype=np.uint64)
    if n > 0:
        for i, bit in enumerate(mask):
            if bit == "1":
                out = (out ^ words[i : i + n]) * _ODD[i % len(_ODD)]
                out ^= out >> np.uint64(29)
    return out


@dataclass
class Block:
    """Seed hashes of some benchmark items, sorted, with the window each belongs to."""

    items: list  # (item_id, n_items, words)
    masks: tuple
    hashes: list  # by mask: sorted hashes
    where: list  # by mask: (item, position) in the order of the hashes
    filters: list  # by mask: bit table over the hashes' low bits

    @classmethod
    def build(cls, items: list, seeds=SEEDS, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> Block:
        span = max(min_words, *map(len, seeds))
        run = [equal_run(len(w), identity) if len(w) < span else 0 for _, _, w in items]
        short = sorted({n for n in run if n})
        masks = (*seeds, *("1" * n for n in short))
        hashes, where, filters = [], [], []
        for k, m in enumerate(masks):
            h, at = [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
            for i, (_, _, w) in enumerate(items):
                if run[i] != (0 if k < len(seeds) else len(m)):
                    continue
                x = window_hashes(w, m)
                h.append(x)
                at.append(np.stack([np.full(len(x), i), np.arange(len(x))], axis=1))
            h, at = np.concatenate(h), np.concatenate(at)
            order = np.argsort(h, kind="stable")
            hashes.append(h[order])
            where.append(at[order])
            bits = max(10, int(len(h) * 16).bit_length())
            table = np.zeros(1 << bits, dtype=bool)
            table[h & np.uint64(len(table) - 1)] = True
            filters.append(table)
        return cls(items, masks, hashes, where, filters)

    def matches(self, words: np.ndarray, min_words: int, identity: float, first: bool = False) -> list:
        """``(item, start, length, equal)``: the best verified stretch for each item; the first found if ``first``."""
        best: dict = {}
        tried = np.zeros(0, np.int64)
        for m, h, at, table in zip(self.masks, self.hashes, self.where, self.filters, strict=True):
            if not len(h) or len(words) < len(m):
                continue
            x = window_hashes(words, m)
            maybe = np.flatnonzero(table[x & np.uint64(len(table) - 1)])
            if not len(maybe):
                continue
            lo, hi = np.searchsorted(h, x[maybe], "left"), np.searchsorted(h, x[maybe], "right")
            for places in _pieces(hi - lo):
                a, n = lo[places], (hi - lo)[places]
                # each hit's row of the table, and from it the item and the diagonal, once for each
                row = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                item, shift = at[row, 0], np.repeat(maybe[places], n) - at[row, 1]
                lines = np.setdiff1d(np.unique((item << 40) + (shift + (1 << 39))), tried)
                tried = np.union1d(tried, lines)
                for line in lines.tolist():
                    i, d = line >> 40, (line & ((1 << 40) - 1)) - (1 << 39)
                    got = stretch(words, self.items[i][2], d, min_words, identity)
                    if got and (i not in best or (got[1], -got[0]) > (best[i][1], -best[i][0])):
                        best[i] = got
                        if first:
                            return [(i, *got)]
        return [(i, *v) for i, v in sorted(best.items())]


def _pieces(counts: np.ndarray):
    """Slices of ``counts`` without its zeros, as index arrays, of at most ``HITS`` hits or one window's."""
    used = np.flatnonzero(counts)
    start = 0
    total = np.concatenate([[0], np.cumsum(counts[used])])
    while start < len(used):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + HITS, "right")) - 1)
        yield used[start:stop]
        start = stop


def equal_run(n: int, identity: float) -> int:
    """Length of the equal run that ``n`` words must have if ``identity`` of them are equal."""
    unequal = int(n * (1 - identity) + 1e-9)
    return -(-(n - unequal) // (unequal + 1))


def stretch(words: np.ndarray, item: np.ndarray, shift: int, min_words: int, identity: float):
    """Best ungapped stretch of ``item`` laid at ``words[shift:]``: ``(start, length, equal)`` or None.

    An unequal word costs as much as the equal words that make up for it, so a stretch that gains nothing
    and loses nothing has just ``identity`` of its words equal. The best is sought among the stretches of
    enough words only: a shorter one may gain more and says nothing about them.
    """
    a, b = max(shift, 0), min(shift + len(item), len(words))
    need = max(1, min(min_words, len(item)))
    if b - a < need:
        return None
    same = words[a:b] == item[a - shift : b - shift]
    cost = identity / (1 - identity) if identity < 1 else len(same) + 1.0
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -cost))])
    gain = total[need:] - np.minimum.accumulate(total[:-need])
    end = int(np.argmax(gain))
    if gain[end] < -1e-6:
        return None
    start, end = int(np.argmin(total[: end + 1])), end + need
    return a + start, end - start, int(same[start:end].sum())


def blocks(benchmark: DataFrame, seeds=SEEDS, block_words: int = BLOCK_WORDS, min_words: int = MIN_WORDS, identity: float = IDENTITY, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark's blocks, one after another; at most one block is in the driver at a time."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n_words = F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+"))
    distinct = shared.save(
        rows.groupBy("text").agg(F.min(F.struct(F.col("item_id").isNull().alias("none"), "item_id")).alias("m"), F.count("*").alias("n")).select("m.item_id", "n", "text", n_words.alias("words")).where("words > 0"),
        "benchmark",
    )
    total = distinct.agg(F.sum("words")).first()[0] or 0
    parts = -(-2 * total // block_words) if total > block_words else 1
    for k in range(parts if total else 0):
        mine = distinct.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).select("item_id", "n", "text")
        items, held = [], 0
        for r in mine.toLocalIterator():
            w = words_of(r.text)
            if items and held + len(w) > block_words:
                yield Block.build(_merged(items), seeds, min_words, identity)
                items, held = [], 0
            items.append((r.item_id, r.n, w))
            held += len(w)
        if items:
            yield Block.build(_merged(items), seeds, min_words, identity)


def _merged(items: list) -> list:
    """Items of equal words as one."""
    by: dict = {}
    for i, n, w in items:
        j, m, _ = by.get(w.tobytes(), (None, 0, w))
        by[w.tobytes()] = (min((x for x in (i, j) if x is not None), default=None), n + m, w)
    return [x for x in by.values() if len(x[2])]


def find(docs: DataFrame, benchmark: DataFrame, seeds=SEEDS, min_words: int = MIN_WORDS, identity: float = IDENTITY, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``(doc_id, item_id, n_items, start_word, length, equal)``: each document with each item found in it."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, n_items long, start_word long, length long, equal long"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark, seeds, block_words, min_words, identity, item_col):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for b in batches:
                got = []
                for i, t in enumerate(b.column(1).to_pylist()):
                    found = sent.value.matches(words_of(t), min_words, identity)
                    got += [(i, sent.value.items[j][0], sent.value.items[j][1], s, n, e) for j, s, n, e in found]
                if got:
                    cols = list(zip(*got, strict=True))
                    ids = b.column(0).take(pa.array(cols[0], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int64() if item_kind == "bigint" else None), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["doc_id", "item_id", "n_items", "start_word", "length", "equal"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, seeds=SEEDS, min_words: int = MIN_WORDS, identity: float = IDENTITY, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; schema and other columns unchanged."""
    spark = docs.sparkSession
    for block in blocks(benchmark, seeds, block_words, min_words, identity):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for b in batches:
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.filter(pa.array([not sent.value.matches(words_of(t), min_words, identity, first=True) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` that holds a passage of ``benchmark``, with the items found."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
