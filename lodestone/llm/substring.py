"""Substring dedup: documents parsed relative to indexed reference blocks.

The corpus is written once as blocks of a few megabytes, files that tasks open when they need them. Any
window of ``WINDOW`` words has an anchor: of its runs of ``ANCHOR`` words that with the least hash. The
anchors of all blocks are brought together, once a block each, and every anchor learns the first document
(by id) that has it and how many have it. Only windows around anchors of several documents can repeat.
Stretches of such windows go to the block of their anchor's first document and are factored greedily
against that document (relative Lempel-Ziv): from each place the factor runs on as far as the words follow
one another in the reference, found by an index of its word runs and rolling hashes, then compared as
words. Windows inside factors of ``WINDOW`` words or more repeat; the windows that touch a boundary of
factors are looked up in the same document by themselves.

A window that its anchor's first document does not have (so nowhere is it found there) is told by a
128-bit digest and grouped with its equals; that its anchor occurs in two documents only rules it out.
The least document of each group keeps it. So every window is decided, whichever document comes first.

A passage that many documents share costs each block one row an anchor, whatever the number of copies; the
stretches sent to a much-used reference are rebalanced over tasks, each of which opens its block.

Defined results: a null text has no words; a null id is taken for the largest and stays null; rows of one
id do not remove each other's words, even where they repeat whole; documents shorter than a window lose
nothing; an empty table gives an empty result; a very long text is a block of its own; further columns are
ignored whatever their names. Ids are integers.
"""

from __future__ import annotations

import io
import uuid
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WINDOW, ANCHOR = 13, 7
#: Bytes of text a block, unless a single text is longer.
BLOCK_BYTES = 8 << 20
#: Anchors a stretch, so that no row grows with its document.
STRETCH = 2048
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max
_NONE = np.uint64(2**64 - 1)


def write_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[str, DataFrame]:
    """Write the blocks of ``docs``; their folder, and ``(block, n_docs)``, a row for each block that a finished task wrote."""
    folder = shared.new_path(docs.sparkSession, "references")

    def run(batches):
        ids, texts, size = [], [], 0

        def told():
            block = uuid.uuid4().int >> 65
            table = pa.table({"doc": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
            out = io.BytesIO()
            with pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                f.write_table(table)
            shared.write_bytes(_path(folder, block), [out.getvalue()])
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(ids)])], names=["block", "n_docs"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= block_bytes:
                    yield told()
                    ids, texts, size = [], [], 0
        if ids:
            yield told()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    return folder, shared.save(rows.mapInArrow(run, "block long, n_docs long"), "blocks")


def _path(folder: str, block: int) -> str:
    return f"{folder}/{block:016x}"


class Words:
    """The words of several texts in a row, their hashes, and the bounds of the texts."""

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.bounds = np.cumsum([0, *map(len, split)])
        self.words = list(chain.from_iterable(split))

    @cached_property
    def hash(self) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))

    @cached_property
    def text(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    @cached_property
    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.words))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on; the largest number where the text ends before."""
        n = len(self.words)
        h = np.zeros(n, np.uint64)
        for j in range(min(k, n)):
            h *= _BASE
            h[: n - j] += self.hash[j:]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return np.where(self.left >= k, h, _NONE)

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of ``hash * base ** place`` before each word, and the powers, for hashes of any stretch."""
        n = len(self.words)
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)
        return np.r_[np.uint64(0), np.cumsum(self.hash * powers[:-1], dtype=np.uint64)], powers

    def anchors(self, window: int = WINDOW, k: int = ANCHOR):
        """``(hash, text, first window, last window)`` of each anchor: the windows, by their first word, of which it is the least run of ``k`` words."""
        h = self.grams(k)
        least, at = h.copy(), np.arange(len(h))
        for j in range(1, window - k + 1):
            less = h[j:] < least[: len(h) - j]
            least[: len(h) - j][less] = h[j:][less]
            at[: len(h) - j][less] = np.flatnonzero(less) + j
        windows = np.flatnonzero(self.left >= window)
        at = at[windows]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
        last = np.r_[first[1:], len(at)] - 1 if len(at) else first
        return h[at[first]], self.text[at[first]], windows[first], windows[last]


def _open(folder: str, block: int) -> tuple[np.ndarray, list, Words]:
    """Ids of a block's documents (nulls last of all), the ids as they are, and their words."""
    with shared.open_bytes(_path(folder, block)) as f:
        table = pa.ipc.open_file(f).read_all()
    ids = table.column("doc").to_pylist()
    return np.array([_LAST if i is None else i for i in ids], np.int64), ids, Words(table.column("text").to_pylist())


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "block").sortWithinPartitions("block")


def _by_block(dealt: DataFrame, work, schema: str) -> DataFrame:
    """``work(block, table of its rows)`` for rows dealt and sorted by ``block``, their first column; a block has a bounded number of rows."""

    def run(batches):
        parts: list = []
        for b in batches:
            key = np.asarray(b.column(0))
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1 if len(key) else []
            for a, z in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if z > a:
                    if parts and parts[0].column(0)[0].as_py() != key[a]:
                        yield from told(parts)
                        parts = []
                    parts.append(b.slice(a, z - a))
        if parts:
            yield from told(parts)

    def told(parts):
        return work(parts[0].column(0)[0].as_py(), pa.Table.from_batches(parts))

    return dealt.mapInArrow(run, schema)


def repeated_anchors(folder: str, blocks: DataFrame, parts: int) -> DataFrame:
    """``(block, h, docs, first_doc, first_block, first_row)``: for each block its anchors that several documents have, and the first of these."""

    def anchors(block, _):
        docs, _, words = _open(folder, block)
        h, row, _, _ = words.anchors()
        order = np.lexsort((row, docs[row], h))
        h, row = h[order], row[order]
        other = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
        h, row = h[other], row[other]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
        n = np.diff(np.r_[first, len(h)])
        h, row = h[first], row[first]
        for a in range(0, len(h), 50_000):
            z = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[z]), block)), pa.array(h[z].view(np.int64)), pa.array(docs[row[z]]), pa.array(row[z].astype(np.int32)), pa.array(n[z].astype(np.int64))], names=["block", "h", "doc", "row", "n"])

    got = _by_block(_dealt(blocks.select("block"), parts), anchors, "block long, h long, doc long, row int, n long")
    w = Window.partitionBy("h")
    told = got.withColumn("docs", F.sum("n").over(w)).withColumn("first", F.min(F.struct("doc", "block", "row")).over(w)).where("docs > 1")
    return told.select("block", "h", "docs", F.col("first.doc").alias("first_doc"), F.col("first.block").alias("first_block"), F.col("first.row").alias("first_row"))


def stretches(folder: str, repeated: DataFrame, parts: int) -> DataFrame:
    """Stretches of windows around repeated anchors, addressed to the first document of their anchors.

    ``(to, to_row, to_doc, block, row, doc, at, lo, hi, many, text)``: ``at`` is the place of the text in
    its document; ``lo``, ``hi`` and ``many`` tell of each anchor its windows and whether more than two documents have it.
    """

    def run(block, table):
        docs, _, words = _open(folder, block)
        h, docs_n, first_doc, first_block, first_row = (np.asarray(table.column(i).combine_chunks()) for i in range(1, 6))
        order = np.argsort(h.view(np.uint64))
        known = h.view(np.uint64)[order]
        ah, row, lo, hi = words.anchors()
        found = np.minimum(np.searchsorted(known, ah), len(known) - 1)
        hit = np.flatnonzero(known[found] == ah)
        at = order[found[hit]]
        hit_ok = (first_block[at] != block) | (first_row[at] != row[hit])
        hit, at = hit[hit_ok], at[hit_ok]
        if not len(hit):
            return
        cut = (np.diff(hit) != 1) | (np.diff(row[hit]) != 0) | (np.diff(first_block[at]) != 0) | (np.diff(first_row[at]) != 0)
        group = np.cumsum(np.r_[0, cut])
        start = np.flatnonzero(np.r_[True, cut])
        nth = np.arange(len(hit)) - start[group]
        start = np.flatnonzero(nth % STRETCH == 0)
        stop = np.r_[start[1:], len(hit)]
        many = (docs_n[at] > 2).astype(np.int8)
        for k in range(0, len(start), 2000):
            s, e = start[k : k + 2000], stop[k : k + 2000]
            a, z = lo[hit[s]], hi[hit[e - 1]] + WINDOW
            begin = words.bounds[row[hit[s]]]
            cols = [first_block[at[s]], first_row[at[s]], first_doc[at[s]], np.full(len(s), block), row[hit[s]].astype(np.int32), docs[row[hit[s]]], (a - begin).astype(np.int64)]
            offsets = pa.array(np.r_[s, e[-1]].astype(np.int32) - np.int32(s[0]))
            base = np.repeat(a, e - s)
            inner = slice(s[0], e[-1])
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in ((lo[hit[inner]] - base).astype(np.int32), (hi[hit[inner]] - base).astype(np.int32), many[inner])]
            text = pa.array([b" ".join(words.words[x:y]) for x, y in zip(a, z, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *lists, text], names=["to", "to_row", "to_doc", "block", "row", "doc", "at", "lo", "hi", "many", "text"])

    schema = "to long, to_row int, to_doc long, block long, row int, doc long, at long, lo array<int>, hi array<int>, many array<tinyint>, text binary"
    return _by_block(_dealt(repeated, parts), run, schema)


class Reference:
    """An indexed reference block: its runs of ``ANCHOR`` and of ``WINDOW`` words by document, and rolling hashes for stretches."""

    def __init__(self, words: Words):
        self.words = words
        self.sums, self.powers = words.prefixes()
        self.short = self._index(words.grams(ANCHOR), words.left >= ANCHOR)
        self.long = self._index(words.grams(WINDOW), words.left >= WINDOW)

    def _index(self, h, ok):
        at = np.flatnonzero(ok)
        keys = self.key(h[at], self.words.text[at])
        order = np.argsort(keys, kind="stable")  # of equal runs in a document the first comes first
        return keys[order], at[order]

    @staticmethod
    def key(h, row):
        return (h + row.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) ^ (row.astype(np.uint64) << np.uint64(40))

    @staticmethod
    def find(index, keys) -> np.ndarray:
        """The first place of each key, -1 if there is none."""
        known, at = index
        if not len(known):
            return np.full(len(keys), -1)
        i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[i] == keys, at[i], -1)

    def reach(self, other: Words, sums, powers, i, c) -> np.ndarray:
        """How many words from ``i`` of ``other`` and from ``c`` here are the same, within both texts, by bisection over rolling hashes."""
        low = np.zeros(len(i), np.int64)
        high = np.minimum(other.left[i], self.words.left[c])
        # the side further left is multiplied up to the other's place
        up_i, up_c = np.maximum(c - i, 0), np.maximum(i - c, 0)
        scale_i, scale_c = self.powers[up_i], powers[up_c]
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) // 2
            same = (sums[i + mid] - sums[i]) * scale_i == (self.sums[c + mid] - self.sums[c]) * scale_c
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)

    def factors(self, other: Words, rows: np.ndarray) -> list[tuple[int, int, int]]:
        """Greedy factors ``(place, place here, words)`` of the texts of ``other``, each against document ``rows[text]`` here.

        All texts go forward at once: from its cursor each goes to the next run of ``ANCHOR`` words that
        its document has, takes the factor from there, and goes on behind it.
        """
        sums, powers = other.prefixes()
        n = len(other.words)
        place = self.find(self.short, self.key(other.grams(ANCHOR), rows[other.text]))
        place[other.left < ANCHOR] = -1
        match = np.where(place >= 0, np.arange(n), n)
        following = np.minimum.accumulate(np.r_[match, n][::-1])[::-1]
        cursor, end = other.bounds[:-1].copy(), other.bounds[1:]
        live = np.flatnonzero(cursor < end)
        out = []
        while len(live):
            i = following[cursor[live]]
            inside = i < end[live]
            live, i = live[inside], i[inside]
            if not len(live):
                break
            size = self.reach(other, sums, powers, i, place[i])
            size = np.maximum(size, 1)  # after a collision of hashes
            out.append(np.stack([i, place[i], size]))
            cursor[live] = i + size
            live = live[cursor[live] < end[live]]
        return np.concatenate(out, axis=1).T.tolist() if out else []

    def holds(self, other: Words, rows: np.ndarray) -> np.ndarray:
        """Which windows of ``other`` (by first word) the document ``rows[text]`` here has: those inside factors, and those at boundaries looked up."""
        n = len(other.words)
        has = np.zeros(n + 1, np.int64)
        mine, theirs = other.words, self.words.words
        for i, c, size in self.factors(other, rows):
            if size >= WINDOW and mine[i : i + size] == theirs[c : c + size]:
                has[i] += 1
                has[i + size - WINDOW + 1] -= 1
        has = np.cumsum(has[:-1]) > 0
        rest = np.flatnonzero(~has & (other.left >= WINDOW))
        at = self.find(self.long, self.key(other.grams(WINDOW)[rest], rows[other.text[rest]]))
        for i, c in zip(rest[at >= 0].tolist(), at[at >= 0].tolist(), strict=True):
            has[i] = mine[i : i + WINDOW] == theirs[c : c + WINDOW]
        return has


def _spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted window starts -> first and last word behind of the stretches that they cover without a gap."""
    cut = np.flatnonzero(np.diff(starts) > WINDOW) + 1
    return starts[np.r_[0, cut]], starts[np.r_[cut - 1, len(starts) - 1]] + WINDOW


def parsed(folder: str, sent: DataFrame) -> DataFrame:
    """Stretches parsed against their references: ``(block, row, doc, start, stop, digest)``, spans that repeat (no digest) and windows of which the reference knows nothing."""

    def run(batches):
        import xxhash

        opened, ref = None, None
        for b in batches:
            to = np.asarray(b.column(0))
            cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1), len(to)] if len(to) else [0]
            for a, z in zip(cuts, cuts[1:], strict=False):
                part = b.slice(a, z - a)
                if opened != to[a]:
                    ref = None  # before the next one is read
                    ref, opened = Reference(_open(folder, int(to[a]))[2]), to[a]
                other = Words(part.column(10).to_pylist())
                has = ref.holds(other, np.asarray(part.column(1)))
                block, row, doc, at = (np.asarray(part.column(i)) for i in (3, 4, 5, 6))
                earlier = np.asarray(part.column(2)) < doc
                out = []
                held = np.flatnonzero(has)
                for s in np.flatnonzero(np.bincount(other.text[held], minlength=len(row)) * earlier):
                    mine = held[np.searchsorted(held, other.bounds[s]) : np.searchsorted(held, other.bounds[s + 1])] - other.bounds[s]
                    out += [(s, x, y, None) for x, y in zip(*(v.tolist() for v in _spans(mine)), strict=True)]
                # windows not found whose anchor is in more than two documents
                lo, hi, many = (part.column(i).flatten() for i in (7, 8, 9))
                lo, hi, many = np.asarray(lo), np.asarray(hi), np.asarray(many)
                whose = np.repeat(np.arange(len(row)), np.asarray(part.column(7).value_lengths()))
                some = np.flatnonzero(many)
                length = hi[some] - lo[some] + 1
                first = lo[some] + other.bounds[whose[some]]
                w = np.repeat(first, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                for i in w[~has[w]].tolist():
                    s = int(other.text[i])
                    x = i - int(other.bounds[s])
                    out.append((s, x, x + WINDOW, xxhash.xxh3_128_digest(b" ".join(other.words[i : i + WINDOW]))))
                if out:
                    s, x, y, digest = zip(*out, strict=True)
                    s = np.array(s)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[s]), pa.array(row[s]), pa.array(doc[s]), pa.array(at[s] + np.array(x)), pa.array(at[s] + np.array(y)), pa.array(digest, pa.binary())], names=["block", "row", "doc", "start", "stop", "digest"]
                    )

    dealt = sent.hint("rebalance", "to").sortWithinPartitions("to", "to_row")
    return dealt.mapInArrow(run, "block long, row int, doc long, start long, stop long, digest binary")


def _cleaned(folder: str, blocks: DataFrame, spans: DataFrame, parts: int) -> DataFrame:
    """``(doc_id, text, n_words, n_removed)`` of every document, its kept words joined by one space."""

    def run(block, table):
        _, ids, words = _open(folder, block)
        row, start, stop = (table.column(i).combine_chunks() for i in (1, 2, 3))
        some = np.asarray(row.is_valid())
        row, start, stop = (np.asarray(c.filter(pa.array(some))) for c in (row, start, stop))
        gone = np.zeros(len(words.words) + 1, np.int64)
        np.add.at(gone, start + words.bounds[row], 1)
        np.add.at(gone, stop + words.bounds[row], -1)
        kept = np.cumsum(gone[:-1]) == 0
        n = np.diff(words.bounds)
        left = np.r_[0, np.cumsum(kept)][words.bounds]
        removed = n - np.diff(left)
        for k in range(0, len(ids), 1000):
            texts = []
            for r in range(k, min(k + 1000, len(ids))):
                a, z = words.bounds[r], words.bounds[r + 1]
                texts.append(b" ".join(words.words[a:z] if not removed[r] else [words.words[i] for i in (np.flatnonzero(kept[a:z]) + a).tolist()]).decode("utf-8", "replace"))
            z = slice(k, k + 1000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[z], pa.int64()), pa.array(texts, pa.string()), pa.array(n[z]), pa.array(removed[z])], names=["doc_id", "text", "n_words", "n_removed"])

    none = blocks.select("block", *[F.lit(None).cast(t).alias(c) for c, t in (("row", "int"), ("start", "long"), ("stop", "long"))])
    return _by_block(_dealt(spans.select("block", "row", "start", "stop").unionByName(none), parts), run, "doc_id long, text string, n_words long, n_removed long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, text, n_words, n_removed)``: every document without the words of windows that a document of smaller id has."""
    folder, blocks = write_blocks(docs, id_col, text_col, block_bytes)
    n = blocks.count()
    parts = max(1, min(n, max(200, n // 16)))
    repeated = repeated_anchors(folder, blocks, parts)
    found = shared.save(parsed(folder, stretches(folder, repeated, parts)), "parsed")
    rest = found.where("digest is not null")
    least = rest.groupBy("digest").agg(F.min("doc").alias("least"))
    later = rest.join(least, "digest").where("least < doc")
    spans = found.where("digest is null").unionByName(later.drop("least").select(*found.columns))
    return _cleaned(folder, blocks, spans, parts)


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 13 over the whole of ``documents``."""
    kept = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
