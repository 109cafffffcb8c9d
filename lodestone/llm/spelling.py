"""Spelling variants: words one edit apart, met at rolling-hash deletion keys.

Words are counted over all texts first. A word's keys are the polynomial hash of the whole word and of
every string that one deletion leaves: prefix and suffix hashes give all of them by NumPy integer
arithmetic, without building a string. Two words that differ by one inserted, deleted or replaced code
point share exactly one deletion string. Keys are dealt by their leading bits (radix partitions) and
sorted; words that meet at a key are fetched, and the deletion strings themselves are compared, so a
collision of hashes joins nothing.

Inside a group of one deletion string no pairs are made: each position keeps its count and its two best
words. A deletion string has at most (letters x positions) words, whatever the size of the corpus.

Defined results: a null text has no words, a null id counts as an empty one in the misspelling rule;
repeated rows are counted as rows; ties in ``n`` go to the smaller word by code points; an empty table
gives an empty result; further columns are ignored whatever their names. A word of any length is
hashed whole; its text travels once a group that it meets others in, not once a key.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: One run in so many (by its hash) loses a letter.
EVERY = 31
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: Letters of words hashed at once.
LETTERS = 1 << 20


def misspelt(text: str | None, doc_id, least: int = LEAST_LENGTH, every: int = EVERY) -> Counter:
    """Counts of the words of one document: lower-cased runs of letters, some with one letter deleted."""
    runs = Counter(re.findall(rf"[a-zÀ-ÿ]{{{least},}}", (text or "").encode(errors="replace").lower().decode()))
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), prefix)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: words of at least ``LEAST_LENGTH`` code points with at least ``least_count`` occurrences."""

    def run(batches):
        held: Counter = Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.update(misspelt(t, i))
                if len(held) >= HELD:
                    yield told()
                    held.clear()
        yield told()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread over all bits, so that leading bits deal evenly."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def deletion_keys(letters: np.ndarray) -> np.ndarray:
    """Letters (words x length, one length) -> keys (words x length + 1): column ``i`` for the word without letter ``i``, the last for the whole word.

    With ``prefix[i]`` the hash of the first ``i`` letters and ``suffix[i]`` that of the letters from ``i``
    on, the word without letter ``i`` hashes to ``prefix[i] * base ** (letters behind i) + suffix[i + 1]``.
    """
    words, length = letters.shape
    c = letters.astype(np.uint64) + np.uint64(1)
    prefix, suffix = np.zeros((length + 1, words), np.uint64), np.zeros((length + 1, words), np.uint64)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(length, _BASE)], dtype=np.uint64)
    for i in range(length):
        prefix[i + 1] = prefix[i] * _BASE + c[:, i]
    for i in range(length - 1, -1, -1):
        suffix[i] = suffix[i + 1] + c[:, i] * powers[length - 1 - i]
    out = np.empty((words, length + 1), np.uint64)
    out[:, :length] = (prefix[:length] * powers[length - 1 :: -1][:length, None] + suffix[1:]).T
    out[:, length] = prefix[length]
    lengths = np.full(length + 1, length - 1, np.uint64)
    lengths[length] = length
    return _mixed(out + lengths * np.uint64(0xD6E8FEB86659FD93))


def _keys(words: DataFrame) -> DataFrame:
    """``words(uid, word)`` -> ``(key, uid, at)``: ``at`` is the letter deleted, -1 for the whole word; of equal letters in a row only the first counts."""

    def run(batches):
        for b in batches:
            uid, text = np.asarray(b.column(0)), b.column(1).to_pylist()
            by_length = defaultdict(list)
            for i, w in enumerate(text):
                by_length[len(w)].append(i)
            for length, at in by_length.items():
                step = max(1, LETTERS // (length + 1))
                for k in range(0, len(at), step):
                    rows = np.array(at[k : k + step])
                    letters = np.frombuffer("".join(text[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), length)
                    keys = deletion_keys(letters)
                    used = np.ones(keys.shape, bool)
                    used[:, 1:length] = letters[:, 1:] != letters[:, :-1]
                    row, col = np.nonzero(used)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[row, col].view(np.int64)), pa.array(uid[rows][row]), pa.array(np.where(col == length, -1, col).astype(np.int32))], names=["key", "uid", "at"]
                    )

    return words.select("uid", "word").mapInArrow(run, "key long, uid long, at int")


def _sorted_groups(rows: DataFrame, keys: str, work, schema: str) -> DataFrame:
    """Deal ``rows`` by the leading bits of their first column, sort them by it, and call ``work(columns, starts)`` for whole groups of equal keys.

    ``columns`` are those of some rows in order, ``starts`` the bounds of their groups; the last group of
    a batch waits for the next batch.
    """
    radix = F.shiftrightunsigned(keys, 44)
    dealt = rows.repartition(radix).sortWithinPartitions(keys)

    def run(batches):
        waiting: list = []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.asarray(b.column(0))
            if waiting and key[0] == key[-1] and waiting[-1].column(0)[0].as_py() == key[0]:
                waiting.append(b)
                continue
            cut = int(np.searchsorted(key, key[-1]))
            yield from told([*waiting, b.slice(0, cut)] if cut or waiting else [])
            waiting = [b.slice(cut)]
        yield from told(waiting)

    def told(parts):
        parts = [p for p in parts if p.num_rows]
        if parts:
            table = pa.Table.from_batches(parts).combine_chunks()
            key = np.asarray(table.column(0))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            yield from work(table, starts)

    return dealt.mapInArrow(run, schema)


def _meeting(table: pa.Table, starts: np.ndarray):
    """Of groups by key those with several rows."""
    size = np.diff(starts)
    rows = np.flatnonzero(np.repeat(size > 1, size))
    if len(rows):
        yield from table.take(pa.array(rows)).to_batches()


def _best(a: tuple, b: tuple) -> tuple:
    """The two best of two pairs of ``(-n, word)`` or None."""
    return tuple(sorted({x for x in (*a, *b) if x}))[:2]


def neighbours(members: list[tuple[str, int, int]]) -> list[tuple[str, int, str, int]]:
    """``(word, n, at)`` that share a key -> ``(word, n_near, best, best_n)`` of those with words one edit away.

    Deleting any of a stretch of equal letters gives one string; two words of a length are one edit apart
    if their stretches share a position, which then is the only one in which they differ.
    """
    by: dict[str, list] = defaultdict(list)
    for w, n, at in members:
        by[w if at < 0 else w[:at] + w[at + 1 :]].append((w, n, at))
    out = []
    for group in by.values():
        if len(group) < 2:
            continue
        whole = [(-n, w) for w, n, at in group if at < 0]
        count: Counter = Counter()
        top: dict[int, tuple] = {}
        longer = []
        for w, n, at in group:
            if at >= 0:
                end = at + 1
                while end < len(w) and w[end] == w[at]:
                    end += 1
                longer.append((w, n, at, end))
                for p in range(at, end):
                    count[p] += 1
                    top[p] = _best(top.get(p, ()), ((-n, w),))
        if whole and longer:
            n, w = min((-n, w) for w, n, _, _ in longer)
            out.append((whole[0][1], len(longer), w, -n))
        for w, n, at, end in longer:
            near = sum(count[p] - 1 for p in range(at, end)) + len(whole)
            best = min([x for p in range(at, end) for x in top[p] if x[1] != w] + whole, default=None)
            if near:
                out.append((w, near, best[1], -best[0]))
    return out


def _verified(table: pa.Table, starts: np.ndarray):
    word, n, at = (table.column(i).to_pylist() for i in (1, 2, 3))
    got = [x for a, b in zip(starts, starts[1:], strict=False) for x in neighbours(list(zip(word[a:b], n[a:b], at[a:b], strict=True)))]
    if got:
        cols = list(zip(*got, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n_near", "best", "best_n"])


def near(words: DataFrame) -> DataFrame:
    """``words(uid, word, n)`` -> ``(word, n_near, best, best_n)`` for words with words one edit away; ``best`` is that of largest ``n``."""
    met = _sorted_groups(_keys(words), "key", _meeting, "key long, uid long, at int")
    full = met.join(words, "uid").select("key", "word", "n", "at")
    found = _sorted_groups(full, "key", _verified, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` -> ``(word, root)`` by pointer jumping; counts grow tenfold a step, so a few rounds do."""
    cur = shared.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = cur.select(F.col("word").alias("root"), F.col("root").alias("__on"))
        step = shared.save(cur.join(ahead, "root", "left").select("word", F.coalesce("__on", "root").alias("root"), F.col("__on").isNotNull().alias("moved")), "roots")
        shared.drop(cur)
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        cur = step.select("word", "root")


def variants(docs: DataFrame, times: int = TIMES, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: each word with the far more frequent word that it is a variant of, and the last of those in a row."""
    words = shared.save(vocabulary(docs, least_count, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "words")
    joined = words.join(near(words), "word", "left")
    form = F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))
    told = shared.save(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "near")
    last = roots(told.where("form is not null").select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 11 over the whole of ``documents``."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
