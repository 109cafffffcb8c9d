"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Texts are folded (compatibility forms, homoglyphs, accents, digit and symbol substitutions, stretched
letters), one automaton finds lexicon entries and exception phrases at word starts, hits inside an
exception phrase are dropped, and the weighted sum, as it is and per hundred words, gives the score
through a logistic curve. Entries are whole words or word beginnings; their weights are log-odds
learned from labelled rows, on top of a short built-in list.

Defined results: a null text counts as empty and gets the score of a text without hits; repeated rows
and ties score alike; with no labels the built-in list and curve apply; an empty table gives an empty
result; further columns are passed through by ``score`` and ``reject`` whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit reads at most: those with the least hashes of their ids.
MAX_ROWS = 40_000
#: Toxic rows that must have an entry, its log-odds and its log-likelihood ratio, at least.
LEAST_ROWS, LEAST_ODDS, LEAST_RATIO = 4, 2.5, 15.0
THRESHOLD = 0.7

BASE_WORDS = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic", "disgusting", "loser", "trash", "imbecile", "retard", "bastard", "bitch", "asshole", "fuck", "shit", "cunt", "whore", "slut", "vermin", "subhuman", "degenerate")
BASE_WEIGHT = 4.0
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "sore loser bracket", "loser bracket", "shiitake", "oxymoron", "stupid question about", "clown fish", "class clown award")
#: Curve without labels: intercept, log weight, log weight per hundred words.
BASE_CURVE = (-4.0, 2.0, 0.7)

_HOMOGLYPHS = {
    # fixed values: Cyrillic, Greek and other letters that look like Latin ones
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ß": "ss", "æ": "ae", "œ": "oe",
}
_SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "l": "i", "|": "i"}
_IGNORED = dict.fromkeys([*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_TABLE = str.maketrans(_HOMOGLYPHS) | {ord(k): v for k, v in _SUBSTITUTES.items()} | _IGNORED
_TABLE[ord("ӏ")] = _TABLE[ord("ł")] = "i"  # as every l
#: Odd factors: each puts hashes in another order.
_MIXES = tuple(np.uint64(x) for x in (1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_SYMBOLS = re.compile(r"[@$!€](?=\w)")
_SYMBOL = {"@": "a", "$": "s", "!": "i", "€": "e"}
_STRETCHED = re.compile(r"(\w)\1{2,}")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    """Lower case, compatibility forms, homoglyphs, digits for letters; i, l and 1 become one letter."""
    t = (text or "").casefold()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)
    t = t.translate(_TABLE)
    t = _SYMBOLS.sub(lambda m: _SYMBOL[m[0]], t)
    return _STRETCHED.sub(r"\1", t)


def features(folded: str) -> set[str]:
    """Words of three letters or more (``word=``) and their beginnings of 4 to 6 letters."""
    out = set()
    for w in set(_WORD.findall(folded)):
        if len(w) > 2:
            out.add(f"{w}=")
            out.update(w[:k] for k in (4, 5, 6) if len(w) >= k)
    return out


@dataclass
class Lexicon:
    """Weights by entry (``word=`` or a word beginning), exception phrases and the curve."""

    weights: dict[str, float] = field(default_factory=lambda: {f"{fold(w)}=": BASE_WEIGHT for w in BASE_WORDS})
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = BASE_CURVE

    def matcher(self):
        """A function from text to (weighted hits, number of words)."""
        import ahocorasick

        auto = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for k, v in self.weights.items():
            found.setdefault(k.removesuffix("="), []).append((k.endswith("="), v, False))
        for p in self.exceptions:
            found.setdefault(fold(p), []).append((True, 0.0, True))
        for k, v in found.items():
            auto.add_word(k, (len(k), v))
        if found:
            auto.make_automaton()

        def match(text: str | None) -> tuple[float, int]:
            t = fold(text)
            words = len(t.split())
            best: dict[int, float] = {}
            spared = []
            for end, (n, entries) in auto.iter(t) if found else ():
                start = end - n + 1
                if start and t[start - 1].isalnum():
                    continue
                ends = end + 1 == len(t) or not t[end + 1].isalnum()
                for whole, weight, exception in entries:
                    if exception and ends:
                        spared.append((start, end))
                    elif not exception and (ends or not whole) and weight > best.get(start, 0.0):
                        best[start] = weight
            for a, b in spared:
                for s in [s for s in best if a <= s <= b]:
                    del best[s]
            return sum(best.values()), words

        return match

    def score(self, weight: float, words: int) -> float:
        return float(1 / (1 + math.exp(-float(np.dot(self.curve, _inputs(weight, words))))))


def _inputs(weight: float, words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(weight), math.log1p(100 * weight / max(words, 1))


def _curve(points: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a ridge, by Newton's method; a flat or one-sided sample keeps the base curve."""
    if not 0 < labels.sum() < len(labels):
        return BASE_CURVE
    w, ridge = np.zeros(3), np.diag([0.001, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(points @ w, -30, 30)))
        step = np.linalg.solve((points * (p * (1 - p))[:, None]).T @ points + ridge, points.T @ (labels - p) - ridge @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    if w[1] < 0 or w[2] < 0:  # hits never make a text less toxic
        return BASE_CURVE
    return tuple(map(float, w))


def _counted(rows: DataFrame) -> DataFrame:
    """``rows(toxic, text)`` -> ``(feature, a, b)``: toxic and other rows that have it, summed within each task first."""

    def run(batches):
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for i in range(0, len(rows), 500):
                counts: tuple[Counter, Counter] = (Counter(), Counter())
                for toxic, t in rows[i : i + 500]:
                    counts[0 if toxic == 1 else 1].update(features(fold(t)))
                names = list(counts[0] | counts[1])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in counts]], names=["feature", "a", "b"])

    return rows.select("toxic", "text").mapInArrow(run, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _signature(text: str | None) -> int:
    """A number that texts share whose sets of three-word shingles have equal minima under each of ``_MIXES``: copies always, near copies mostly, texts with a phrase in common hardly ever."""
    import xxhash

    from .simhash import shingle_hashes

    h = shingle_hashes((text or "").encode(), 3)
    return xxhash.xxh64_intdigest(np.array([(h * m).min() for m in _MIXES]).tobytes()) >> 1 if len(h) else 0


def _signed_texts(rows: DataFrame) -> DataFrame:
    """``(toxic, text)`` with one row for each label of each group of texts that share a signature, so that copies count once.

    A label stays with a text of its own, the least one in its group; copies with different labels are a
    row for each label. Texts without words are one group.
    """

    def run(batches):
        for b in batches:
            sign = [_signature(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sign, pa.int64())], names=["toxic", "text", "sign"])

    signed = rows.mapInArrow(run, "toxic int, text string, sign long")
    return signed.groupBy("sign", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("toxic", "text")


def learning(doc_id) -> F.Column:
    """Rows whose labels may be learned: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learn a lexicon from at most ``max_rows`` labelled rows on the learning side of the split.

    An entry needs ``LEAST_ROWS`` toxic rows, and odds and a ratio that tell it from chance. The entries
    found, the counts of the built-in words and two numbers a sampled row come to the driver: as many as
    the sample can hold, whatever the size of the corpus.
    """
    from . import shared

    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learning(F.col(id_col)))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_rows)
    )
    joined = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "__id")
    rows = shared.save(_signed_texts(joined.select("toxic", "text")), "labelled")
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get(1, 0), sum(n for t, n in size.items() if t != 1)
    lexicon = Lexicon()
    if pos and neg:
        a, b = F.col("a").cast("double"), F.col("b").cast("double")
        odds = F.ln((a + 0.5) / (pos + 1)) - F.ln((b + 0.5) / (neg + 1))
        share = (a + b) / (pos + neg)
        part = lambda x, n: F.when(x > 0, x * F.ln(x / (n * share))).otherwise(0.0)
        base = F.col("feature").isin(*lexicon.weights)
        told = _counted(rows).withColumn("odds", odds).withColumn("ratio", 2 * (part(a, pos) + part(b, neg)))
        found = told.where((F.col("a") >= LEAST_ROWS) & (F.col("odds") > LEAST_ODDS) & (F.col("ratio") >= LEAST_RATIO) | base).collect()
        t = {r.feature: r.a for r in found}
        for r in found:
            if r.feature in lexicon.weights and r.b > 2 and r.odds < 1:
                del lexicon.weights[r.feature]
        scored = [(r.ratio, r.feature, r.odds) for r in found if r.a >= LEAST_ROWS and r.odds > LEAST_ODDS and r.ratio >= LEAST_RATIO]
        fullest: dict[str, int] = {}  # by beginning: the count of its most frequent longer entry
        for _, f, _ in scored:
            for k in (4, 5, 6):
                if len(f) > k and f[:k] != f:
                    fullest[f[:k]] = max(fullest.get(f[:k], 0), t[f])
        scored = [x for x in scored if fullest.get(x[1], 0) < 0.8 * t[x[1]]]  # "path" goes where "pathetic" says it all
        lexicon.weights |= {f: odds for _, f, odds in sorted(scored, reverse=True)}
        seen = measured(rows, lexicon).groupBy("toxic", "weight", "words").agg(F.count("*").alias("n")).orderBy("toxic", "weight", "words").toPandas()
        points = np.array([_inputs(w, k) for w, k in zip(seen.weight, seen.words, strict=True)])
        lexicon.curve = _curve(np.repeat(points, seen.n, axis=0), np.repeat((seen.toxic == 1).to_numpy(dtype=float), seen.n))
    shared.drop(rows)
    return lexicon


def measured(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` without their text, with ``weight`` and ``words``."""
    others = [f for f in docs.schema.fields if f.name != text_col]

    def run(batches):
        match = lexicon.matcher()
        for b in batches:
            got = [match(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [*b.columns[:-1], pa.array([w for w, _ in got], pa.float64()), pa.array([k for _, k in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*[f.name for f in others], "weight", "words"])

    from pyspark.sql import types as T

    schema = T.StructType([*others, T.StructField("weight", T.DoubleType()), T.StructField("words", T.LongType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in others], F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, weight, words, score)``; a row for each document."""
    found = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), lexicon)
    c = lexicon.curve
    w, k = F.col("weight"), F.greatest(F.col("words"), F.lit(1))
    z = F.lit(c[0]) + c[1] * F.log1p(w) + c[2] * F.log1p(100 * w / k)
    return found.withColumn("score", 1 / (1 + F.exp(-z)))


def reject(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; schema and other columns unchanged."""

    def run(batches):
        match = lexicon.matcher()
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([lexicon.score(*match(t)) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 2 over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = ~F.coalesce(learning(F.col("doc_id")), F.lit(True))
    return score(docs, lexicon).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "weight", "words")
