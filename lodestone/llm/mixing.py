"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is due ``target / source size`` copies. The whole part is taken outright.
The fractional parts are rounded by the pivotal method: two documents exchange mass, in words, until
one of them is due a whole copy; the direction is drawn so that expectations stay as they were, and
the words due in total do not change. Chunks of a source are rounded side by side, each leaves at most
one fractional document (a small one, as the largest go first), and a reduction tree of fan-in ``FAN_IN`` rounds those among themselves, so
the words taken of a source miss the target by less than one document.

Randomness comes from hashes of the seed and of each pair, so reruns agree. Defined results: a null
text has size 0; documents of size 0 take 0 words; a null source is a source of its own, last in
order; repeated rows are rounded as separate documents; an empty table gives an empty result; further
columns are passed through by ``mix_rows`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3.0
#: Documents a chunk holds on average; leftovers that a node of the tree rounds.
CHUNK_ROWS, FAN_IN = 2_000, 1_000
WORD = r"[^\x20\x09-\x0D]+"
SEED = 7


def sizes(text) -> F.Column:
    """Number of words separated by ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights=WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """``per_source(source, source_size)`` -> with ``weight`` and ``target``.

    Sources share all words by weight; a source stops at ``limit`` times its size and the excess is
    shared again among the others. Each round sees one row of totals on the driver; every round but
    the last stops at least one more source.
    """
    w = Window.orderBy(F.col("source").isNull(), "source")  # one row a source
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    ranked = per_source.withColumn("weight", F.element_at(cycle, ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int")))
    ranked = shared.save(ranked, "sources")
    full = limit * F.col("source_size")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        r = ranked.agg(
            F.sum(F.when(level * F.col("weight") >= full, full).otherwise(0.0)).alias("stopped"),
            F.sum(F.when(level * F.col("weight") >= full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not r.open:
            break
        new = (total - r.stopped) / r.open
        if new <= level * (1 + 1e-12):
            break
        level = new
    return ranked.withColumn("target", F.least(level * F.col("weight"), full.cast("double")))


def _draw(*parts) -> float:
    """A number in [0, 1) from a hash."""
    import xxhash

    return xxhash.xxh64_intdigest(repr(parts).encode(), SEED) / 2**64


def pivot(sizes_, chances, salt) -> tuple[np.ndarray, int]:
    """Round chances of documents one after another; returns them and the place of the one left fractional (-1: none)."""
    import xxhash

    p, left = np.array(chances, dtype=float), -1
    eps = 1e-9
    for j in range(len(p)):
        if p[j] <= eps or p[j] >= 1 - eps:
            p[j] = round(p[j])
            continue
        if left < 0:
            left = j
            continue
        i, a, b = left, float(sizes_[left]), float(sizes_[j])
        up = min((1 - p[i]) * a, p[j] * b)  # words that can go from j to i
        down = min(p[i] * a, (1 - p[j]) * b)  # and from i to j
        u = xxhash.xxh64_intdigest(f"{salt}|{j}", SEED) / 2**64
        d = up if u * (up + down) < down else -down
        p[i] += d / a
        p[j] -= d / b
        for k in (i, j):
            if p[k] <= eps or p[k] >= 1 - eps:
                p[k] = round(p[k])
        left = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p, left


def _round_groups(rows: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """Round each group's ``chance``; a group's leftover keeps its fraction unless ``last``, which draws."""
    names = rows.columns

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # the largest first, so that what is left over is small
        pdf = pdf.sort_values(["size", "key", "nth"], ascending=[False, True, True]).reset_index(drop=True)
        p, left = pivot(pdf["size"].to_numpy(), pdf["chance"].to_numpy(), tuple(map(str, key)))
        if last and left >= 0:
            p[left] = float(_draw(*map(str, key), "last") < p[left])
        pdf["chance"] = p
        return pdf[names]

    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


def _rounded(rows: DataFrame) -> DataFrame:
    """``rows(key, nth, sid, size, chance)`` -> ``(key, nth, extra)`` with extra 0 or 1; a reduction tree over chunks."""
    per = rows.groupBy("sid").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / CHUNK_ROWS).cast("int"))
    dealt = rows.join(per.select("sid", "chunks"), "sid").withColumn("chunk", F.pmod(F.xxhash64("key", "nth"), F.col("chunks")).cast("int")).drop("chunks")
    most = per.agg(F.max("chunks")).first()[0] or 0
    level, done = dealt.select("key", "nth", "sid", "size", "chance", "chunk"), []
    while True:
        out = shared.save(_round_groups(level, ["sid", "chunk"], most <= 1), "rounded")
        done.append(out.where("chance <= 0 or chance >= 1").select("key", "nth", F.col("chance").cast("int").alias("extra")))
        if most <= 1:
            break
        level = out.where("chance > 0 and chance < 1").withColumn("chunk", (F.col("chunk") / FAN_IN).cast("int"))
        most = -(-most // FAN_IN)
    whole = done[0]
    for d in done[1:]:
        whole = whole.union(d)
    return whole


def _key(docs: DataFrame) -> F.Column:
    """Hash of a row's columns, all of them. A hash passes over nulls, so their places are hashed as well."""
    parts = []
    for f in docs.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        parts += [c.isNull(), F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) if nested else c]
    return F.xxhash64(*parts)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``nth``: 0 for a ``key`` that occurs once, else 0, 1, 2 ... over the rows of the key, which are alike.

    The rows of a frequent key are numbered within parts, and each part goes on from those before it, so
    the numbers are the same however the rows are dealt and no task gathers a whole key.
    """
    same = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    alone = rows.join(same, "key", "left_anti").withColumn("nth", F.lit(0).cast("long"))
    again = shared.save(rows.join(same, "key", "left_semi").withColumn("part", F.spark_partition_id()), "repeated")
    w = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = again.groupBy("key", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    inside = again.withColumn("inside", F.row_number().over(Window.partitionBy("key", "part").orderBy("key")) - 1)
    return alone.unionByName(inside.join(before, ["key", "part"]).withColumn("nth", F.col("before") + F.col("inside")).drop("part", "before", "inside"))


def mix(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken, key, nth)``: a row for each document.

    ``key`` and ``nth`` identify a document: a hash of its values, and a count where whole rows repeat.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), sizes(F.col(text_col)).alias("size"), _key(docs).alias("key"))
    counted = shared.save(raw, "sizes")
    rows = numbered(counted)
    plan = targets(counted.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    plan = shared.save(plan.withColumn("sid", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())), "targets")
    due = (F.col("target") / F.greatest("source_size", F.lit(1))).alias("due")
    joined = rows.withColumn("sid", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())).join(plan.select("sid", "source_size", "target", due), "sid")
    base = shared.save(joined.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("due") + 1e-9)).otherwise(0)), "due")
    fractional = base.where("size > 0 and due - whole > 1e-9").select("key", "nth", "sid", F.col("size").cast("double").alias("size"), (F.col("due") - F.col("whole")).alias("chance"))
    extra = _rounded(fractional)
    out = base.join(extra, ["key", "nth"], "left").withColumn("copies", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "key", "nth")


def mix_rows(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; same columns."""
    got = mix(docs, weights, limit, id_col, text_col, source_col)
    # rows that repeat whole are alike, so their copies may be summed and spread over any one of them
    key, copies, many = (shared.free(docs, c) for c in ("row_key", "copies", "rows"))
    total = got.where("copies > 0").groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(many))
    keyed = docs.withColumn(key, _key(docs)).join(total, key)
    rest = keyed.where(F.col(many) == 1).unionByName(keyed.where(F.col(many) > 1).dropDuplicates([key]))
    rest = rest.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 8 over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
