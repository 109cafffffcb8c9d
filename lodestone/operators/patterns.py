"""Many path patterns at once: entries are rows, met through the folder that their pattern begins with.

An entry's pattern is a glob; the folders before its first wildcard must begin every path that fits. A path
meets the entries of its own folders only (equality joins), and only those are compared, pattern by
pattern. So a plan is as short for thousands of entries as for one, and a path is held against the few
that may fit. Entries are a configuration; their table is as large as the files that people wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import globs


def folder_of(glob: str) -> str:
    """The folders, in lower case, that every path begins with that fits the glob; empty if there are none."""
    g = glob.replace("\\", "/").lower()
    plain = g[: min((g.index(c) for c in "*?" if c in g), default=len(g))]
    return plain.rpartition("/")[0]


def folders_of(path) -> F.Column:
    """All folders above a path, in lower case, from the empty one on."""
    parts = F.split(F.lower(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def met(rows: DataFrame, entries: list[tuple], dialect=globs.strict, more: str = "") -> DataFrame:
    """``rows`` with each of ``entries`` whose glob fits their ``path``, and its place ``nth``.

    An entry is a glob and further values, named by ``more`` (as in a schema); they become columns.
    """
    spark = rows.sparkSession
    names = ["nth", "folder", "regex"]
    table = [(i, folder_of(g), dialect(g), *rest) for i, (g, *rest) in enumerate(entries)]
    schema = ", ".join([f"__{n} {k}" for n, k in zip(names, ("int", "string", "string"), strict=True)] + ([more] if more else []))
    told = rows.withColumn("__at", F.explode(folders_of(F.col("path")))).join(spark.createDataFrame(table, schema), F.col("__at") == F.col("__folder"))
    return told.where(F.rlike("path", F.col("__regex"))).drop("__at", "__folder", "__regex").withColumnRenamed("__nth", "nth")


def first(paths: DataFrame, entries: list[tuple[str, str]], dialect=globs.loose) -> DataFrame:
    """``paths(path)`` -> ``(path, value)``: the value of the first ``(glob, value)`` that fits; paths that none fits are left out."""
    got = met(paths.select("path").distinct(), entries, dialect, "__value string")
    return got.groupBy("path").agg(F.min_by("__value", "nth").alias("value"))


def without(findings: DataFrame, entries: list[dict], dialect=globs.strict) -> DataFrame:
    """``findings`` that no entry covers: entries have a ``path`` glob, a ``rule``, and perhaps a ``pattern`` over message and snippet, without case, or a ``fingerprint``.

    One anti-join for each depth of folders that entries begin with, on rule and folder; findings are
    computed once and keep their number of rows on the way.
    """
    clean = lambda e, k: str(e.get(k) or "").strip()
    by_depth: dict[int, list] = {}
    for e in entries:
        glob = clean(e, "path") or "**"
        folder = folder_of(glob)
        row = (clean(e, "rule").lower(), folder, dialect(glob), f"(?i){e['pattern']}" if clean(e, "pattern") else None, clean(e, "fingerprint").lower() or None)
        by_depth.setdefault(folder.count("/") + 1 if folder else 0, []).append(row)
    parts = F.split(F.lower("path"), "/")
    told = F.concat_ws("\n", "message", F.coalesce("snippet", F.lit("")))
    mark = F.coalesce(F.lower("fingerprint"), F.lit("")) if "fingerprint" in findings.columns else F.lit("")
    for depth, rows in sorted(by_depth.items()):
        own = findings.sparkSession.createDataFrame(rows, "__rule string, __folder string, __regex string, __pattern string, __print string")
        folder = F.array_join(F.slice(parts, F.lit(1), F.lit(depth)), "/") if depth else F.lit("")
        fits = (F.lower("rule_id") == F.col("__rule")) & (folder == F.col("__folder")) & F.rlike("path", F.col("__regex"))
        fits = fits & (F.col("__pattern").isNull() | F.rlike(told, F.col("__pattern"))) & (F.col("__print").isNull() | (mark == F.col("__print")))
        findings = findings.join(F.broadcast(own), fits, "left_anti")  # a row an entry
    return findings
