"""Sinks: findings as CSV, JSON, SARIF, an HTML page or Parquet.

CSV and Parquet are folders that the tasks write. The other forms are one document on any file system that
Hadoop knows: its rows are made by expressions and written by tasks as parts, in the order of the rows, and
the parts are joined by streams within the JVM, so no row comes to Python and none is held. A document gets
its name when it is whole. Rows in a total order give the same bytes however they are partitioned.
"""

from __future__ import annotations

import html
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of a CSV export, in order; those that a table lacks are empty.
COLUMNS = ("finding_id", "run_id", "rule_id", "rule_title", "severity", "confidence", "file_path", "line", "column", "message", "snippet", "fingerprint", "metadata")
KINDS = ("csv", "json", "sarif", "html", "parquet")
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json"


def export(findings: DataFrame, path: str, kind: str = "csv", mode: str = "error", run: dict | None = None, filters: dict | None = None) -> None:
    """Write ``findings`` in one of ``KINDS``; of any other kind nothing is written."""
    w = findings.write.mode(mode)
    if kind == "csv":
        csv_rows(findings).write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)
    elif kind == "parquet":
        w.parquet(path)
    elif kind in ("json", "sarif", "html"):
        _document(path, *{"json": json_parts, "sarif": sarif_parts, "html": html_parts}[kind](findings, run or {}, filters or {}))
    else:
        raise ValueError(f"no such kind of export: {kind}")


def _document(path: str, head: str, rows: DataFrame, between: str, tail: str) -> None:
    """``head``, the texts of ``rows`` with ``between`` between them, ``tail``."""
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = uuid.uuid4().hex
    at = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    parts, draft, whole = f"{path}.{mark}.parts", at(f"{path}.{mark}.tmp"), at(path)
    rows.write.option("lineSep", between).text(parts)
    fs = whole.getFileSystem(conf)
    try:
        found = sorted((s.getPath().getName(), s.getPath(), s.getLen()) for s in fs.listStatus(at(parts)) if s.getPath().getName().startswith("part-") and s.getLen())
        out = fs.create(draft, True)
        out.write(bytearray(head.encode()))
        for i, (_, part, size) in enumerate(found):
            count = size - (len(between.encode()) if i + 1 == len(found) else 0)
            stream = fs.open(part)
            jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, count)
            stream.close()
        out.write(bytearray(tail.encode()))
        out.close()
        fs.delete(whole, False)
        if not fs.rename(draft, whole):
            raise OSError(f"{path} cannot be written")
    finally:
        fs.delete(at(parts), True)
        fs.delete(draft, False)


def _all(findings: DataFrame, columns=COLUMNS) -> DataFrame:
    return findings.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in findings.columns else F.lit(None).cast("string").alias(c) for c in columns])


def csv_rows(findings: DataFrame) -> DataFrame:
    """The thirteen columns, as texts."""
    return _all(findings)


def json_rows(findings: DataFrame) -> DataFrame:
    """``row``: each finding as a JSON object, missing values included."""
    return findings.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in findings.columns]), {"ignoreNullFields": "false"}).alias("row"))


def json_parts(findings: DataFrame, run: dict, filters: dict):
    head = json.dumps({"run": run, "filters": filters}, default=str)[:-1]
    return f'{head}, "findings": [', json_rows(findings), ",\n", "]}"


def sarif_level(severity="severity") -> F.Column:
    return F.when(F.col(severity) == "Error", "error").when(F.col(severity) == "Warning", "warning").otherwise("note")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """``row``: each rule once, with the title and level of its first finding."""
    title = F.col("rule_title") if "rule_title" in findings.columns else F.col("rule_id")
    g = findings.groupBy("rule_id").agg(F.min(F.struct("file_path", "line", "fingerprint", title.alias("title"), sarif_level().alias("level"))).alias("r"))
    shape = F.struct(F.col("rule_id").alias("id"), F.struct(F.col("r.title").alias("text")).alias("shortDescription"), F.struct(F.col("r.level").alias("level")).alias("defaultConfiguration"))
    return g.orderBy("rule_id").select(F.to_json(shape).alias("row"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """``row``: each finding as a result; lines and columns start at 1."""
    region = F.struct(F.greatest(F.lit(1), "line").alias("startLine"), F.greatest(F.lit(1), F.coalesce("column", F.lit(1))).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    shape = F.struct(F.col("rule_id").alias("ruleId"), sarif_level().alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))
    return findings.select(F.to_json(shape).alias("row"))


def sarif_parts(findings: DataFrame, run: dict, filters: dict):
    rules = ",".join(r.row for r in sarif_rules(findings).collect())  # a row for each rule of the catalogue
    head = f'{{"$schema": "{SARIF_SCHEMA}", "version": "{SARIF_VERSION}", "runs": [{{"tool": {{"driver": {{"name": "lodestone", "version": {json.dumps(str(run.get("tool_version", "")))}, "rules": [{rules}]}}}}, "results": ['
    return head, sarif_results(findings), ",\n", "]}]}"


def html_rows(findings: DataFrame) -> DataFrame:
    """``row``: a table row of HTML for each finding, cells escaped."""
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("</td>"))
    return findings.select(F.concat(F.lit("<tr>"), *[cell(c) for c in findings.columns], F.lit("</tr>")).alias("row"))


def html_parts(findings: DataFrame, run: dict, filters: dict):
    names = "".join(f"<th>{html.escape(c)}</th>" for c in findings.columns)
    title = html.escape(f"Findings of run {run.get('run_id', '')}")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1><table><tr>{names}</tr>", html_rows(findings), "\n", "</table></body></html>"
