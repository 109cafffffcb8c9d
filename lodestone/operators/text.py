"""Text scans: lines of files against patterns, with line and column of each match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (rule, severity, pattern); ASCII boundaries, so that accented letters count alike in every engine.
RULES = (
    ("net.ipv4", "Warning", r"(?:^|[^A-Za-z0-9_.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    ("contact.email", "Info", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+"),
    ("legal.notice", "Info", r"[Cc]opyright|[Ll]icen[sc]e"),
)


def lines(files: DataFrame) -> DataFrame:
    """``(file_id, text)`` -> ``(file_id, line, content)``, lines from 1."""
    return files.select("file_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "content")).select("file_id", (F.col("at") + 1).alias("line"), "content")


def may_hit(files: DataFrame, rules=RULES) -> DataFrame:
    """Files whose whole text matches a rule: the only ones worth opening into lines."""
    return files.where(F.col("text").rlike("(?m)" + "|".join(f"(?:{p})" for _, _, p in rules)))


def scan(files: DataFrame, rules=RULES) -> DataFrame:
    """``(file_id, line, rule_id, severity, matches)``: lines that a rule matches."""
    found = [F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.regexp_count("content", F.lit(p)).alias("matches")) for r, s, p in rules]
    hits = lines(may_hit(files, rules)).select("file_id", "line", F.explode(F.filter(F.array(*found), lambda x: x["matches"] > 0)).alias("hit"))
    return hits.select("file_id", "line", "hit.rule_id", "hit.severity", "hit.matches")


def rule_counts(files: DataFrame, rules=RULES) -> DataFrame:
    """``(rule_id, severity, n)``: how many lines each rule matches, counted within each text before anything is exploded."""
    split = F.split("text", "\n", -1)

    def count(pattern: str):
        return F.when(F.col("text").rlike(f"(?m){pattern}"), F.size(F.filter(split, lambda x: x.rlike(pattern)))).otherwise(0)

    counts = [F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), count(p).alias("n")) for r, s, p in rules]
    rows = may_hit(files, rules).select(F.explode(F.array(*counts)).alias("c")).select("c.*").where("n > 0")
    return rows.groupBy("rule_id", "severity").agg(F.sum("n").alias("n"))
