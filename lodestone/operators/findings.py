"""Operators over findings: pivots, rankings, pages, comparison of runs, policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def severity_rank(severity="severity") -> F.Column:
    """Error 0, Warning 1, Info 2, others 3."""
    s = F.col(severity)
    return F.when(s == "Error", 0).when(s == "Warning", 1).when(s == "Info", 2).otherwise(3)


def severity_pivot() -> list[F.Column]:
    """Total and a count for each severity."""
    each = [F.count_if(F.col("severity") == s).alias(f"{s.lower()}_count") for s in ("Error", "Warning", "Info")]
    return [F.count("*").alias("total"), *each]


def pivot_by(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts by severity for each key."""
    return findings.groupBy(*keys).agg(*severity_pivot())


def filtered(findings: DataFrame, severity: str = "", rule: str = "", rule_prefix: str = "", confidence: str = "", path_prefix: str = "", run_id=None) -> DataFrame:
    """Conjunction of the filters that are not blank."""
    for name, value in (("severity", severity), ("rule_id", rule), ("confidence", confidence)):
        if value.strip():
            findings = findings.where(F.col(name) == value)
    for name, value in (("rule_id", rule_prefix), ("file_path", path_prefix)):
        if value.strip():
            findings = findings.where(F.col(name).startswith(value))
    return findings if run_id is None else findings.where(F.col("run_id") == run_id)


def page(findings: DataFrame, offset: int = 0, limit: int = 50, descending: bool = False) -> DataFrame:
    """A page by severity; ties by rule, path, line and the rest."""
    first = severity_rank().desc() if descending else severity_rank().asc()
    rest = ["rule_id", "file_path", "line", "confidence", "fingerprint", "run_id"]
    return findings.orderBy(first, *rest).offset(max(0, offset)).limit(min(max(1, limit), 500))


def top_files(findings: DataFrame, limit: int = 10) -> DataFrame:
    """Files with the most findings of high confidence."""
    high = findings.where(F.col("confidence") == "High")
    return pivot_by(high, "file_path").orderBy(F.desc("total"), "file_path").limit(min(max(1, limit), 200))


def risk_ranking(findings: DataFrame, limit: int = 5) -> DataFrame:
    """Files by risk: 5 for an error, 2 for a warning, 1 otherwise."""
    weight = F.when(F.col("severity") == "Error", 5).when(F.col("severity") == "Warning", 2).otherwise(1)
    return findings.groupBy("file_path").agg(F.sum(weight).alias("risk")).orderBy(F.desc("risk"), "file_path").limit(min(max(1, limit), 100))


def rule_catalog(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules(rule_id, default_severity)`` with totals over all runs and the effective state; findings are counted by rule and severity before the join."""
    few = findings.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))
    joined = few.join(rules, "rule_id", "right").groupBy("rule_id", "default_severity")
    out = joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("severity") != F.col("default_severity"), F.col("n"))), F.lit(0)).alias("override_hits"))
    return out.withColumn("state", F.when(F.col("total") == 0, "No Findings").when(F.col("override_hits") > 0, "Overridden").otherwise("Enabled"))


def _prints(findings: DataFrame, run_id) -> DataFrame:
    return findings.where((F.col("run_id") == run_id) & (F.trim("fingerprint") != ""))


def compare_counts(findings: DataFrame, baseline, target) -> DataFrame:
    """Distinct fingerprints that are new, fixed and unchanged, in one pass over both runs."""
    both = findings.where(F.col("run_id").isin(baseline, target) & (F.trim("fingerprint") != ""))
    seen = both.groupBy("fingerprint").agg(F.bool_or(F.col("run_id") == baseline).alias("old"), F.bool_or(F.col("run_id") == target).alias("new"))
    return seen.agg(F.count_if(F.col("new") & ~F.col("old")).alias("new_count"), F.count_if(F.col("old") & ~F.col("new")).alias("fixed_count"), F.count_if(F.col("old") & F.col("new")).alias("unchanged_count"))


def only_in(findings: DataFrame, run_id, other) -> DataFrame:
    """First row of each fingerprint that the other run lacks, by rule, path, line, severity and confidence; found by an aggregate, so few rows are shuffled."""
    rows = _prints(findings, run_id).join(_prints(findings, other).select("fingerprint").distinct(), "fingerprint", "left_anti")
    order = [F.col(c) for c in ("rule_id", "file_path", "line")] + [severity_rank().alias("__rank"), F.col("confidence")]
    rest = [c for c in rows.columns if c not in ("fingerprint", "rule_id", "file_path", "line", "confidence")]
    first = rows.groupBy("fingerprint").agg(F.min(F.struct(*order, *rest)).alias("r"))
    return first.select(*[F.col("fingerprint") if c == "fingerprint" else F.col(f"r.{c}").alias(c) for c in findings.columns])


def apply_policy(findings: DataFrame, policy: DataFrame, allowed: DataFrame) -> DataFrame:
    """``policy(rule_id, enabled, severity)`` and ``allowed(rule_id, path_prefix)``: drop disabled and allowed findings, rewrite severities."""
    p = policy.select(F.lower("rule_id").alias("__rule"), "enabled", F.col("severity").alias("__severity"))
    kept = findings.join(p, F.lower("rule_id") == F.col("__rule"), "left").where(F.coalesce("enabled", F.lit(True)))
    out = kept.withColumn("severity", F.coalesce("__severity", "severity")).drop("__rule", "__severity", "enabled")
    a = allowed.select(F.col("rule_id").alias("__rule"), F.col("path_prefix").alias("__prefix"))
    return out.join(a, (F.col("rule_id") == F.col("__rule")) & F.col("file_path").startswith(F.col("__prefix")), "left_anti")
