"""Settings that drift, suppressions, user rules and ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def config_drift(settings: DataFrame, environments) -> DataFrame:
    """``settings(key, env, value)`` -> ``(key, rule_id, env)``: keys in one environment only, missing in some, or hard-coded with several values."""
    values = F.array_distinct(F.filter(F.collect_set(F.trim("value")), lambda v: v.isNotNull()))
    g = settings.groupBy("key").agg(F.collect_set("env").alias("envs"), F.size(values).alias("n_values"), F.bool_or(~F.col("value").rlike(r"^\s*(\$\{[^}]*\}|\$\([^)]*\)|\{\{[^}]*\}\})\s*$")).alias("fixed"))
    absent = F.array_except(F.array(*[F.lit(e) for e in environments]), F.col("envs"))
    hit = lambda rule, env: F.struct(F.lit(rule).alias("rule_id"), env.cast("string").alias("env"))
    none = F.array().cast("array<struct<rule_id:string,env:string>>")
    rules = F.when(F.size("envs") == 1, F.array(hit("drift.orphan", F.element_at("envs", 1)))).otherwise(
        F.concat(F.transform(absent, lambda e: hit("drift.missing", e)), F.when((F.col("n_values") >= 2) & F.col("fixed"), F.array(hit("drift.differs", F.lit(None)))).otherwise(none))
    )
    return g.select("key", F.explode(rules).alias("r")).select("key", "r.rule_id", "r.env")


def suppression_overview(findings: DataFrame, suppressed) -> DataFrame:
    """Active and suppressed findings of each rule, and the total without suppressions."""
    s = F.coalesce(suppressed, F.lit(False))
    return findings.groupBy("rule_id").agg(F.count_if(~s).alias("active"), F.count_if(s).alias("suppressed"), F.count("*").alias("total"))


def custom_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files(file_id, category, text)`` with ``rules(rule_id, pattern, categories)``, a table of configuration -> hits over whole texts, which may span lines."""
    r = [(x.rule_id, x.pattern, list(x.categories)) for x in rules.collect()]  # configuration, a row for each rule a user wrote
    if not r:
        return files.select("file_id", F.lit("").alias("rule_id"), F.lit(0).alias("matches")).limit(0)
    hits = [F.struct(F.lit(i).alias("rule_id"), F.when(F.col("category").isin(*c), F.regexp_count("text", F.lit(p))).otherwise(0).alias("matches")) for i, p, c in r]
    return files.select("file_id", F.explode(F.filter(F.array(*hits), lambda x: x["matches"] > 0)).alias("h")).select("file_id", "h.rule_id", "h.matches")


def ownership_risk(commits: DataFrame, concentration: DataFrame, now, least: float = 0.8, idle_days: int = 90) -> DataFrame:
    """Paths whose commits are concentrated above ``least`` and whose top author has been idle for over ``idle_days``."""
    from .history import author_counts

    w = Window.partitionBy("path").orderBy(F.desc("n"), F.desc("newest"), "author")
    top = author_counts(commits).withColumn("o", F.row_number().over(w)).where("o = 1")
    idle = F.unix_micros(F.lit(now)) - F.unix_micros("newest") > idle_days * 86_400_000_000
    return top.join(concentration.where(F.col("concentration") > least), "path").where(idle).select("path", "author", "concentration")
