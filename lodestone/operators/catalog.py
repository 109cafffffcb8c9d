"""The catalogue of built-in rules, their categories, and the union of catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: rule ids and default severities of the built-in families
WARNING, ERROR, INFO = "Warning", "Error", "Info"
PORTABILITY = {
    "portability.hardcoded.ipv4": WARNING,
    "portability.hardcoded.dns": WARNING,
    "portability.hardcoded.filepath.windows": WARNING,
    "portability.hardcoded.filepath.linux": WARNING,
    "portability.hardcoded.guid": WARNING,
    "portability.hardcoded.region": WARNING,
    "portability.hardcoded.endpoint": WARNING,
    "portability.hardcoded.connectionstring": ERROR,
    "portability.hardcoded.localhost": WARNING,
    "portability.hardcoded.registrykey": WARNING,
    "portability.cloud.sdk.no_abstraction": WARNING,
    "portability.hardcoded.port": WARNING,
}
MAGIC = {"magic-string.high-frequency": INFO, "magic-string.comparison-used": INFO, "magic-string.candidate": INFO}
CHURN = {
    "churn.ownership.orphaned_knowledge_risk": WARNING,
    "churn.stale.file_risk": INFO,
    "churn.ownership.never_changed_since_import": INFO,
    "churn.analysis.unavailable": INFO,
}
DEPLOY = {
    "deploy.ev2.hardcoded.subscription": WARNING,
    "deploy.ev2.hardcoded.tenant": WARNING,
    "deploy.ev2.hardcoded.endpoint": WARNING,
    "deploy.ev2.hardcoded.region": WARNING,
    "deploy.ev2.zero_bake_time": ERROR,
    "deploy.ev2.no_health_check": WARNING,
    "deploy.ev2.single_region": WARNING,
    "deploy.ev2.inline_secret": ERROR,
    "deploy.ev2.env_constant": WARNING,
    "deploy.ado.hardcoded.agentpool": WARNING,
    "deploy.ado.hardcoded.path": WARNING,
    "deploy.ado.hardcoded.endpoint": WARNING,
    "deploy.ado.inline_secret": ERROR,
    "deploy.ado.platform_assumption": WARNING,
    "deploy.ado.missing_approval": WARNING,
    "deploy.ado.container_latest": WARNING,
    "deploy.artifact.parse_error": WARNING,
}
DRIFT = {"config.drift.missing_key": WARNING, "config.drift.orphan_key": WARNING, "config.drift.hardcoded_env_value": WARNING}
DEPENDENCIES = {"deps.vulnerable.critical": ERROR, "deps.vulnerable.high": ERROR, "deps.vulnerable.medium": WARNING, "deps.eol.framework": WARNING, "deps.unpinned_version": WARNING}
HYGIENE = {
    "hygiene.stale_feature_flag": WARNING,
    "hygiene.dead_feature_flag": WARNING,
    "hygiene.todo_old": WARNING,
    "hygiene.fixme": WARNING,
    "hygiene.hack": WARNING,
    "async.sync_over_async": WARNING,
    "async.async_void": WARNING,
    "async.nested_runtime": WARNING,
    "thread.bad_lock_target": ERROR,
}
FAMILIES = (PORTABILITY, MAGIC, CHURN, DEPLOY, DRIFT, DEPENDENCIES, HYGIENE)


def merged(*families: dict[str, str]) -> dict[str, str]:
    """Families as one, a later one winning over an earlier one; ids are compared without case."""
    out: dict[str, tuple[str, str]] = {}
    for family in families:
        out |= {rule.lower(): (rule, severity) for rule, severity in family.items()}
    return dict(out.values())


RULES = merged(*FAMILIES)


def title(rule: str) -> str:
    """A title made of the last parts of an id."""
    return " ".join(rule.replace("_", " ").replace("-", " ").split(".")[1:]).capitalize()


def builtin(spark: SparkSession, families=FAMILIES) -> DataFrame:
    """``(rule_id, title, default_severity, description)`` of the built-in rules."""
    rows = [(r, title(r), s, f"Finds {title(r).lower()}.") for r, s in merged(*families).items()]
    return spark.createDataFrame(rows, "rule_id string, title string, default_severity string, description string")


def first_wins(*catalogues: DataFrame) -> DataFrame:
    """Rows of several rule tables, one for each id (without case): that of the first table, and there the least."""
    union = None
    for i, c in enumerate(catalogues):
        part = c.select("rule_id", "title", "default_severity", "description", F.lit(i).alias("__at"))
        union = part if union is None else union.unionByName(part)
    w = Window.partitionBy(F.lower("rule_id")).orderBy("__at", "rule_id", "title", "default_severity", "description")
    return union.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__at")


def category(rule="rule_id") -> F.Column:
    """The five groups of the store's catalogue."""
    r = F.col(rule)
    return (
        F.when(r.ilike("portability.%"), "portability").when(r.ilike("magic-string.%"), "magic-strings")
        .when(r.ilike("churn.%") | r.ilike("git-history.%"), "churn").when(r.ilike("deploy.%"), "deploy").otherwise("custom")
    )
