"""Findings about dependencies, and the health of packages as told by their findings.

Advisories and latest versions are tables, ``advisories(ecosystem, name, version, advisory_id, score,
summary)`` and ``latest(ecosystem, name, latest)``; nothing is fetched. Without a row a package is taken
to be clean, or its latest version to be unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..sources import manifests
from .portability import _json, fingerprint


def _finding(rows: DataFrame, rule, message, severity, confidence, metadata) -> DataFrame:
    return rows.select(
        "path", rule.alias("rule_id"), "line", F.lit(1).alias("column"), message.alias("message"), F.lit(None).cast("string").alias("snippet"), severity.alias("severity"), confidence.alias("confidence"),
        fingerprint(rule, F.col("path"), F.col("line"), message).alias("fingerprint"), metadata.alias("metadata"),
    )


def once(findings: DataFrame) -> DataFrame:
    """One finding for each fingerprint, without case: the first by path and line."""
    first = F.min(F.struct(F.upper("path").alias("__p"), "line", "column", *[c for c in findings.columns if c not in ("line", "column")])).alias("r")
    return findings.groupBy(F.lower("fingerprint").alias("__f")).agg(first).select(*[F.col(f"r.{c}").alias(c) for c in findings.columns])


def analyse(files: DataFrame, advisories: DataFrame, latest: DataFrame) -> DataFrame:
    """Unpinned and vulnerable dependencies and old frameworks of ``files(path, text)``."""
    return findings(manifests.with_central_versions(manifests.dependencies(files)), manifests.old_frameworks(files), advisories, latest)


def findings(deps: DataFrame, frameworks: DataFrame, advisories: DataFrame, latest: DataFrame) -> DataFrame:
    """The same from ``deps(path, line, ecosystem, name, version, exact, pinned)`` and ``frameworks(path, line, framework, reason)``; names without case."""
    newest = latest.groupBy(F.col("ecosystem").alias("__e"), F.lower("name").alias("__n")).agg(F.max(F.struct(fn.version_weight(F.col("latest")).alias("weight"), "latest"))["latest"].alias("latest"))
    d = deps.join(newest, (deps["ecosystem"] == F.col("__e")) & (F.lower(deps["name"]) == F.col("__n")), "left").drop("__e", "__n")
    loose = d.where(~F.col("pinned"))
    told = _json(engine="deps", dependency=F.col("name"), ecosystem=F.col("ecosystem"), versionSpec=F.col("version"), latestVersion=F.col("latest"))
    text = F.concat(F.lit("Dependency '"), "name", F.lit("' is not pinned ('"), "version", F.lit("')."))
    out = _finding(loose, F.lit("deps.unpinned_version"), text, F.lit("Warning"), F.lit("High"), told)
    rank = F.when(fn.advisory_severity(F.col("score")) == "Critical", 3).when(fn.advisory_severity(F.col("score")) == "High", 2).otherwise(1)
    a = advisories.groupBy(F.col("ecosystem").alias("__e"), F.lower("name").alias("__n"), F.col("version").alias("__v")).agg(
        F.max(rank).alias("rank"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("advisory_id").alias("id"), fn.advisory_severity(F.col("score")).alias("severity"), "summary"))).alias("found")
    )
    hit = d.where("exact is not null").join(a, (d["ecosystem"] == a["__e"]) & (F.lower(d["name"]) == a["__n"]) & (d["exact"] == a["__v"]))
    rule = F.concat(F.lit("deps.vulnerable."), F.get(F.array(F.lit("medium"), F.lit("high"), F.lit("critical")), F.col("rank") - 1))
    text = F.concat(F.lit("Dependency '"), "name", F.lit(" "), "exact", F.lit("' has "), F.col("n").cast("string"), F.lit(" known vulnerabilities."))
    told = _json(engine="deps", dependency=F.col("name"), ecosystem=F.col("ecosystem"), version=F.col("exact"), latestVersion=F.col("latest"), vulnerabilities=F.col("found"))
    out = out.unionByName(_finding(hit, rule, text, F.when(F.col("rank") >= 2, "Error").otherwise("Warning"), F.when(F.col("rank") == 3, "High").otherwise("Medium"), told))
    told = _json(engine="deps", type="framework", framework=F.col("framework"), reason=F.col("reason"))
    old = _finding(frameworks, F.lit("deps.eol.framework"), F.concat(F.lit("Framework out of support: "), "framework", F.lit(".")), F.lit("Warning"), F.lit("High"), told)
    return once(out.unionByName(old))


def health(found: DataFrame) -> DataFrame:
    """Dependency findings (``finding_id, rule_id, metadata``) -> a row for each package: version in use, latest, pinned, advisories, worst severity, staleness.

    The version is that of the last finding that names one, else the requirement of the first; names without case.
    """
    shape = "struct<type:string,dependency:string,ecosystem:string,version:string,versionSpec:string,latestVersion:string,vulnerabilities:array<struct<id:string,severity:string,summary:string>>>"
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    m = found.select("finding_id", "rule_id", F.from_json("metadata", shape).alias("m")).select("finding_id", "rule_id", "m.*")
    m = m.where(F.coalesce(F.lower("type"), F.lit("")) != "framework").where(blank("dependency").isNotNull()).withColumn("ecosystem", F.coalesce("ecosystem", F.lit("Unknown")))
    loose = F.col("rule_id") == "deps.unpinned_version"
    g = m.groupBy(F.lower("ecosystem").alias("ke"), F.lower("dependency").alias("kd")).agg(
        F.min_by("dependency", "finding_id").alias("name"), F.min_by("ecosystem", "finding_id").alias("ecosystem"), F.max_by(blank("version"), F.when(blank("version").isNotNull(), F.col("finding_id"))).alias("version"),
        F.min_by(blank("versionSpec"), F.when(blank("versionSpec").isNotNull(), F.col("finding_id"))).alias("spec"), F.max_by(blank("latestVersion"), F.when(blank("latestVersion").isNotNull(), F.col("finding_id"))).alias("latest"),
        (F.count_if(loose) == 0).alias("pinned"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("vulnerabilities", F.array().cast("array<struct<id:string,severity:string,summary:string>>"))))).alias("found"),
    )
    ranks = F.transform("found", lambda x: fn.advisory_rank(x["severity"]))
    current = F.coalesce("version", "spec")
    return g.select(
        "name", "ecosystem", current.alias("version"), "latest", "pinned", F.size(F.array_distinct(F.transform("found", lambda x: F.lower(x["id"])))).alias("advisories"), F.coalesce(F.array_max(ranks), F.lit(0)).alias("severity_rank"),
        F.round(F.coalesce(fn.staleness(current, F.col("latest")), F.lit(0.0)), 4).alias("staleness"), F.lit(False).alias("end_of_life"),
    )


def health_page(packages: DataFrame, search: str = "", pinned: str = "", advisories_only: bool = False, end_of_life_only: bool = False, sort: str = "", descending: bool = False) -> DataFrame:
    """Packages that pass the filters, in order: by staleness, by name, or by severity and number of advisories."""
    if search.strip():
        term = search.strip().lower()
        packages = packages.where(F.lower("name").contains(term) | F.lower("ecosystem").contains(term) | F.coalesce(F.lower("version").contains(term), F.lit(False)))
    if pinned.strip().lower() in ("yes", "no"):
        packages = packages.where(F.col("pinned") == (pinned.strip().lower() == "yes"))
    if advisories_only:
        packages = packages.where("advisories > 0")
    if end_of_life_only:
        packages = packages.where("end_of_life")
    to = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    name = F.upper("name")
    orders = {"staleness": [to("staleness"), F.desc("severity_rank"), name], "name": [name.desc() if descending else name.asc()]}
    return packages.orderBy(*orders.get(sort.strip().lower(), [to("severity_rank"), to("advisories"), name]), "ecosystem")


def frameworks(found: DataFrame) -> DataFrame:
    """``(framework, reason)`` of the findings about frameworks, once each."""
    f = lambda n: F.get_json_object("metadata", f"$.{n}")
    rows = found.where(F.lower(f("type")) == "framework").select("finding_id", f("framework").alias("framework"), F.coalesce(f("reason"), F.lit("Out-of-support framework/runtime detected.")).alias("reason")).where(F.trim("framework") != "")
    g = rows.groupBy(F.lower("framework").alias("k")).agg(F.min(F.struct("finding_id", "framework", "reason")).alias("r"))
    return g.select("r.framework", "r.reason").orderBy(F.upper("framework"))
