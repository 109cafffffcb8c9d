"""Scans: detectors over the files of a repository, policy, and the union of all into one run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import config as cfg
from ..sources import files as fl
from ..sources import git
from ..sources import store as st
from . import artifacts, catalog, dependencies, drift, history, hygiene, magic, patterns, portability

VERSION = "0.2"


def apply_policy(findings: DataFrame, bundle: cfg.Bundle) -> DataFrame:
    """Findings of rules that are on and not allowed, with the severities in force; rules that are not listed stay as they are."""
    p = findings.sparkSession.createDataFrame([(r.lower(), e, s) for r, e, s in bundle.policy_rows()], "__rule string, __on boolean, __severity string")
    out = findings.join(F.broadcast(p), F.lower("rule_id") == F.col("__rule"), "left").where(F.coalesce("__on", F.lit(True)))  # a row a rule
    return out.withColumn("severity", F.coalesce("__severity", "severity")).drop("__rule", "__on", "__severity").transform(patterns.without, bundle.allow)


def ordered(findings: DataFrame) -> DataFrame:
    """By path without case, line, column and rule."""
    return findings.orderBy(F.upper("path"), "line", "column", "rule_id")


def portability_scan(files: DataFrame, bundle: cfg.Bundle, suppressions=()) -> DataFrame:
    return apply_policy(portability.analyse(files, list(suppressions), bundle.custom), bundle)


def magic_scan(files: DataFrame, bundle: cfg.Bundle, settings: dict | None = None) -> DataFrame:
    s = settings or {}
    n = s.get("numbers", {})
    found = magic.occurrences(files.where("category = 'Source'"), s.get("sinks"), s.get("allow", ()), s.get("deny", ()), n.get("entropyThreshold", magic.MAX_ENTROPY))
    best = magic.limited(magic.candidates(found, int(n.get("minOccurrences", magic.MIN_USES))), int(n.get("maxFindingsPerDirectory", magic.PER_DIRECTORY)), int(n.get("maxFindingsTotal", magic.TOTAL)))
    return apply_policy(magic.findings(best, found), bundle)


def churn_scan(files: DataFrame, commits: DataFrame, now, bundle: cfg.Bundle, since_days: int = history.SINCE_DAYS, services=()) -> tuple[DataFrame, DataFrame]:
    """``(findings, metrics)``; only orphaned knowledge is reported by a scan, with the modules of its file."""
    metrics = history.file_metrics(files.select("path", "category"), history.tracked(commits, files.select("path")), now, since_days)
    modules = history.service_keys(history.project_keys(files.select("path").distinct()), list(services))
    risk = metrics.where("ownership_risk").join(modules, "path").select(
        "path", F.lit("churn.ownership.orphaned_knowledge_risk").alias("rule_id"), F.lit(1).alias("line"), F.lit(1).alias("column"),
        F.concat(F.lit("Ownership concentration is "), F.round("concentration", 2).cast("string"), F.lit(" and '"), "top_author", F.lit("' has been idle.")).alias("message"), F.lit(None).cast("string").alias("snippet"),
        F.lit("Warning").alias("severity"), F.lit("Medium").alias("confidence"), F.concat_ws(":", F.lit("churn.ownership.orphaned_knowledge_risk"), "path", "top_author").alias("fingerprint"),
        portability._json(
            metric="orphaned_knowledge_risk", TopAuthor=F.col("top_author"), topAuthorPct=F.col("top_author_pct"), ownershipConcentration=F.col("concentration"), NeverChangedSinceImport=F.col("never_changed"),
            moduleDirectory=history.top_folder(F.col("path")), moduleProject=F.col("module_project"), moduleService=F.col("module_service"),
        ).alias("metadata"),
    )
    return apply_policy(risk, bundle), metrics


def deploy_scan(files: DataFrame, bundle: cfg.Bundle) -> DataFrame:
    own = files.where(F.col("category").isin("DeploymentArtifact", "Config", "Source", "Unknown"))
    return apply_policy(artifacts.analyse(own.select("path", "text")), bundle)


def drift_scan(files: DataFrame, bundle: cfg.Bundle, pattern: str | None = None) -> DataFrame:
    return apply_policy(drift.findings(drift.settings(files.select("path", "text"), pattern)), bundle)


def dependency_scan(files: DataFrame, advisories: DataFrame, latest: DataFrame, bundle: cfg.Bundle) -> DataFrame:
    return apply_policy(dependencies.analyse(files.select("path", "text"), advisories, latest), bundle)


def hygiene_scan(files: DataFrame, now, bundle: cfg.Bundle, blame: DataFrame | None = None) -> DataFrame:
    return apply_policy(hygiene.analyse(files.where("category = 'Source' or category = 'Config'"), now, blame), bundle)


def union(*parts: DataFrame) -> DataFrame:
    """Findings of several scans as one table."""
    return reduce(DataFrame.unionByName, [p.select(*portability.FINDING) for p in parts])


@dataclass
class Context:
    """What a scan is given: files and all that may be known about them."""

    files: DataFrame
    now: object
    bundle: cfg.Bundle
    commits: DataFrame | None = None
    blame: Callable[[DataFrame], DataFrame] | DataFrame | None = None  # a table, or what makes one for files(path)
    advisories: DataFrame | None = None
    latest: DataFrame | None = None
    suppressions: list = field(default_factory=list)
    literals: dict = field(default_factory=dict)
    services: list = field(default_factory=list)
    since_days: int = history.SINCE_DAYS
    env_pattern: str | None = None


#: What finds things in a context, by name; anyone may add to it with ``detector``.
DETECTORS: dict[str, Callable[[Context], DataFrame]] = {}


def detector(name: str):
    """Registers a function from a context to findings, which every later scan of everything runs too."""

    def keep(f):
        DETECTORS[name] = f
        return f

    return keep


@detector("portability")
def _portability(c: Context) -> DataFrame:
    return portability_scan(c.files, c.bundle, c.suppressions)


@detector("magic-strings")
def _magic(c: Context) -> DataFrame:
    return magic_scan(c.files, c.bundle, c.literals)


@detector("deploy")
def _deploy(c: Context) -> DataFrame:
    return deploy_scan(c.files, c.bundle)


@detector("config-drift")
def _drift(c: Context) -> DataFrame:
    return drift_scan(c.files, c.bundle, c.env_pattern)


@detector("hygiene")
def _hygiene(c: Context) -> DataFrame:
    blame = c.blame
    if callable(blame):  # only files with something that has an age are asked for
        own = c.files.where("category = 'Source' or category = 'Config'")
        blame = blame(hygiene.flag_occurrences(own).select("path").union(hygiene.debt_occurrences(own).select("path")).distinct())
    return hygiene_scan(c.files, c.now, c.bundle, blame)


@detector("deps")
def _deps(c: Context) -> DataFrame:
    spark = c.files.sparkSession
    a = c.advisories if c.advisories is not None else spark.createDataFrame([], "ecosystem string, name string, version string, advisory_id string, score string, summary string")
    n = c.latest if c.latest is not None else spark.createDataFrame([], "ecosystem string, name string, latest string")
    return dependency_scan(c.files, a, n, c.bundle)


def run(context: Context, names=None) -> tuple[DataFrame, DataFrame | None]:
    """``(findings, metrics)`` of some scans, or of all; ``churn`` needs commits and is the one with metrics."""
    wanted = [*DETECTORS, "churn"] if names is None else list(names)
    unknown = [n for n in wanted if n not in DETECTORS and n != "churn"]
    if unknown:
        raise ValueError(f"no such scan: {', '.join(unknown)}")
    parts, metrics = [DETECTORS[n](context) for n in wanted if n != "churn"], None
    if "churn" in wanted and context.commits is not None:
        risk, metrics = churn_scan(context.files, context.commits, context.now, context.bundle, context.since_days, context.services)
        parts.append(risk)
    none = portability.text_findings(context.files.where(F.lit(False)))
    return union(*parts) if parts else none.select(*portability.FINDING), metrics


def scan_all(spark: SparkSession, files: DataFrame, now, bundle: cfg.Bundle, commits: DataFrame | None = None, blame=None, advisories: DataFrame | None = None, latest: DataFrame | None = None, suppressions=(), settings: dict | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``(findings, metrics)`` of all scans; those that lack their tables find nothing."""
    return run(Context(files, now, bundle, commits, blame, advisories, latest, list(suppressions), settings or {}))


def context(spark: SparkSession, root: str, now, overrides: dict | None = None, since: str | None = None, advisories: DataFrame | None = None, latest: DataFrame | None = None, env_pattern: str | None = None) -> Context:
    """Everything that a repository tells about itself: its files, rules, suppressions, literal settings, services, commits and blame."""
    top = cfg.find_root(root)
    bundle = cfg.load(top, overrides)
    files = fl.discover(spark, root, ignore=cfg.ignore_patterns(top))
    known = git.has_history(root)
    side = cfg.side_files(top, bundle)
    return Context(
        files, now, bundle, git.commits(spark, root).persist(StorageLevel.DISK_ONLY) if known else None, (lambda paths: git.blame(paths, root)) if known else None, advisories, latest,
        side["suppressions"], side["literals"], side["services"], cfg.look_back(bundle, since), env_pattern,
    )


def scan_repository(spark: SparkSession, root: str, store: str, run_id: str, now, overrides: dict | None = None, names=None, append: bool = False, fail_on: str = "Error", **more) -> int:
    """Scan the files below ``root`` into ``store`` as a run, by all scans or some; returns the exit code: 2 for a faulty configuration, 1 for findings of ``fail_on`` or worse, else 0."""
    import datetime

    c = context(spark, root, now, overrides, **more)
    if c.bundle.errors:
        return 2
    found, metrics = run(c, names)
    at = now if isinstance(now, datetime.datetime) else None
    top = cfg.find_root(root)
    told = {"run_id": run_id, "repo_root": top, "commit_sha": cfg.head_sha(top), "started_at": at, "ended_at": at, "tool_version": VERSION, "config_hash": c.bundle.digest()}
    st.write_run(spark, store, told, c.files, ordered(found), catalog.builtin(spark), metrics, clear=not append)
    if c.commits is not None:
        c.commits.unpersist()  # read once from git, used by several metrics
    from .reports import exit_code

    return exit_code(st.read(spark, store).findings.where(F.col("run_id") == run_id), fail_on)
