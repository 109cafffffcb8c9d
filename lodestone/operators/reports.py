"""The store's catalogue of queries: summaries, pages, details, comparison, heatmap and tree.

Every function takes tables of the store and returns a table; nothing is collected. A page is a table;
its total and filtered counts are ``page_counts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import keep
from . import catalog
from .findings import severity_pivot, severity_rank

METRICS = ("churn_score", "stale_score", "ownership_risk", "portability", "density")


def clamp(value: int, low: int, high: int) -> int:
    return min(max(value, low), high)


# --- metadata -------------------------------------------------------------------------------------


def field(name: str, metadata: str = "metadata") -> F.Column:
    """A field of the metadata; null where it or the JSON is missing."""
    return F.get_json_object(metadata, f"$.{name}")


def is_true(name: str) -> F.Column:
    return F.coalesce(F.lower(field(name)) == "true", F.lit(False))


def suppressed() -> F.Column:
    """Whether the metadata say so, under either name."""
    return is_true("suppressed") | is_true("isSuppressed")


def suppression_reason() -> F.Column:
    return F.coalesce(field("suppressionReason"), field("reason"))


def suppression_source(missing: str | None = "config") -> F.Column:
    """``inline``, ``allowlist`` or ``config``: as named, else as the metadata mention it, else ``missing``."""
    named = F.trim(F.lower(field("suppressionSource")))
    text = F.lower(F.coalesce("metadata", F.lit("")))
    guessed = F.when(F.contains(text, F.lit("allowlist")), "allowlist").when(F.contains(text, F.lit("inline")), "inline").otherwise(F.lit(missing))
    return F.when(named.isin("inline", "allowlist", "config"), named).when(named.isNotNull(), "config").otherwise(guessed)


def artifact_path() -> F.Column:
    return F.coalesce(field("artifactPath"), F.lit("$"))


def artifact_type() -> F.Column:
    """EV2 or ADO by rule, then by path, else Unknown."""
    r, p = F.col("rule_id"), F.lower("file_path")
    ev2 = p.like("%/ev2/%") | p.like("%rollout%") | p.like("%service-model%")
    ado = p.like("%pipeline%") | p.like("%/.azuredevops/%") | p.like("%/ado/%")
    return F.when(r.ilike("deploy.ev2.%"), "EV2").when(r.ilike("deploy.ado.%"), "ADO").when(ev2, "EV2").when(ado, "ADO").otherwise("Unknown")


def deploy_group() -> F.Column:
    r = F.col("rule_id")
    return F.when(r.rlike(r"(?i)^deploy\..*\.inline.secret$"), "inline-secrets").when(r.rlike(r"(?i)^deploy\..*\.(hardcoded\..*|env.constant)$"), "hardcoded-values").otherwise("missing-safety")


def confidence_rank() -> F.Column:
    return F.when(F.col("confidence") == "High", 0).when(F.col("confidence") == "Medium", 1).otherwise(2)


def rank() -> F.Column:
    """Error 0, Warning 1, all others 2."""
    return F.least(severity_rank(), F.lit(2))


def deploy(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("rule_id").ilike("deploy.%"))


def shown(findings: DataFrame, include_suppressed: bool) -> DataFrame:
    return findings if include_suppressed else findings.where(~suppressed())


# --- runs -----------------------------------------------------------------------------------------


def run_list(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Every run, also one without findings, with its counts by severity; the latest first."""
    counts = findings.groupBy("run_id").agg(*severity_pivot())
    names = ("total", "error_count", "warning_count", "info_count")
    out = runs.join(counts, "run_id", "left").select(*runs.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return out.orderBy(F.desc("started_at"), "run_id")


def run_by_id(runs: DataFrame, findings: DataFrame, run_id: str) -> DataFrame:
    """One run, or no row."""
    return run_list(runs.where(F.col("run_id") == run_id), findings.where(F.col("run_id") == run_id))


# --- findings -------------------------------------------------------------------------------------


def with_files(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with their file's category and language; a finding without a file goes."""
    return findings.join(files.select("run_id", "file_id", "category", "language"), ["run_id", "file_id"])


def with_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with title and description; a rule that is not listed is its own title."""
    r = rules.select("rule_id", F.col("title").alias("rule_title"), F.col("description").alias("rule_description"))
    out = findings.join(r, "rule_id", "left")
    return out.withColumn("rule_title", F.coalesce("rule_title", "rule_id")).withColumn("rule_description", F.coalesce("rule_description", F.lit("")))


def filtered(findings: DataFrame, severity="", rule="", rule_prefix="", confidence="", category="", language="", path_prefix="", include_suppressed=True) -> DataFrame:
    """Conjunction of the filters that are not blank, over findings ``with_files``; prefixes are patterns in which ``%`` and ``_`` are wild."""
    for name, value in (("severity", severity), ("rule_id", rule), ("confidence", confidence), ("category", category), ("language", language)):
        if value.strip():
            findings = findings.where(F.col(name) == value.strip())
    for name, value in (("rule_id", rule_prefix), ("file_path", path_prefix)):
        if value.strip():
            findings = findings.where(F.col(name).ilike(value.strip().replace("\\", "\\\\") + "%"))
    return shown(findings, include_suppressed)


def page_key(sort: str) -> F.Column:
    """What a page of findings is ordered by, before the id."""
    return {"severity": rank(), "rule": F.col("rule_id"), "path": F.col("file_path"), "line": F.col("line"), "confidence": confidence_rank()}[sort]


def findings_page(findings: DataFrame, files: DataFrame, rules: DataFrame, run_id: str, offset=0, limit=25, sort="severity", descending=False, **filters) -> DataFrame:
    """A page of a run's findings, at most 500; ties by id."""
    key = page_key(sort).desc() if descending else page_key(sort).asc()
    rows = filtered(with_files(findings.where(F.col("run_id") == run_id), files), **filters)
    page = rows.orderBy(key, "finding_id").offset(max(0, offset)).limit(clamp(limit, 1, 500))
    return flagged(with_rules(page, rules))


def findings_after(findings: DataFrame, files: DataFrame, rules: DataFrame, run_id: str, cursor: tuple | None = None, limit=25, sort="severity", descending=False, **filters) -> DataFrame:
    """The page that follows ``cursor``, the ``(page_key, finding_id)`` of the last row seen (None: the first page).

    However far the page is, a task keeps no more rows than one page has. Null keys come first, or last where the order descends.
    """
    key, rows = page_key(sort), filtered(with_files(findings.where(F.col("run_id") == run_id), files), **filters)
    if cursor is not None:
        at, seen = cursor
        same = key.eqNullSafe(F.lit(at)) & (F.col("finding_id") > seen)
        if at is None:
            beyond = F.lit(False) if descending else key.isNotNull()
        else:
            beyond = (key < at) | key.isNull() if descending else key > at
        rows = rows.where(beyond | same)
    page = rows.withColumn("page_key", key).orderBy(F.desc("page_key") if descending else F.asc("page_key"), "finding_id").limit(clamp(limit, 1, 500))
    return flagged(with_rules(page, rules))


def flagged(findings: DataFrame) -> DataFrame:
    """With what the metadata say: confirmed by syntax, suppressed, why and by what."""
    return findings.withColumn("ast_confirmed", is_true("astConfirmed")).withColumn("is_suppressed", suppressed()).withColumn("suppression_reason", suppression_reason())


def page_counts(findings: DataFrame, files: DataFrame, run_id: str, **filters) -> DataFrame:
    """``(total, filtered)`` of a page: all findings of the run, and those that pass the filters, in one pass over each."""
    run = findings.where(F.col("run_id") == run_id)
    total = run.agg(F.count("*").alias("total"))
    kept = filtered(with_files(run, files), **filters).agg(F.count("*").alias("filtered"))
    return total.join(F.broadcast(kept))  # one row each


def findings_by_prefix(findings: DataFrame, files: DataFrame, rules: DataFrame, run_id: str, prefix: str, include_suppressed=False) -> DataFrame:
    rows = filtered(with_files(findings.where(F.col("run_id") == run_id), files), rule_prefix=prefix, include_suppressed=include_suppressed)
    return flagged(with_rules(rows, rules)).orderBy("rule_id", "finding_id")


def findings_of_file(findings: DataFrame, rules: DataFrame, run_id: str, file_id: int, include_suppressed=True) -> DataFrame:
    rows = shown(findings.where((F.col("run_id") == run_id) & (F.col("file_id") == file_id)), include_suppressed)
    return flagged(with_rules(rows, rules)).orderBy("line", "column", "finding_id")


def file_by_id(files: DataFrame, run_id: str, file_id: int) -> DataFrame:
    return files.where((F.col("run_id") == run_id) & (F.col("file_id") == file_id)).limit(1)


def findings_for_export(findings: DataFrame, files: DataFrame, rules: DataFrame, run_id: str, **filters) -> DataFrame:
    """All findings of a run that pass the filters, with category, language, title and suppression."""
    rows = filtered(with_files(findings.where(F.col("run_id") == run_id), files), **filters)
    out = flagged(with_rules(rows, rules)).withColumn("suppression_source", F.when(suppressed(), suppression_source(None)))
    return out.orderBy("rule_id", "file_path", "line", "finding_id")


# --- deployment artifacts -------------------------------------------------------------------------


def deploy_rows(findings: DataFrame, files: DataFrame, run_id: str, include_suppressed=False) -> DataFrame:
    rows = shown(deploy(with_files(findings.where(F.col("run_id") == run_id), files)), include_suppressed)
    return rows.withColumn("artifact_type", artifact_type()).withColumn("subcategory", deploy_group()).withColumn("location", artifact_path())


def deploy_page(findings: DataFrame, files: DataFrame, rules: DataFrame, run_id: str, offset=0, limit=25, sort="severity", descending=False, kind="", subcategory="", severity="", include_suppressed=False) -> DataFrame:
    """A page of deployment findings."""
    rows = deploy_rows(findings, files, run_id, include_suppressed)
    for name, value in (("artifact_type", kind), ("subcategory", subcategory), ("severity", severity)):
        if value.strip():
            rows = rows.where(F.col(name) == value.strip())
    keys = {"artifact": F.col("artifact_type"), "severity": rank(), "rule": F.col("rule_id"), "path": F.col("file_path"), "location": F.col("location")}
    key = keys[sort].desc() if descending else keys[sort].asc()
    return flagged(with_rules(rows.orderBy(key, "finding_id").offset(max(0, offset)).limit(clamp(limit, 1, 500)), rules))


def deploy_severity(findings: DataFrame, files: DataFrame, run_id: str, include_suppressed=False) -> DataFrame:
    return deploy_rows(findings, files, run_id, include_suppressed).groupBy("artifact_type").agg(*severity_pivot()[1:]).orderBy("artifact_type")


def deploy_risk(findings: DataFrame, files: DataFrame, run_id: str, limit=5, include_suppressed=False) -> DataFrame:
    """Artifacts by risk: 5 for an error, 2 for a warning, 1 otherwise."""
    risk = F.sum(F.when(F.col("severity") == "Error", 5).when(F.col("severity") == "Warning", 2).otherwise(1)).alias("risk")
    g = deploy_rows(findings, files, run_id, include_suppressed).groupBy("file_id", "file_path", "artifact_type").agg(*severity_pivot()[1:], risk)
    return g.orderBy(F.desc("risk"), "file_path", "file_id", "artifact_type").limit(clamp(limit, 1, 100))


def hardcoded_count(findings: DataFrame, files: DataFrame, run_id: str, include_suppressed=False) -> DataFrame:
    return deploy_rows(findings, files, run_id, include_suppressed).agg(F.count_if(F.col("subcategory") == "hardcoded-values").alias("n"))


# --- summaries ------------------------------------------------------------------------------------


def file_summary(findings: DataFrame, files: DataFrame, run_id: str, include_suppressed=False) -> DataFrame:
    """Counts of each file, aggregated by id before names are joined."""
    rows = shown(findings.where(F.col("run_id") == run_id), include_suppressed).groupBy("run_id", "file_id", "file_path").agg(*severity_pivot())
    return with_files(rows, files).drop("run_id")


def rule_summary(findings: DataFrame, rules: DataFrame, run_id: str, include_suppressed=False) -> DataFrame:
    """Counts of each rule, aggregated before titles are joined."""
    return with_rules(shown(findings.where(F.col("run_id") == run_id), include_suppressed).groupBy("rule_id").agg(*severity_pivot()), rules)


def top_files(findings: DataFrame, files: DataFrame, run_id: str, limit=10) -> DataFrame:
    """Files with the most findings of high confidence."""
    rows = findings.where(F.col("confidence") == "High")
    return file_summary(rows, files, run_id).orderBy(F.desc("total"), "file_path", "file_id").limit(clamp(limit, 1, 200))


def confidence_summary(findings: DataFrame, run_id: str, include_suppressed=False) -> DataFrame:
    g = shown(findings.where(F.col("run_id") == run_id), include_suppressed).groupBy("confidence").agg(F.count("*").alias("n"))
    return g.orderBy(confidence_rank(), "confidence")


def language_summary(findings: DataFrame, files: DataFrame, run_id: str, include_suppressed=False) -> DataFrame:
    rows = shown(findings.where(F.col("run_id") == run_id), include_suppressed).groupBy("run_id", "file_id").agg(F.count("*").alias("n"))
    name = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("unknown")).alias("language")
    return with_files(rows, files).groupBy(name).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "language")


def flag_summary(findings: DataFrame, run_id: str, include_suppressed=False) -> DataFrame:
    """Findings confirmed by syntax and found by patterns only."""
    rows = shown(findings.where(F.col("run_id") == run_id), include_suppressed)
    return rows.agg(F.count_if(is_true("astConfirmed")).alias("ast_confirmed"), F.count_if(~is_true("astConfirmed")).alias("regex_only"))


# fixed values
TECH_DEBT = ("hygiene.todo_old", "hygiene.fixme", "hygiene.hack")
SECTIONS = ("all", "rule", "file", "confident_file", "confidence", "language")


def summary_page(findings: DataFrame, files: DataFrame, rules: DataFrame, run_id: str, top: int = 10) -> DataFrame:
    """All that the summary of a run shows, from one scan of its findings and one of its files.

    A row for each rule, each confidence, each language, the ``top`` files by findings and by findings of
    high confidence, and one for the whole run: ``(section, place, name, title)`` with counts. Findings are
    counted by rule, file, confidence and severity first; the sections are grouping sets over these counts.
    Suppressed findings do not count; files and languages are those of files that the run has.
    """
    rows = shown(findings.where(F.col("run_id") == run_id), False)
    few = rows.groupBy("rule_id", "file_id", "file_path", "confidence", "severity").agg(F.count("*").alias("n"), F.count_if(is_true("astConfirmed")).alias("ast"))
    own = files.where(F.col("run_id") == run_id).select("file_id", F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("unknown")).alias("language"))
    told = few.join(own, "file_id", "left").withColumn("known", F.col("language").isNotNull())
    keys = ["rule_id", "file_id", "file_path", "confidence", "language", "known"]
    part = lambda when, c="n": F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias
    level, rule = F.col("severity"), F.col("rule_id")
    counts = [F.sum("n").alias("total"), *[part(level == x)(f"{x.lower()}_count") for x in ("Error", "Warning", "Info")], part(F.col("confidence") == "High")("high_count"), F.sum("ast").alias("ast_confirmed")]
    counts += [part(rule.isin(*TECH_DEBT))("tech_debt"), part(rule.startswith("async.") | rule.startswith("thread."))("async_issues")]
    copied = told.withColumns({f"__{k}": F.col(k) for k in keys})  # sums look at these where the sets leave the others out
    sets = [["__rule_id"], ["__file_id", "__file_path", "__known"], ["__confidence"], ["__language", "__known"], []]
    g = copied.groupingSets([[F.col(k) for k in one] for one in sets], *[F.col(f"__{k}") for k in keys]).agg(F.grouping_id().alias("left_out"), *counts)
    mask = lambda *names: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in names)
    section = (
        F.when(F.col("left_out") == mask("rule_id"), "rule").when(F.col("left_out") == mask("file_id", "file_path", "known"), "file").when(F.col("left_out") == mask("confidence"), "confidence")
        .when(F.col("left_out") == mask("language", "known"), "language").otherwise("all")
    )
    named = g.withColumn("section", section).where(~F.col("section").isin("file", "language") | F.col("__known"))
    both = F.when(F.col("section") != "file", F.array("section")).when(F.col("high_count") > 0, F.array(F.lit("file"), F.lit("confident_file"))).otherwise(F.array(F.lit("file")))
    named = named.withColumn("section", F.explode(both)).withColumn("name", F.coalesce("__rule_id", "__file_path", "__confidence", "__language", F.lit("")))
    weight = F.when(F.col("section") == "confident_file", F.col("high_count")).when(F.col("section") == "confidence", -F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ("High", "Medium", "Low")]), F.col("name")), F.lit(4))).otherwise(F.col("total"))
    w = Window.partitionBy("section").orderBy(F.desc("weight"), "name", "__file_id")
    placed = named.withColumn("weight", weight).withColumn("place", F.row_number().over(w)).where((F.col("place") <= top) | ~F.col("section").isin("file", "confident_file"))
    titled = placed.join(rules.select(F.col("rule_id").alias("__rule_id"), "title"), "__rule_id", "left")
    return titled.select("section", "place", "name", F.coalesce("title", "name").alias("title"), "total", "error_count", "warning_count", "info_count", "high_count", "ast_confirmed", (F.col("total") - F.col("ast_confirmed")).alias("regex_only"), "tech_debt", "async_issues")


def rule_catalog(findings: DataFrame, rules: DataFrame, category: str = "") -> DataFrame:
    """Rules with category, total over all runs and effective state; findings are counted by rule and severity first."""
    few = findings.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))
    known = few.join(rules.select("rule_id", "default_severity"), "rule_id", "left")
    other = F.when(F.col("severity") != F.coalesce("default_severity", "severity"), F.col("n")).otherwise(0)
    totals = known.groupBy("rule_id").agg(F.sum("n").alias("total"), F.sum(other).alias("overridden"))
    out = rules.join(totals, "rule_id", "left").withColumn("category", catalog.category())
    state = F.when(F.coalesce("total", F.lit(0)) == 0, "No Findings").when(F.col("overridden") > 0, "Overridden").otherwise("Enabled")
    out = out.select("rule_id", "title", "default_severity", "description", "category", state.alias("state"), F.coalesce("total", F.lit(0)).alias("total"))
    return (out.where(F.col("category") == category.strip().lower()) if category.strip() else out).orderBy("category", "rule_id")


def rule_history(findings: DataFrame, runs: DataFrame, rule_id: str, limit=500) -> DataFrame:
    """A rule's findings in all runs, the latest run first."""
    rows = findings.where(F.col("rule_id") == rule_id).join(runs.select("run_id", "repo_root", "started_at"), "run_id")
    top = rows.orderBy(F.desc("started_at"), F.desc("finding_id")).limit(clamp(limit, 1, 2000))
    return top.select("run_id", "repo_root", "started_at", "file_path", "line", "column", "severity", "message", "confidence", "fingerprint")


# --- suppressions ---------------------------------------------------------------------------------


def suppression_totals(findings: DataFrame, run_id: str) -> DataFrame:
    rows = findings.where(F.col("run_id") == run_id)
    return rows.agg(F.count_if(~suppressed()).alias("active"), F.count_if(suppressed()).alias("suppressed"), F.count("*").alias("what_if"))


def suppression_by_rule(findings: DataFrame, rules: DataFrame, run_id: str) -> DataFrame:
    g = findings.where((F.col("run_id") == run_id) & suppressed()).groupBy("rule_id").agg(F.count("*").alias("n"))
    return with_rules(g, rules).select("rule_id", "rule_title", "n").orderBy(F.desc("n"), "rule_id")


def suppression_details(findings: DataFrame, rules: DataFrame, run_id: str) -> DataFrame:
    rows = with_rules(findings.where((F.col("run_id") == run_id) & suppressed()), rules)
    out = rows.select("finding_id", "file_id", "file_path", "rule_id", "rule_title", "severity", "confidence", "message", suppression_reason().alias("reason"), suppression_source().alias("source"), "line")
    return out.orderBy("rule_id", "file_path", "line", "finding_id")


# --- comparison of runs ---------------------------------------------------------------------------


def comparison_details(findings: DataFrame, run_id: str, other: str, limit=200) -> DataFrame:
    """The first row of each fingerprint that the other run lacks, by rule, path and line."""
    mine = findings.where((F.col("run_id") == run_id) & (F.coalesce("fingerprint", F.lit("")) != ""))
    theirs = findings.where(F.col("run_id") == other).select("fingerprint").distinct()
    row = F.struct("finding_id", "rule_id", "file_path", "line", "severity", "message", "confidence")
    first = mine.join(theirs, "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min(row).alias("r"))
    return first.select("fingerprint", *[f"r.{c}" for c in ("rule_id", "file_path", "line", "severity", "message", "confidence")]).orderBy("rule_id", "file_path", "line", "fingerprint").limit(clamp(limit, 1, 2000))


# --- history --------------------------------------------------------------------------------------


def orphaned() -> F.Column:
    return (F.col("concentration") > 0.8) & (F.col("commits_90d") == 0)


def metrics_page(metrics: DataFrame, run_id: str, offset=0, limit=25, sort="churn", descending=True, min_churn=None, max_stale=None, path_prefix="") -> DataFrame:
    """A page of history metrics; ties by path."""
    rows = metrics.where(F.col("run_id") == run_id)
    if min_churn is not None:
        rows = rows.where(F.col("churn_score") >= min_churn)
    if max_stale is not None:
        rows = rows.where(F.coalesce("stale_score", F.lit(0.0)) <= max_stale)
    if path_prefix.strip():
        rows = rows.where(F.col("file_path").ilike(path_prefix.strip() + "%"))
    keys = {
        "path": F.col("file_path"), "churn": F.col("churn_score"), "stale": F.coalesce("stale_score", F.lit(0.0)), "commits": F.col("commits_90d"), "authors": F.col("authors"),
        "ownership": F.col("concentration"), "last": F.coalesce("last_commit_at", F.lit("1900-01-01").cast("timestamp")),
    }
    key = keys[sort].desc() if descending else keys[sort].asc()
    cols = ("file_id", "file_path", "churn_score", "stale_score", "commits_90d", "authors", "concentration", "top_author", "top_author_pct", "last_commit_at")
    return rows.orderBy(key, "file_path").offset(max(0, offset)).limit(clamp(limit, 1, 500)).select(*cols, orphaned().alias("is_orphaned"))


def ownership_list(metrics: DataFrame, run_id: str, least: float = 0.7) -> DataFrame:
    """Of the 200 most concentrated files those at ``least`` or more, 50 at most."""
    page = metrics_page(metrics, run_id, limit=200, sort="ownership")
    return page.where(F.col("concentration") >= least).orderBy(F.desc("concentration"), "file_path").limit(50)


# --- heatmap and tree -----------------------------------------------------------------------------


def heatmap(files: DataFrame, metrics: DataFrame, findings: DataFrame, run_id: str) -> DataFrame:
    """A row for every file of a run, also one without findings or history."""
    own = lambda t: t.where(F.col("run_id") == run_id)
    counts = own(findings).groupBy("file_id").agg(F.count_if(F.col("rule_id").ilike("portability.%")).alias("portability"), F.count("*").alias("density"))
    m = own(metrics).select("file_id", "churn_score", "stale_score", F.col("concentration").alias("ownership_risk"))
    rows = own(files).select("file_id", F.col("path").alias("file_path"), "size_bytes").join(m, "file_id", "left").join(counts, "file_id", "left")
    return rows.select("file_id", "file_path", "size_bytes", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in METRICS])


def _ancestors(heat: DataFrame) -> DataFrame:
    """A row for each file and folder above it: ``level`` 0 is the root, written ``.``; folders are compared without case."""
    parts = F.split(F.regexp_replace("file_path", r"\\", "/"), "/")
    up = heat.withColumn("__parts", parts).withColumn("level", F.explode(F.sequence(F.lit(0), F.size("__parts") - 1)))
    folder = F.when(F.col("level") == 0, ".").otherwise(F.array_join(F.slice("__parts", F.lit(1), F.col("level")), "/"))
    return up.withColumn("directory", folder).withColumn("key", F.upper(folder)).withColumn("depth", F.size("__parts") - 1).drop("__parts")


def directories(heat: DataFrame, metric: str = "churn_score") -> DataFrame:
    """Folders with files, size and the weighted means of the metrics, from the leaves up.

    A file weighs its size, one at least, and a folder the sizes below it or its number of files if
    that is more. The mean of a folder is a sum over the files below of metric times the product of the
    shares on the way up, so three aggregations do for any depth. ``place`` is the order of a walk from
    the root, a folder before those in it.
    """
    up = _ancestors(keep(heat))
    whole = up.groupBy("key", "level").agg(F.min("directory").alias("directory"), F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))
    weigh = whole.withColumn("weight", F.greatest("size_bytes", "files").cast("double"))
    parent = F.when(F.col("level") <= 1, ".").otherwise(F.regexp_replace("key", "/[^/]*$", ""))
    inner = weigh.where("level > 0").select(parent.alias("key"), "weight")
    own = up.where("level = depth").select("key", F.greatest("size_bytes", F.lit(1)).cast("double").alias("weight"))
    below = inner.unionByName(own).groupBy("key").agg(F.sum("weight").alias("below"))
    share = weigh.join(below, "key").select("key", (F.col("weight") / F.col("below")).alias("share"), "below")
    # the share of each folder in the one above, multiplied from the file's folder upwards
    w = Window.partitionBy("file_id").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    path = up.join(share, "key").withColumn("steps", F.coalesce(F.sum(F.ln("share")).over(w), F.lit(0.0)))
    part = F.exp(F.col("steps")) * F.greatest("size_bytes", F.lit(1)) / F.col("below")
    means = path.withColumn("part", part).groupBy("key").agg(*[F.round(F.sum(F.col(m) * F.col("part")), 6).alias(m) for m in METRICS])
    out = whole.join(means, "key").select(F.col("level").alias("depth"), "directory", "files", "size_bytes", *METRICS, F.col(metric).alias("metric"), "key")
    return out


def directory_aggregates(heat: DataFrame, metric: str = "churn_score") -> DataFrame:
    """``directories`` in the order of a walk from the root: a folder, then those in it, the larger first, then by name.

    A folder's place among its siblings, put behind those of the folders above it, is its place in the walk.
    """
    d = directories(heat, metric)
    parent = F.when(F.col("depth") <= 1, ".").otherwise(F.regexp_replace("key", "/[^/]*$", ""))
    w = Window.partitionBy("__parent").orderBy(F.desc("size_bytes"), "key")
    placed = d.where("depth > 0").withColumn("__parent", parent).select("key", "depth", F.row_number().over(w).alias("place"))
    parts = F.split("key", "/")
    up = placed.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("above"))
    walk = up.join(placed.select(F.col("key").alias("above"), "depth", "place"), "above").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("depth", "place"))).alias("walk"))  # one entry a level
    return d.join(walk, "key", "left").orderBy(F.asc_nulls_first("walk")).drop("walk", "key")


def treemap(heat: DataFrame, metric: str = "churn_score") -> DataFrame:
    """Nodes of the tree, folders and files: ``(path, parent, name, is_directory, depth, place, ...)``; among siblings folders come first, then the larger, then by name."""
    d = directories(heat, metric).select(F.col("directory").alias("path"), "key", F.lit(True).alias("is_directory"), "depth", "files", "size_bytes", "metric")
    parts = F.split("file_path", "/")
    f = heat.select(F.col("file_path").alias("path"), F.upper("file_path").alias("key"), F.lit(False).alias("is_directory"), F.size(parts).alias("depth"), F.lit(1).cast("long").alias("files"), "size_bytes", F.col(metric).alias("metric"))
    both = d.unionByName(f)
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == 1, ".").otherwise(F.regexp_replace("key", "/[^/]*$", ""))
    named = both.withColumn("parent", parent).withColumn("name", F.element_at(F.split("path", "/"), -1))
    w = Window.partitionBy("parent").orderBy(F.desc("is_directory"), F.desc("size_bytes"), F.upper("name"), "path")
    return named.withColumn("place", F.row_number().over(w)).drop("key")


def nested(nodes: DataFrame) -> dict:
    """The tree as nested dictionaries, for a page that draws it; nodes come to the driver as they go to the page."""
    rows = [r.asDict() for r in nodes.orderBy("depth", "place").collect()]
    by = {r["path"].upper(): r | {"children": []} for r in rows if r["is_directory"]}
    for r in rows:
        if r["parent"] is not None:
            by[r["parent"]]["children"].append(by[r["path"].upper()] if r["is_directory"] else r | {"children": []})
    return by.get(".", {})


def most(heat: DataFrame, metric: str = "churn_score") -> DataFrame:
    """The largest value of a metric over files and folders."""
    return treemap(heat, metric).agg(F.coalesce(F.max("metric"), F.lit(0.0)).alias("most"))


def below(path: str, directory: str) -> F.Column:
    """Whether ``path`` lies in a folder, in any case; ``.`` holds all."""
    d = directory.replace("\\", "/").strip("/").strip()
    return F.lit(True) if d in ("", ".") else F.upper(path).startswith(f"{d}/".upper())


def drilldown(heat: DataFrame, directory: str, metric: str = "churn_score") -> DataFrame:
    """``(directory, files, size_bytes, metric)``, the mean not weighted; no row for an empty folder."""
    g = heat.where(below("file_path", directory)).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"), F.round(F.avg(metric), 6).alias("metric"))
    return g.where("files > 0").select(F.lit(directory).alias("directory"), "files", "size_bytes", "metric")


def drilldown_files(findings: DataFrame, files: DataFrame, run_id: str, directory: str, limit=10) -> DataFrame:
    return file_summary(findings.where(below("file_path", directory)), files, run_id, True).orderBy(F.desc("total"), "file_path", "file_id").limit(limit)


def drilldown_rules(findings: DataFrame, rules: DataFrame, run_id: str, directory: str, limit=10) -> DataFrame:
    return rule_summary(findings.where(below("file_path", directory)), rules, run_id, True).orderBy(F.desc("total"), "rule_id").limit(limit)


# --- gates and console summaries ------------------------------------------------------------------


def worst(findings: DataFrame) -> DataFrame:
    """``(rank)`` of the worst finding, null if there is none."""
    return findings.agg(F.min(severity_rank()).alias("rank"))


def exit_code(findings: DataFrame, fail_on: str = "Error", errors: int = 0) -> int:
    """2 after errors of the scan, 1 if a finding is as bad as ``fail_on`` or worse, else 0."""
    at = {"error": 0, "warning": 1, "info": 2}[fail_on.strip().lower()]
    return 2 if errors else int(not findings.where(severity_rank() <= at).isEmpty())


def console_summary(findings: DataFrame, top: int = 10, metrics: DataFrame | None = None) -> DataFrame:
    """``(kind, name, n)``: severities, the ``top`` files and rules, and, with metrics, the hotspots: files of most churn, with their commits of the year."""
    part = lambda kind, c, n: findings.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n).select(F.lit(kind).alias("kind"), "name", "n")
    out = part("severity", "severity", 3).unionByName(part("file", "file_path", top)).unionByName(part("rule", "rule_id", top))
    if metrics is None:
        return out
    hot = metrics.where("churn_score > 0").orderBy(F.desc("churn_score"), "file_path").limit(top)
    return out.unionByName(hot.select(F.lit("hotspot").alias("kind"), F.col("file_path").alias("name"), F.col("commits_365d").alias("n")))
