"""Operators over commit logs and file trees: churn, ownership, modules, roll-ups, ageing, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = (30, 90, 180, 365)
SINCE_DAYS, IDLE_DAYS, CONCENTRATED, IMPORT_LINES = 365, 90, 0.8, 500
# fixed values
STALE_CATEGORIES = ("Source", "DeploymentArtifact")
STALE_IGNORED = ("*.designer.cs", "*.g.cs", "*.generated.*", "packages.lock.json", "yarn.lock", "RolloutSpec.generated.json")
PROJECT_MARKERS = (".csproj", ".vcxproj", "Cargo.toml")
BUCKETS = (30, 90, 180, 365)


def age_days(now, ts="ts") -> F.Column:
    """Age in days, with a fraction."""
    return (F.unix_micros(F.lit(now)) - F.unix_micros(ts)) / F.lit(86_400_000_000)


def churn_score(commits, added, removed) -> F.Column:
    """Commits times the logarithm of one and the lines changed."""
    return commits * F.log1p(added + removed)


def stale_score(days) -> F.Column:
    """0 for a file changed today, near 1 for one left alone for years."""
    return 1 - F.exp(-F.greatest(F.lit(0), F.floor(days)) / 180.0)


def churn(commits: DataFrame, now, windows=WINDOWS) -> DataFrame:
    """``commits(path, author, ts, added, removed)`` of the look-back -> commits by age in days, authors, lines and the churn score of each path."""
    age = age_days(now)
    counts = [F.count_if(age <= d).alias(f"commits_{d}d") for d in windows]
    last = windows[-1]
    lines = [F.sum(F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))).alias(f"lines_{c}") for c in ("added", "removed")]
    out = commits.groupBy("path").agg(*counts, F.countDistinct(F.when(age <= last, F.lower("author"))).alias("authors"), *lines, F.max("ts").alias("last_commit_at"))
    return out.withColumn("churn_score", F.round(churn_score(F.col(f"commits_{last}d"), F.col("lines_added"), F.col("lines_removed")), 4))


def author_counts(commits: DataFrame) -> DataFrame:
    """``(path, author, n, newest)``; names that differ in case only are one author."""
    name = F.col("author").cast("string")
    return commits.groupBy("path", F.lower(name).alias("key")).agg(F.min(name).alias("author"), F.count("*").alias("n"), F.max("ts").alias("newest")).drop("key")


def gini(commits: DataFrame) -> DataFrame:
    """Concentration of each path's commits on its authors: 1 for a single author.

    Authors with equally many commits are one row with their number, and their places in the order of
    counts follow from a running sum, so a path with very many authors is never gathered in one row.
    """
    steps = author_counts(commits).groupBy("path", "n").agg(F.count("*").alias("m"))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = steps.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)))
    weighted = F.sum(F.col("n").cast("double") * (F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2))
    g = placed.groupBy("path").agg(weighted.alias("weighted"), F.sum(F.col("n").cast("double") * F.col("m")).alias("total"), F.sum("m").alias("authors"))
    value = F.when(F.col("authors") == 1, 1.0).otherwise(2 * F.col("weighted") / (F.col("authors") * F.col("total")) - (F.col("authors") + 1) / F.col("authors"))
    return g.select("path", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6).alias("concentration"))


def top_author(commits: DataFrame) -> DataFrame:
    """The author with the most commits; ties go to the one seen last, then to the smaller name."""
    best = F.min_by(F.struct("author", "n", "newest"), F.struct(-F.col("n"), -F.unix_micros("newest"), "author")).alias("b")
    out = author_counts(commits).groupBy("path").agg(best, F.sum("n").alias("total"))
    return out.select("path", F.col("b.author").alias("top_author"), F.round(F.col("b.n") / F.col("total"), 6).alias("top_author_pct"), F.col("b.newest").alias("top_author_last"))


def ignored_as_stale(path) -> F.Column:
    """Generated and lock files, by their whole path or by name."""
    from ..functions.globs import loose

    return F.coalesce(path.rlike("|".join(loose(g) for g in STALE_IGNORED)) | F.element_at(F.split(path, "/"), -1).rlike("|".join(loose(g) for g in STALE_IGNORED)), F.lit(False))


def file_metrics(files: DataFrame, history: DataFrame, now, since_days: int = SINCE_DAYS, idle_days: int = IDLE_DAYS, least: float = CONCENTRATED, import_lines: int = IMPORT_LINES) -> DataFrame:
    """``files(path, category)`` with the whole ``history(path, author, ts, added, removed)`` -> a row for each file.

    Counts, authors and lines cover ``since_days``; the last commit is sought in the whole history, where a
    file with one commit, of many lines and within the look-back, was never changed since its import. The
    stale score is null for files that are not expected to change. Paths are compared without case.
    """
    key = F.lower("path")
    h = history.join(files.select(key.alias("__key"), F.col("path").alias("__path")), key == F.col("__key")).drop("path", "__key").withColumnRenamed("__path", "path")
    ever = h.groupBy("path").agg(F.count("*").alias("ever"), F.max("ts").alias("last_ever"))
    recent = h.where(age_days(now) <= since_days)
    within = recent.where(age_days(now) <= WINDOWS[-1])
    out = files.select("path", "category").join(churn(recent, now), "path", "left").join(gini(within), "path", "left").join(top_author(within), "path", "left").join(ever, "path", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*[f"commits_{d}d" for d in WINDOWS], "authors", "lines_added", "lines_removed")]
    flat = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("churn_score", "concentration", "top_author_pct")]
    last = F.coalesce("last_commit_at", "last_ever")
    eligible = F.col("category").isin(*STALE_CATEGORIES) & ~ignored_as_stale(F.col("path"))
    days = F.coalesce(age_days(now, "last_commit_at"), F.lit(float(since_days)))
    risk = F.coalesce((F.col("concentration") > least) & (age_days(now, "top_author_last") > idle_days), F.lit(False))
    kept = F.coalesce((F.col("ever") == 1) & (F.col("lines_added") + F.col("lines_removed") >= import_lines), F.lit(False))
    return out.withColumn("last_commit_at", last).select(
        "path", "category", "last_commit_at", *zero, *flat, "top_author", F.when(eligible, F.round(stale_score(days), 6)).alias("stale_score"), risk.alias("ownership_risk"), kept.alias("never_changed")
    )


def newest_commits(history: DataFrame, n: int = 2) -> DataFrame:
    """The last ``n`` commits of each path."""
    w = Window.partitionBy("path").orderBy(F.desc("ts"), "sha")
    return history.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def tracked(changes: DataFrame, files: DataFrame) -> DataFrame:
    """``changes(path, old_path, ...)`` under the name that ``files(path)`` has now: the new path, or else the old one of a rename; others go."""
    f = files.select(F.lower("path").alias("__key"), F.col("path").alias("__now"))
    new = changes.join(f, F.lower(changes["path"]) == F.col("__key"), "left").drop("__key").withColumnRenamed("__now", "__new")
    old = new.join(f, F.lower("old_path") == F.col("__key"), "left").drop("__key")
    return old.withColumn("path", F.coalesce("__new", "__now")).where("path is not null").drop("__new", "__now", "old_path")


def top_folder(path) -> F.Column:
    """The first folder of a path, or ``.``."""
    at = F.instr(path, F.lit("/"))
    return F.when(at > 1, F.substring(path, F.lit(1), at - 1)).otherwise(".")


def project_keys(files: DataFrame) -> DataFrame:
    """``files(path)`` with ``module_project``: the marker file of the nearest folder that has one, else the top folder; a marker at the root counts for none."""
    from ..functions.scalars import directory

    name = F.element_at(F.split("path", "/"), -1)
    marks = files.where(name.rlike("(?i)(" + "|".join(m.replace(".", "[.]") for m in PROJECT_MARKERS) + ")$"))
    marks = marks.select(F.lower(directory(F.col("path"))).alias("__dir"), "path").where("__dir <> '.'").groupBy("__dir").agg(F.min("path").alias("__marker"))
    parts = F.split("path", "/")
    up = files.select("path").distinct().withColumn("__n", F.explode(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))))
    up = up.withColumn("__dir", F.lower(F.array_join(F.slice(parts, F.lit(1), F.col("__n")), "/")))
    near = up.join(marks, "__dir").groupBy("path").agg(F.max_by("__marker", "__n").alias("__marker"))
    return files.join(near, "path", "left").withColumn("module_project", F.coalesce("__marker", top_folder(F.col("path")))).drop("__marker")


def service_keys(files: DataFrame, mappings: list[tuple[str, str]]) -> DataFrame:
    """``files(path)`` with ``module_service``: the first of ``mappings(service, glob)``, a configuration, whose glob fits, else ``.``."""
    from .patterns import first

    named = first(files, [(glob, service) for service, glob in mappings])
    return files.join(named, "path", "left").withColumn("module_service", F.coalesce("value", F.lit("."))).drop("value")


def module_aggregates(metrics: DataFrame, key: F.Column) -> DataFrame:
    """90th percentiles, with linear interpolation, of a module's churn, stale score and ownership; modules without case."""
    p = lambda c: F.round(F.percentile(F.coalesce(F.col(c), F.lit(0.0)), 0.9), 6)
    g = metrics.withColumn("__module", key).groupBy(F.lower("__module").alias("__k"))
    return g.agg(F.min("__module").alias("module"), F.count("*").alias("files"), p("churn_score").alias("churn_p90"), p("stale_score").alias("stale_p90"), p("concentration").alias("ownership_p90")).drop("__k")


def history_findings(metrics: DataFrame, stale_least: float = 0.8) -> DataFrame:
    """Findings about single files: orphaned knowledge, stale files, files never changed since their import."""
    hit = lambda when, rule, severity: F.when(when, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity")))
    hits = F.array(
        hit(F.col("ownership_risk"), "churn.ownership.orphaned_knowledge_risk", "Warning"),
        hit(F.col("stale_score") >= stale_least, "churn.stale.file_risk", "Info"),
        hit(F.col("never_changed"), "churn.ownership.never_changed_since_import", "Info"),
    )
    return metrics.select("path", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).select("path", "h.rule_id", "h.severity")


def unavailable(files: DataFrame) -> DataFrame:
    """The notice, for each of ``files(path)``, that there is no history to look at."""
    return files.select("path", F.lit("churn.analysis.unavailable").alias("rule_id"), F.lit("Info").alias("severity"))


def module_p90(commits: DataFrame) -> DataFrame:
    """90th percentile, with linear interpolation, of commits a file by top folder."""
    files = commits.groupBy("path").agg(F.count("*").alias("n"))
    return files.groupBy(F.split("path", "/")[0].alias("module")).agg(F.round(F.percentile("n", 0.9), 6).alias("p90"), F.count("*").alias("files"))


def drilldown(tree: DataFrame, directory: str) -> DataFrame:
    """Unweighted mean and size of all below a folder."""
    below = tree.where(F.col("path").startswith(f"{directory}/"))
    return below.agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.round(F.avg("metric"), 4).alias("metric"))


def ageing(ages: DataFrame, bounds=BUCKETS) -> DataFrame:
    """``ages(age_days)`` -> ``(bucket, n)``: under the first bound, then up to each further one, then beyond; unknown ages are left out, empty buckets stay."""
    spark = ages.sparkSession
    days = F.col("age_days")
    bucket = (days >= bounds[0]).cast("int")
    for b in bounds[1:]:
        bucket = bucket + (days > b).cast("int")
    counts = ages.where("age_days is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(len(bounds) + 1).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # a row a bucket


def drift_matrix(settings: DataFrame, kinds) -> DataFrame:
    """``settings(path, kind)``: whether each path is present in each environment."""
    cells = [F.when(F.count_if(F.col("kind") == k) > 0, "present").otherwise("missing").alias(f"env_{k}") for k in kinds]
    return settings.groupBy("path").agg(*cells)


def top_per_module(commits: DataFrame, per_module: int = 3) -> DataFrame:
    """The busiest files of each top folder."""
    files = commits.groupBy("path").agg(F.count("*").alias("n")).withColumn("module", F.split("path", "/")[0])
    w = Window.partitionBy("module").orderBy(F.desc("n"), "path")
    return files.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_module)
