"""The driver's tables as the five tables of the analytical store, and the same views in SQL.

Runs are the years of orders and one run without findings; every part is a file of each run, every line
item a finding, and the events, stretched over thirteen times their span, are the commit log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, history
from .driver_tables import table

NOW = "2024-01-31 00:00:00"
YEARS = (1995, 2002)
DIRECTORIES = ("src/app", "src/lib", "tests/unit", "deploy/ev2/x", "src/pipelines", "docs", "cfg", "ops/.azuredevops/jobs", "rollout", "SRC/App", "tools", "src/app/deep")
EXTENSIONS = (".cs", ".py", ".cs", ".json", ".yml", ".md", ".json", ".yml", ".generated.json", ".csproj", ".ps1", ".rs")
CATEGORIES = ("Source", "Source", "Source", "DeploymentArtifact", "DeploymentArtifact", "Docs", "Config", "DeploymentArtifact", "DeploymentArtifact", "Unknown", "Source", "Source")
LANGUAGES = ("csharp", "python", "csharp", "json", "yaml", "markdown", "json", "yaml", "json", None, "powershell", "rust")
RULE_IDS = (*catalog.RULES, "git-history.legacy", "custom.alpha", "deploy.other.hardcoded.thing", "DEPLOY.ado.Inline_Secret")
METADATA = (
    None,
    '{"engine":"roslyn","astConfirmed":true}',
    '{"engine":"regex","suppressed":true,"suppressionReason":"known","suppressionSource":"Inline"}',
    '{"isSuppressed":true,"reason":"legacy"}',
    '{"engine":"artifact-structured","artifactPath":"$.steps[1]","matchedValue":"x"}',
    '{"suppressed":false,"note":"allowlist"}',
    '{"suppressed":true,"note":"by allowlist"}',
    '{"suppressed":true,"note":"inline"}',
    '{"engine":"regex","matchedValue":"10.0.0.1"}',
    '{"engine":"regex","suppressed":true,"suppressionSource":" Elsewhere"}',
)


@dataclass
class Store:
    """The five tables."""

    runs: DataFrame
    files: DataFrame
    findings: DataFrame
    rules: DataFrame
    metrics: DataFrame


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index % len(values) + 1).cast("int"))


def _path(key):
    return F.concat(_pick(DIRECTORIES, key), F.lit("/f"), key.cast("string"), _pick(EXTENSIONS, key))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, author, ts, added, removed, sha)``: the events of the first hundred parts' files."""
    key = F.get_json_object("props", "$.k").cast("long") + 1
    now = F.unix_micros(F.lit(NOW).cast("timestamp"))
    ev = table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").isNotNull())
    ts = F.timestamp_micros(now - (now - F.unix_micros(F.col("ts").cast("timestamp"))) * 13)
    lines = F.floor("value").cast("long")
    return ev.select(_path(key).alias("path"), F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("author"), ts.alias("ts"), lines.alias("added"), F.floor(lines / 3).cast("long").alias("removed"), F.col("event_id").cast("string").alias("sha"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, file_id, path, category, size_bytes, hash, language)``."""
    y, k = F.col("y"), F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(YEARS[0]).cast("long"), F.lit(YEARS[1] - 1).cast("long"))).alias("y"))
    size = F.when(k % 17 == 0, 0).otherwise(F.col("p_size") * 100).cast("long")
    return rows.select(
        F.concat(F.lit("y"), y.cast("string")).alias("run_id"), (y * 1_000_000_000 + k).alias("file_id"), _path(k).alias("path"), _pick(CATEGORIES, k).alias("category"),
        size.alias("size_bytes"), F.md5(_path(k).cast("binary")).alias("hash"), _pick(LANGUAGES, k).alias("language"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings, with an id made of the whole row."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    rows = li.join(table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y")), F.col("l_orderkey") == F.col("o_orderkey"))
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("long")
    rule = _pick(RULE_IDS, p * 7 + n * 5 + s)
    whole = F.concat_ws("|", *[F.col(c).cast("string") for c in li.columns])
    return rows.select(
        F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long").alias("finding_id"), F.concat(F.lit("y"), F.col("y").cast("string")).alias("run_id"), rule.alias("rule_id"),
        (F.col("y") * 1_000_000_000 + p).alias("file_id"), _path(p).alias("file_path"), (n * 10 + s % 7).alias("line"), (s % 40 + 1).alias("column"), F.concat(F.lit("Found "), rule).alias("message"),
        F.when(s % 3 != 0, F.concat(F.lit("x = "), p.cast("string"))).alias("snippet"),
        F.when(F.col("l_returnflag") == "R", "Error").when(F.col("l_returnflag") == "A", "Warning").otherwise("Info").alias("severity"), _pick(("High", "Medium", "Low"), s).alias("confidence"),
        F.when(s % 29 == 0, "").otherwise(F.concat(p.cast("string"), F.lit(":"), n.cast("string"))).alias("fingerprint"), _pick(METADATA, s).alias("metadata"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History metrics of the files of run y1997."""
    f = files(spark, sf_dir).where("run_id = 'y1997'")
    got = history.file_metrics(f.select("path", "category"), commits(spark, sf_dir), F.lit(NOW).cast("timestamp")).drop("category")
    return f.select("run_id", "file_id", F.col("path").alias("file_path")).join(got.withColumnRenamed("path", "file_path"), "file_path")


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The tables as a store."""
    by = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.min("o_orderdate").cast("timestamp").alias("started_at"), F.max("o_orderdate").cast("timestamp").alias("ended_at"))
    runs = by.select(F.concat(F.lit("y"), F.col("y").cast("string")).alias("run_id"), F.lit("/repo").alias("repo_root"), "started_at", "ended_at", F.lit("1.0").alias("tool_version"))
    empty = spark.sql("select 'empty' as run_id, '/repo' as repo_root, timestamp '1990-01-01 00:00:00' as started_at, cast(null as timestamp) as ended_at, '1.0' as tool_version")
    return Store(runs.unionByName(empty), files(spark, sf_dir), findings(spark, sf_dir), catalog.builtin(spark), metrics(spark, sf_dir))


def _list(values) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _at(values, index: str) -> str:
    return f"{_list(values)}[({index}) % {len(values)} + 1]"


def _path_sql(key: str) -> str:
    return f"({_at(DIRECTORIES, key)} || '/f' || {key} || {_at(EXTENSIONS, key)})"


RUNS_SQL = """runs as (
  select 'y' || year(o_orderdate) as run_id, '/repo' as repo_root, min(o_orderdate) as started_at, max(o_orderdate) as ended_at, '1.0' as tool_version from orders group by 1
  union all select 'empty', '/repo', timestamp '1990-01-01 00:00:00', null, '1.0')"""
FILES_SQL = f"""files as (
  select 'y' || y as run_id, y * 1000000000 + p_partkey as file_id, {_path_sql("p_partkey")} as path, {_at(CATEGORIES, "p_partkey")} as category,
    cast(case when p_partkey % 17 = 0 then 0 else p_size * 100 end as bigint) as size_bytes, md5({_path_sql("p_partkey")}) as hash, {_at(LANGUAGES, "p_partkey")} as language
  from part, range({YEARS[0]}, {YEARS[1]}) t(y))"""
_RULE_SQL = _at(RULE_IDS, "l_partkey * 7 + l_linenumber * 5 + l_suppkey")
FINDINGS_SQL = f"""findings as (
  select cast('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus)), 1, 15) as bigint) as finding_id, 'y' || year(o_orderdate) as run_id,
    {_RULE_SQL} as rule_id, year(o_orderdate) * 1000000000 + l_partkey as file_id, {_path_sql("l_partkey")} as file_path, cast(l_linenumber * 10 + l_suppkey % 7 as bigint) as line, l_suppkey % 40 + 1 as "column",
    'Found ' || {_RULE_SQL} as message, case when l_suppkey % 3 <> 0 then 'x = ' || l_partkey end as snippet,
    case l_returnflag when 'R' then 'Error' when 'A' then 'Warning' else 'Info' end as severity, {_at(("High", "Medium", "Low"), "l_suppkey")} as confidence,
    case when l_suppkey % 29 = 0 then '' else l_partkey || ':' || l_linenumber end as fingerprint, {_at(METADATA, "l_suppkey")} as metadata
  from lineitem join orders on l_orderkey = o_orderkey)"""
_RULE_ROWS = ", ".join(f"('{r}', '{catalog.title(r)}', '{s}', 'Finds {catalog.title(r).lower()}.')" for r, s in catalog.RULES.items())
RULES_SQL = f"rules as (select * from (values {_RULE_ROWS}) t(rule_id, title, default_severity, description))"
COMMITS_SQL = f"""keyed as (select *, cast(json_extract_string(props, '$.k') as bigint) + 1 as k, epoch_us(timestamp '{NOW}') as now from events where json_extract_string(props, '$.k') is not null),
commits as (
  select {_path_sql("k")} as path, 'A' || user_id as author, make_timestamp(now - (now - epoch_us(ts)) * 13) as ts, cast(floor(value) as bigint) as added, cast(floor(floor(value) / 3) as bigint) as removed, cast(event_id as varchar) as sha from keyed)"""
METRICS_SQL = f"""aged as (select *, (epoch_us(timestamp '{NOW}') - epoch_us(ts)) / 86400000000.0 as age from commits),
counted as (
  select path, count(*) filter (where age <= 30) as commits_30d, count(*) filter (where age <= 90) as commits_90d, count(*) filter (where age <= 180) as commits_180d, count(*) as commits_365d,
    count(distinct author) as authors, cast(sum(greatest(0, added)) as bigint) as lines_added, cast(sum(greatest(0, removed)) as bigint) as lines_removed, max(ts) as recent from aged where age <= 365 group by 1),
ever as (select path, count(*) as ever, max(ts) as last_ever from aged group by 1),
by_author as (select path, author, count(*) as n, max(ts) as newest from aged where age <= 365 group by 1, 2),
leaders as (select path, author as top_author, newest, round(n / cast(sum(n) over (partition by path) as double), 6) as top_author_pct from by_author qualify row_number() over (partition by path order by n desc, newest desc, author) = 1),
shares as (select path, n, row_number() over (partition by path order by n) as i, count(*) over (partition by path) as m from by_author),
owners as (select path, round(case when max(m) = 1 then 1.0 else greatest(0.0, least(1.0, 2.0 * sum(cast(i * n as double)) / (max(m) * cast(sum(n) as double)) - (max(m) + 1.0) / max(m))) end, 6) as concentration from shares group by 1),
metrics as (
  select f.run_id, f.file_id, f.path as file_path, coalesce(c.recent, e.last_ever) as last_commit_at, coalesce(commits_30d, 0) as commits_30d, coalesce(commits_90d, 0) as commits_90d, coalesce(commits_180d, 0) as commits_180d, coalesce(commits_365d, 0) as commits_365d,
    coalesce(authors, 0) as authors, coalesce(lines_added, 0) as lines_added, coalesce(lines_removed, 0) as lines_removed, coalesce(round(commits_365d * ln(1 + lines_added + lines_removed), 4), 0.0) as churn_score,
    coalesce(concentration, 0.0) as concentration, coalesce(top_author_pct, 0.0) as top_author_pct, top_author,
    case when category in ('Source', 'DeploymentArtifact') and f.path not like '%.generated.%' then round(1 - exp(-greatest(0, floor(coalesce((epoch_us(timestamp '{NOW}') - epoch_us(coalesce(c.recent, e.last_ever))) / 86400000000.0, 365.0))) / 180.0), 6) end as stale_score,
    coalesce(concentration > 0.8 and epoch_us(timestamp '{NOW}') - epoch_us(newest) > 90 * 86400000000, false) as ownership_risk, coalesce(ever = 1 and lines_added + lines_removed >= 500, false) as never_changed
  from files f left join counted c on c.path = f.path left join owners o on o.path = f.path left join leaders l on l.path = f.path left join ever e on e.path = f.path where f.run_id = 'y1997')"""
STORE_SQL = ",\n".join((RUNS_SQL, FILES_SQL, FINDINGS_SQL, RULES_SQL))
ALL_SQL = ",\n".join((STORE_SQL, COMMITS_SQL, METRICS_SQL))
