"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as fo
from ..operators import history as ho
from ..operators import text as to
from ..sources.driver_tables import COMMITS_SQL, FINDINGS_SQL, TREE_SQL, commits, findings, table, tree

NOW = "2024-01-31 00:00:00"
KINDS = ("click", "view", "error", "purchase", "login")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_PIVOT = "count(*) as total, count(*) filter (where severity = 'Error') as error_count, count(*) filter (where severity = 'Warning') as warning_count, count(*) filter (where severity = 'Info') as info_count"
_RANK = "case severity when 'Error' then 0 when 'Warning' then 1 when 'Info' then 2 else 3 end"
_COLUMNS = "run_id, rule_id, file_path, line, severity, confidence, fingerprint"
_DAYS = f"(epoch_us(timestamp '{NOW}') - epoch_us(ts)) / 86400000000.0"


def query(sql: str):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _now():
    return F.lit(NOW).cast("timestamp")


@query(f"with {FINDINGS_SQL} select run_id, {_PIVOT} from findings group by 1")
def run_list(spark, sf_dir):
    return fo.pivot_by(findings(spark, sf_dir), "run_id")


@query(f"with {FINDINGS_SQL} select run_id, {_PIVOT} from findings where run_id = 1997 group by 1")
def run_details(spark, sf_dir):
    return fo.pivot_by(fo.filtered(findings(spark, sf_dir), run_id=1997), "run_id")


@query(f"with {FINDINGS_SQL} select file_path, {_PIVOT} from findings group by 1")
def file_summary(spark, sf_dir):
    return fo.pivot_by(findings(spark, sf_dir), "file_path")


@query(f"with {FINDINGS_SQL} select rule_id, {_PIVOT} from findings group by 1")
def finding_rules(spark, sf_dir):
    return fo.pivot_by(findings(spark, sf_dir), "rule_id")


@query(f"with {FINDINGS_SQL} select confidence, count(*) as n from findings group by 1")
def confidence_summary(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("confidence").agg(F.count("*").alias("n"))


@query("select coalesce(nullif(lang, ''), 'unknown') as language, count(*) as n from documents group by 1")
def language_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"))


@query(f"with {FINDINGS_SQL} select file_path, {_PIVOT} from findings where confidence = 'High' group by 1 order by total desc, file_path limit 10")
def top_high_confidence_files(spark, sf_dir):
    return fo.top_files(findings(spark, sf_dir))


@query(f"with {FINDINGS_SQL} select file_path, cast(sum(case severity when 'Error' then 5 when 'Warning' then 2 else 1 end) as bigint) as risk from findings group by 1 order by risk desc, file_path limit 5")
def artifact_risk_topk(spark, sf_dir):
    return fo.risk_ranking(findings(spark, sf_dir))


@query(f"with {FINDINGS_SQL} select {_COLUMNS} from findings where confidence = 'High' order by {_RANK}, rule_id, file_path, line, confidence, fingerprint, run_id limit 50 offset 100")
def findings_page(spark, sf_dir):
    return fo.page(fo.filtered(findings(spark, sf_dir), confidence="High"), 100, 50)


@query(f"with {FINDINGS_SQL} select {_COLUMNS} from findings where starts_with(rule_id, 'S')")
def findings_by_rule_prefix(spark, sf_dir):
    return fo.filtered(findings(spark, sf_dir), rule_prefix="S")


@query(f"with {FINDINGS_SQL} select {_COLUMNS} from findings where run_id = 1996")
def findings_export(spark, sf_dir):
    return fo.filtered(findings(spark, sf_dir), run_id=1996)


@query(
    f"with {FINDINGS_SQL}, rules as (select distinct p_type as rule_id, 'Warning' as default_severity from part union all select 'dormant', 'Info'), "
    "t as (select r.rule_id, r.default_severity, count(f.severity) as total, count(*) filter (where f.severity <> r.default_severity) as override_hits from rules r left join findings f on f.rule_id = r.rule_id group by 1, 2) "
    "select *, case when total = 0 then 'No Findings' when override_hits > 0 then 'Overridden' else 'Enabled' end as state from t"
)
def rule_catalog_state(spark, sf_dir):
    rules = table(spark, sf_dir, "part").select(F.col("p_type").alias("rule_id")).distinct().withColumn("default_severity", F.lit("Warning"))
    return fo.rule_catalog(findings(spark, sf_dir), rules.union(spark.sql("select 'dormant', 'Info'")))


@query(
    f"with {FINDINGS_SQL}, a as (select distinct fingerprint from findings where run_id = 1996), b as (select distinct fingerprint from findings where run_id = 1997) "
    "select count(*) filter (where a.fingerprint is null) as new_count, count(*) filter (where b.fingerprint is null) as fixed_count, count(*) filter (where a.fingerprint = b.fingerprint) as unchanged_count from a full join b on a.fingerprint = b.fingerprint"
)
def run_compare_counts(spark, sf_dir):
    return fo.compare_counts(findings(spark, sf_dir), 1996, 1997)


def _only(a, b):
    return f"with {FINDINGS_SQL} select {_COLUMNS} from findings where run_id = {a} and fingerprint not in (select fingerprint from findings where run_id = {b}) qualify row_number() over (partition by fingerprint order by rule_id, file_path, line, {_RANK}, confidence) = 1"


@query(_only(1997, 1996))
def run_compare_new(spark, sf_dir):
    return fo.only_in(findings(spark, sf_dir), 1997, 1996)


@query(_only(1996, 1997))
def run_compare_fixed(spark, sf_dir):
    return fo.only_in(findings(spark, sf_dir), 1996, 1997)


@query(f"with {FINDINGS_SQL} select run_id, rule_id, file_path, line, case when starts_with(rule_id, 'S') then 'Info' else severity end as severity, confidence, fingerprint from findings where not starts_with(rule_id, 'L') and not (starts_with(rule_id, 'M') and starts_with(file_path, 'Brand#1'))")
def policy_apply(spark, sf_dir):
    f = findings(spark, sf_dir)
    rules = table(spark, sf_dir, "part").select(F.col("p_type").alias("rule_id")).distinct()
    policy = rules.select(F.upper("rule_id").alias("rule_id"), (~F.col("rule_id").startswith("L")).alias("enabled"), F.when(F.col("rule_id").startswith("S"), "Info").alias("severity"))
    allowed = rules.where(F.col("rule_id").startswith("M")).withColumn("path_prefix", F.lit("Brand#1"))
    return fo.apply_policy(f, policy, allowed)


def _scan_sql(select: str) -> str:
    each = " union all ".join(f"select doc_id as file_id, line, '{r}' as rule_id, '{s}' as severity, len(regexp_extract_all(content, '{p}')) as matches from lines" for r, s, p in to.RULES)
    return f"with lines as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents), hits as (select * from ({each}) where matches > 0) {select}"


@query(_scan_sql("select file_id, line, rule_id, severity, matches from hits"))
def text_scan(spark, sf_dir):
    return to.scan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text"))


@query(_scan_sql(f"select rule_id, {_PIVOT} from hits group by 1"))
def rule_summary(spark, sf_dir):
    counts = to.rule_counts(table(spark, sf_dir, "documents").select("text"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(f"{s.lower()}_count")
    return counts.groupBy("rule_id").agg(F.sum("n").alias("total"), of("Error"), of("Warning"), of("Info"))


@query(
    f"with {COMMITS_SQL}, t as (select path, count(*) filter (where {_DAYS} <= 7) as commits_7d, count(*) filter (where {_DAYS} <= 14) as commits_14d, count(*) filter (where {_DAYS} <= 30) as commits_30d, "
    "count(distinct author) as authors, cast(sum(greatest(0, lines)) as bigint) as lines_added, cast(sum(greatest(0, lines // 2)) as bigint) as lines_removed, max(ts) as last_commit_at from commits group by 1) select *, round(commits_30d * ln(1 + lines_added + lines_removed), 4) as churn_score from t"
)
def churn_file_metrics(spark, sf_dir):
    c = commits(spark, sf_dir).withColumn("added", F.col("lines")).withColumn("removed", F.floor(F.col("lines") / 2).cast("long"))
    return ho.churn(c, _now(), (7, 14, 30))


@query(
    f"with {COMMITS_SQL}, a as (select path, author, count(*) as n from commits group by 1, 2), r as (select *, row_number() over (partition by path order by n) as i, count(*) over (partition by path) as m from a) "
    "select path, round(case when max(m) = 1 then 1.0 else greatest(0.0, least(1.0, 2.0 * cast(sum(i * n) as double) / (max(m) * cast(sum(n) as double)) - (max(m) + 1.0) / max(m))) end, 6) as concentration from r group by 1"
)
def gini_by_file(spark, sf_dir):
    return ho.gini(commits(spark, sf_dir))


@query(
    f"with {COMMITS_SQL}, a as (select path, author, count(*) as n, max(ts) as newest from commits group by 1, 2) "
    "select path, cast(author as varchar) as top_author, round(n / cast(sum(n) over (partition by path) as double), 6) as top_author_pct from a qualify row_number() over (partition by path order by n desc, newest desc, author) = 1"
)
def top_author(spark, sf_dir):
    return ho.top_author(commits(spark, sf_dir)).drop("top_author_last")


@query(f"with {COMMITS_SQL}, f as (select path, count(*) as n from commits group by 1) select split_part(path, '/', 1) as module, round(quantile_cont(cast(n as double), 0.9), 6) as p90, count(*) as files from f group by 1")
def module_p90(spark, sf_dir):
    return ho.module_p90(commits(spark, sf_dir))


@query(f"with {TREE_SQL} select count(*) as files, cast(sum(size) as bigint) as size, round(avg(metric), 4) as metric from tree where starts_with(path, 'ASIA/')")
def dir_drilldown(spark, sf_dir):
    return ho.drilldown(tree(spark, sf_dir), "ASIA")


@query(
    f"with {COMMITS_SQL}, d as (select case when lines % 11 <> 0 then floor({_DAYS} * 13) end as days from commits), b as (select case when days < 30 then 0 when days <= 90 then 1 when days <= 180 then 2 when days <= 365 then 3 else 4 end as bucket from d where days is not null), "
    "n as (select bucket, count(*) as n from b group by 1) select cast(t.i as int) as bucket, coalesce(n, 0) as n from range(0, 5) t(i) left join n on n.bucket = t.i"
)
def debt_aging(spark, sf_dir):
    ages = commits(spark, sf_dir).select(F.when(F.col("lines") % 11 != 0, F.floor(ho.age_days(_now()) * 13)).alias("age_days"))
    return ho.ageing(ages)


@query(f"with {COMMITS_SQL} select path, " + ", ".join(f"case when count(*) filter (where kind = '{k}') > 0 then 'present' else 'missing' end as env_{k}" for k in KINDS) + " from commits group by 1")
def drift_matrix(spark, sf_dir):
    return ho.drift_matrix(commits(spark, sf_dir), KINDS)


@query(f"with {COMMITS_SQL}, f as (select path, split_part(path, '/', 1) as module, count(*) as n from commits group by 1, 2) select path, n, module, row_number() over (partition by module order by n desc, path) as place from f qualify place <= 3")
def magic_top_per_dir(spark, sf_dir):
    return ho.top_per_module(commits(spark, sf_dir))
