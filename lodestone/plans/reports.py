"""The store's catalogue of queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from ..operators import findings as fo
from ..operators import history as ho
from ..operators import reports as ro
from ..sources import store_views as sv
from ..sources.store_views import ALL_SQL, COMMITS_SQL, FILES_SQL, FINDINGS_SQL, METRICS_SQL, RULES_SQL, STORE_SQL
from .catalogue import _PIVOT, query

RUN, OTHER = "y1997", "y1996"
_SUPPRESSED = "(coalesce(json_extract_string(metadata, '$.suppressed') = 'true', false) or coalesce(json_extract_string(metadata, '$.isSuppressed') = 'true', false))"
_AST = "coalesce(json_extract_string(metadata, '$.astConfirmed') = 'true', false)"
_REASON = "coalesce(json_extract_string(metadata, '$.suppressionReason'), json_extract_string(metadata, '$.reason'))"
_NAMED = "trim(lower(json_extract_string(metadata, '$.suppressionSource')))"
_RANK = "case severity when 'Error' then 0 when 'Warning' then 1 else 2 end"
_TYPE = "case when rule_id ilike 'deploy.ev2.%' then 'EV2' when rule_id ilike 'deploy.ado.%' then 'ADO' when lower(file_path) like '%/ev2/%' or lower(file_path) like '%rollout%' or lower(file_path) like '%service-model%' then 'EV2' when lower(file_path) like '%pipeline%' or lower(file_path) like '%/.azuredevops/%' or lower(file_path) like '%/ado/%' then 'ADO' else 'Unknown' end"
_GROUP = "case when rule_id ilike 'deploy.%.inline_secret' then 'inline-secrets' when rule_id ilike 'deploy.%.hardcoded.%' or rule_id ilike 'deploy.%.env_constant' then 'hardcoded-values' else 'missing-safety' end"
_CATEGORY = "case when rule_id like 'portability.%' then 'portability' when rule_id like 'magic-string.%' then 'magic-strings' when rule_id like 'churn.%' or rule_id like 'git-history.%' then 'churn' when rule_id like 'deploy.%' then 'deploy' else 'custom' end"
_ITEM = "finding_id, run_id, rule_id, file_id, file_path, line, \"column\", message, snippet, severity, confidence, fingerprint, metadata"
_TOLD = f"{_AST} as ast_confirmed, {_SUPPRESSED} as is_suppressed, {_REASON} as suppression_reason"
_SEVERITIES = _PIVOT.split("total, ", 1)[1]


def _source(missing: str) -> str:
    return f"case when {_NAMED} in ('inline', 'allowlist', 'config') then {_NAMED} when {_NAMED} is not null then 'config' when lower(coalesce(metadata, '')) like '%allowlist%' then 'allowlist' when lower(coalesce(metadata, '')) like '%inline%' then 'inline' else {missing} end"


def _with_rules(rows: str) -> str:
    return f"select t.*, coalesce(r.title, t.rule_id) as rule_title, coalesce(r.description, '') as rule_description from ({rows}) t left join rules r on r.rule_id = t.rule_id"


def _joined(where: str) -> str:
    return f"select f.*, category, language from findings f join (select file_id, category, language from files) using (file_id) where {where}"


def _micros(df, *names):
    """Times as microseconds, -1 for none, which every engine writes alike."""
    return df.withColumns({c: F.coalesce(F.unix_micros(c), F.lit(-1)) for c in names})


def _micros_sql(*names: str) -> str:
    return ", ".join(f"coalesce(epoch_us({c}), -1) as {c.rsplit('.', 1)[-1]}" for c in names)


@query(f"with {STORE_SQL} select r.run_id, repo_root, {_micros_sql('started_at', 'ended_at')}, tool_version, count(severity) as total, " + ", ".join(f"count(*) filter (where severity = '{s}') as {s.lower()}_count" for s in ("Error", "Warning", "Info")) + " from runs r left join findings f on f.run_id = r.run_id group by all")
def store_runs(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return _micros(ro.run_list(s.runs, s.findings), "started_at", "ended_at")


@query(f"with {STORE_SQL} select run_id, repo_root, {_micros_sql('started_at', 'ended_at')}, tool_version, 0 as total, 0 as error_count, 0 as warning_count, 0 as info_count from runs where run_id = 'empty'")
def store_run_by_id(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return _micros(ro.run_by_id(s.runs, s.findings, "empty"), "started_at", "ended_at")


def _page_sql(where: str, order: str, offset: int, limit: int) -> str:
    rows = f"{_joined(where)} order by {order}, finding_id limit {limit} offset {offset}"
    return f"with {STORE_SQL} select {_ITEM}, category, language, rule_title, rule_description, {_TOLD} from ({_with_rules(rows)})"


@query(_page_sql(f"run_id = '{RUN}' and severity = 'Error' and category = 'Source' and file_path ilike 'src/%' and not {_SUPPRESSED}", "rule_id desc", 20, 40))
def store_findings_page(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.findings_page(s.findings, s.files, s.rules, RUN, 20, 40, "rule", True, severity="Error", category="Source", path_prefix="src/", include_suppressed=False)


@query(_page_sql(f"run_id = '{RUN}' and category = 'Source'", "rule_id desc", 60, 40))
def store_findings_after(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    last = ro.findings_page(s.findings, s.files, s.rules, RUN, 59, 1, "rule", True, category="Source").first()
    return ro.findings_after(s.findings, s.files, s.rules, RUN, (last["rule_id"], last["finding_id"]) if last else None, 40, "rule", True, category="Source").drop("page_key")


@query(_page_sql(f"run_id = '{RUN}' and language = 'python'", "case confidence when 'High' then 0 when 'Medium' then 1 else 2 end", 0, 500))
def store_findings_by_confidence(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.findings_page(s.findings, s.files, s.rules, RUN, -3, 9000, "confidence", language="python")


@query(f"with {STORE_SQL} select (select count(*) from findings where run_id = '{RUN}') as total, (select count(*) from ({_joined(f"run_id = '{RUN}' and confidence = 'Low' and rule_id ilike 'deploy.%'")})) as filtered")
def store_page_counts(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.page_counts(s.findings, s.files, RUN, confidence="Low", rule_prefix="deploy.")


@query(f"with {STORE_SQL} select {_ITEM}, category, language, rule_title, rule_description, {_TOLD} from ({_with_rules(_joined(f"run_id = '{RUN}' and rule_id ilike 'portability.%' and not {_SUPPRESSED}"))})")
def store_findings_by_prefix(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.findings_by_prefix(s.findings, s.files, s.rules, RUN, "portability.")


@query(f"with {STORE_SQL} select {_ITEM}, rule_title, rule_description, {_TOLD} from ({_with_rules('select * from findings where file_id = 1997000000042')})")
def store_file_findings(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.findings_of_file(s.findings, s.rules, RUN, 1997000000042)


@query(f"with {STORE_SQL} select * from files where file_id = 1997000000042")
def store_file_by_id(spark, sf_dir):
    return ro.file_by_id(sv.files(spark, sf_dir), RUN, 1997000000042)


@query(f"with {STORE_SQL} select {_ITEM}, category, language, rule_title, rule_description, {_TOLD}, case when {_SUPPRESSED} then {_source('null')} end as suppression_source from ({_with_rules(_joined(f"run_id = '{RUN}' and confidence = 'Medium'"))})")
def store_findings_export(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.findings_for_export(s.findings, s.files, s.rules, RUN, confidence="Medium")


_DEPLOY = f"{_joined(f"run_id = '{RUN}' and rule_id ilike 'deploy.%' and not {_SUPPRESSED}")}"
_DEPLOYED = f"select *, {_TYPE} as artifact_type, {_GROUP} as subcategory, coalesce(json_extract_string(metadata, '$.artifactPath'), '$') as location from ({_DEPLOY})"


@query(f"with {STORE_SQL} select {_ITEM}, category, language, artifact_type, subcategory, location, rule_title, rule_description, {_TOLD} from ({_with_rules(f"select * from ({_DEPLOYED}) where artifact_type = 'ADO' and subcategory = 'hardcoded-values' order by location desc, finding_id limit 30 offset 5")})")
def deploy_page(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.deploy_page(s.findings, s.files, s.rules, RUN, 5, 30, "location", True, kind="ADO", subcategory="hardcoded-values")


@query(f"with {STORE_SQL} select artifact_type, {_SEVERITIES} from ({_DEPLOYED}) group by 1")
def deploy_severity_summary(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.deploy_severity(s.findings, s.files, RUN)


@query(f"with {STORE_SQL} select file_id, file_path, artifact_type, {_SEVERITIES}, cast(sum(case severity when 'Error' then 5 when 'Warning' then 2 else 1 end) as bigint) as risk from ({_DEPLOYED}) group by 1, 2, 3 order by risk desc, file_path, file_id, artifact_type limit 5")
def deploy_risk_topk(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.deploy_risk(s.findings, s.files, RUN)


@query(f"with {STORE_SQL} select count(*) as n from ({_DEPLOYED}) where subcategory = 'hardcoded-values'")
def hardcoded_count(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.hardcoded_count(s.findings, s.files, RUN)


@query(f"with {STORE_SQL} select file_id, file_path, category, language, {_PIVOT} from ({_joined(f"run_id = '{RUN}' and not {_SUPPRESSED}")}) group by 1, 2, 3, 4")
def store_file_summary(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.file_summary(s.findings, s.files, RUN)


@query(f"with {STORE_SQL} select t.*, coalesce(title, t.rule_id) as rule_title, coalesce(description, '') as rule_description from (select rule_id, {_PIVOT} from findings where run_id = '{RUN}' and not {_SUPPRESSED} group by 1) t left join rules r on r.rule_id = t.rule_id")
def store_rule_summary(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.rule_summary(s.findings, s.rules, RUN)


@query(f"with {STORE_SQL} select file_id, file_path, category, language, {_PIVOT} from ({_joined(f"run_id = '{RUN}' and confidence = 'High' and not {_SUPPRESSED}")}) group by 1, 2, 3, 4 order by total desc, file_path, file_id limit 10")
def store_top_files(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.top_files(s.findings, s.files, RUN)


@query(f"with {STORE_SQL} select confidence, count(*) as n from findings where run_id = '{RUN}' and not {_SUPPRESSED} group by 1")
def store_confidence_summary(spark, sf_dir):
    return ro.confidence_summary(sv.findings(spark, sf_dir), RUN)


@query(f"with {STORE_SQL} select coalesce(nullif(language, ''), 'unknown') as language, count(*) as n from ({_joined(f"run_id = '{RUN}' and not {_SUPPRESSED}")}) group by 1")
def store_language_summary(spark, sf_dir):
    return ro.language_summary(sv.findings(spark, sf_dir), sv.files(spark, sf_dir), RUN)


_COUNTS = (
    "count(*) as total, count(*) filter (where severity = 'Error') as error_count, count(*) filter (where severity = 'Warning') as warning_count, count(*) filter (where severity = 'Info') as info_count, count(*) filter (where confidence = 'High') as high_count, "
    f"count(*) filter (where {_AST}) as ast_confirmed, count(*) filter (where not {_AST}) as regex_only, count(*) filter (where rule_id in ('hygiene.todo_old', 'hygiene.fixme', 'hygiene.hack')) as tech_debt, count(*) filter (where rule_id like 'async.%' or rule_id like 'thread.%') as async_issues"
)
_LANGUAGE = "coalesce(nullif(language, ''), 'unknown')"


@query(
    f"with {STORE_SQL}, f as (select * from findings where run_id = '{RUN}' and not {_SUPPRESSED}), j as (select f.*, language from f join (select file_id, language from files) using (file_id)), s as ("
    f"select 'rule' as section, row_number() over (order by count(*) desc, rule_id) as place, rule_id as name, {_COUNTS} from f group by rule_id "
    f"union all select 'file', row_number() over (order by count(*) desc, file_path, file_id), file_path, {_COUNTS} from j group by file_path, file_id qualify row_number() over (order by count(*) desc, file_path, file_id) <= 10 "
    f"union all select * from (select 'confident_file' as section, row_number() over (order by count(*) filter (where confidence = 'High') desc, file_path, file_id) as place, file_path, {_COUNTS} from j group by file_path, file_id) where place <= 10 and high_count > 0 "
    f"union all select 'confidence', row_number() over (order by case confidence when 'High' then 1 when 'Medium' then 2 when 'Low' then 3 else 4 end, confidence), confidence, {_COUNTS} from f group by confidence "
    f"union all select 'language', row_number() over (order by count(*) desc, {_LANGUAGE}), {_LANGUAGE}, {_COUNTS} from j group by {_LANGUAGE} union all select 'all', 1, '', {_COUNTS} from f) "
    "select s.*, coalesce(r.title, s.name) as title from s left join rules r on s.section = 'rule' and r.rule_id = s.name"
)
def summary_page(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.summary_page(s.findings, s.files, s.rules, RUN)


@query(f"with {STORE_SQL} select count(*) filter (where {_AST}) as ast_confirmed, count(*) filter (where not {_AST}) as regex_only from findings where run_id = '{RUN}' and not {_SUPPRESSED}")
def flag_summary(spark, sf_dir):
    return ro.flag_summary(sv.findings(spark, sf_dir), RUN)


_CATALOG = f"""with {FINDINGS_SQL}, {RULES_SQL}, t as (
  select r.rule_id, title, r.default_severity, description, {_CATEGORY.replace("rule_id", "r.rule_id")} as category, count(f.severity) as total, count(*) filter (where f.severity <> r.default_severity) as o
  from rules r left join findings f on f.rule_id = r.rule_id group by all)
select rule_id, title, default_severity, description, category, case when total = 0 then 'No Findings' when o > 0 then 'Overridden' else 'Enabled' end as state, total from t"""


@query(_CATALOG)
def rule_catalog(spark, sf_dir):
    return ro.rule_catalog(sv.findings(spark, sf_dir), catalog.builtin(spark))


@query(_CATALOG + " where category = 'churn'")
def rule_catalog_by_category(spark, sf_dir):
    return ro.rule_catalog(sv.findings(spark, sf_dir), catalog.builtin(spark), " Churn ")


@query(f"with {STORE_SQL} select run_id, repo_root, {_micros_sql('started_at')}, file_path, line, \"column\", severity, message, confidence, fingerprint from (select f.*, repo_root, started_at from findings f join runs using (run_id) where rule_id = 'hygiene.fixme' order by started_at desc, finding_id desc limit 60)")
def rule_across_runs(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return _micros(ro.rule_history(s.findings, s.runs, "hygiene.fixme", 60), "started_at")


@query(f"with {FINDINGS_SQL} select count(*) filter (where not {_SUPPRESSED}) as active, count(*) filter (where {_SUPPRESSED}) as suppressed, count(*) as what_if from findings where run_id = '{RUN}'")
def suppression_totals(spark, sf_dir):
    return ro.suppression_totals(sv.findings(spark, sf_dir), RUN)


@query(f"with {STORE_SQL} select rule_id, rule_title, n from ({_with_rules(f"select rule_id, count(*) as n from findings where run_id = '{RUN}' and {_SUPPRESSED} group by 1")})")
def suppressions_of_rules(spark, sf_dir):
    return ro.suppression_by_rule(sv.findings(spark, sf_dir), catalog.builtin(spark), RUN)


@query(f"with {STORE_SQL} select finding_id, file_id, file_path, rule_id, rule_title, severity, confidence, message, {_REASON} as reason, {_source("'config'")} as source, line from ({_with_rules(f"select * from findings where run_id = '{RUN}' and {_SUPPRESSED}")})")
def suppression_details(spark, sf_dir):
    return ro.suppression_details(sv.findings(spark, sf_dir), catalog.builtin(spark), RUN)


def _lost(run: str, other: str, limit: int) -> str:
    rows = f"select * from findings f where run_id = '{run}' and fingerprint <> '' and not exists (select 1 from findings g where g.run_id = '{other}' and g.fingerprint = f.fingerprint) qualify row_number() over (partition by fingerprint order by finding_id, rule_id, file_path, line, severity) = 1"
    return f"with {FINDINGS_SQL} select fingerprint, rule_id, file_path, line, severity, message, confidence from ({rows}) order by rule_id, file_path, line, fingerprint limit {limit}"


@query(_lost(RUN, OTHER, 200))
def comparison_new(spark, sf_dir):
    return ro.comparison_details(sv.findings(spark, sf_dir), RUN, OTHER)


@query(_lost(OTHER, RUN, 2000))
def comparison_fixed(spark, sf_dir):
    return ro.comparison_details(sv.findings(spark, sf_dir), OTHER, RUN, 9_999)


@query(f"with {FINDINGS_SQL}, a as (select distinct fingerprint from findings where run_id = '{OTHER}' and fingerprint <> ''), b as (select distinct fingerprint from findings where run_id = '{RUN}' and fingerprint <> '') select count(*) filter (where a.fingerprint is null) as new_count, count(*) filter (where b.fingerprint is null) as fixed_count, count(*) filter (where a.fingerprint = b.fingerprint) as unchanged_count from a full join b on a.fingerprint = b.fingerprint")
def comparison_counts(spark, sf_dir):
    return fo.compare_counts(sv.findings(spark, sf_dir), OTHER, RUN)


# --- history --------------------------------------------------------------------------------------

_HISTORY = f"{FILES_SQL}, {COMMITS_SQL}, {METRICS_SQL}"


@query(f"with {_HISTORY} select * replace (coalesce(epoch_us(last_commit_at), -1) as last_commit_at) from metrics")
def file_metrics(spark, sf_dir):
    return _micros(sv.metrics(spark, sf_dir), "last_commit_at")


_METRIC_ITEM = "file_id, file_path, churn_score, stale_score, commits_90d, authors, concentration, top_author, top_author_pct, coalesce(epoch_us(last_commit_at), -1) as last_commit_at, concentration > 0.8 and commits_90d = 0 as is_orphaned"


@query(f"with {_HISTORY} select {_METRIC_ITEM} from metrics where churn_score >= 1 and coalesce(stale_score, 0) <= 0.9 and file_path ilike 'src/%' order by churn_score desc, file_path limit 20 offset 2")
def churn_page(spark, sf_dir):
    return _micros(ro.metrics_page(sv.metrics(spark, sf_dir), RUN, 2, 20, min_churn=1, max_stale=0.9, path_prefix="src/"), "last_commit_at")


@query(f"with {_HISTORY} select {_METRIC_ITEM} from metrics order by coalesce(metrics.last_commit_at, timestamp '1900-01-01'), file_path limit 500")
def churn_page_by_age(spark, sf_dir):
    return _micros(ro.metrics_page(sv.metrics(spark, sf_dir), RUN, limit=1000, sort="last", descending=False), "last_commit_at")


@query(f"with {_HISTORY}, top as (select {_METRIC_ITEM} from metrics order by concentration desc, file_path limit 200) select * from top where concentration >= 0.15 order by concentration desc, file_path limit 50")
def ownership_list(spark, sf_dir):
    return _micros(ro.ownership_list(sv.metrics(spark, sf_dir), RUN, 0.15), "last_commit_at")  # events have many authors each


@query(
    f"with {_HISTORY} select file_path as path, 'churn.ownership.orphaned_knowledge_risk' as rule_id, 'Warning' as severity from metrics where ownership_risk "
    "union all select file_path, 'churn.stale.file_risk', 'Info' from metrics where stale_score >= 0.8 union all select file_path, 'churn.ownership.never_changed_since_import', 'Info' from metrics where never_changed"
)
def history_findings(spark, sf_dir):
    return ho.history_findings(sv.metrics(spark, sf_dir).withColumnRenamed("file_path", "path"))


@query(f"with {_HISTORY}, r as (select *, row_number() over (partition by path order by ts desc, sha) as place from commits) select path, author, epoch_us(ts) as ts, added, removed, sha, place from r where place <= 2")
def newest_commits(spark, sf_dir):
    return _micros(ho.newest_commits(sv.commits(spark, sf_dir)), "ts")


_P90 = "count(*) as files, " + ", ".join(f"round(quantile_cont(coalesce({c}, 0.0), 0.9), 6) as {a}" for c, a in (("churn_score", "churn_p90"), ("stale_score", "stale_p90"), ("concentration", "ownership_p90")))


@query(f"with {_HISTORY}, m as (select *, case when file_path like '%/%' then split_part(file_path, '/', 1) else '.' end as module from metrics) select min(module) as module, {_P90} from m group by lower(module)")
def modules_by_folder(spark, sf_dir):
    return ho.module_aggregates(sv.metrics(spark, sf_dir), ho.top_folder(F.col("file_path")))


@query(
    f"with {_HISTORY}, marks as (select lower(regexp_replace(file_path, '/[^/]*$', '')) as dir, min(file_path) as marker from metrics where regexp_matches(lower(file_path), '([.]csproj|[.]vcxproj|cargo[.]toml)$') group by 1), "
    "near as (select file_path, arg_max(marker, length(dir)) as marker from metrics join marks on starts_with(lower(file_path), dir || '/') group by 1), "
    f"m as (select t.*, coalesce(marker, split_part(t.file_path, '/', 1)) as module from metrics t left join near on near.file_path = t.file_path) select min(module) as module, {_P90} from m group by lower(module)"
)
def modules_by_project(spark, sf_dir):
    m = ho.project_keys(sv.metrics(spark, sf_dir).withColumnRenamed("file_path", "path"))
    return ho.module_aggregates(m, F.col("module_project"))


SERVICES = [("web", "src/app/*"), ("web", "src/lib/*.py"), ("ops", "*azuredevops*"), ("late", "src/*")]


@query(
    f"with {_HISTORY}, m as (select *, case when regexp_matches(lower(file_path), '^src/app/.*$') or regexp_matches(lower(file_path), '^src/lib/.*[.]py$') then 'web' when lower(file_path) like '%azuredevops%' then 'ops' when lower(file_path) like 'src/%' then 'late' else '.' end as module from metrics) "
    f"select module, {_P90} from m where module <> '.' group by 1"
)
def modules_by_service(spark, sf_dir):
    m = ho.service_keys(sv.metrics(spark, sf_dir).withColumnRenamed("file_path", "path"), SERVICES)
    return ho.module_aggregates(m.where("module_service <> '.'"), F.col("module_service"))


@query(
    f"with {_HISTORY}, c as (select *, case when hash(0) is null or cast(sha as bigint) % 3 = 0 then 'new/' || path else path end as new_path, path as old_path from commits) "
    "select f.path, count(*) as n from c join (select distinct path from files) f on lower(f.path) = lower(c.old_path) group by 1"
)
def renamed_commits(spark, sf_dir):
    c = sv.commits(spark, sf_dir).withColumn("old_path", F.col("path")).withColumn("path", F.when(F.col("sha").cast("long") % 3 == 0, F.concat(F.lit("new/"), "path")).otherwise(F.upper("path")))
    return ho.tracked(c, sv.files(spark, sf_dir).select("path").distinct()).groupBy("path").agg(F.count("*").alias("n"))


# --- heatmap and tree -----------------------------------------------------------------------------

_HEAT = f"""heat as (
  select f.file_id, f.path as file_path, size_bytes, coalesce(churn_score, 0.0) as churn_score, coalesce(stale_score, 0.0) as stale_score, coalesce(concentration, 0.0) as ownership_risk,
    cast(coalesce(p, 0) as double) as portability, cast(coalesce(n, 0) as double) as density
  from files f left join metrics m on m.file_id = f.file_id left join (select file_id, count(*) as n, count(*) filter (where rule_id like 'portability.%') as p from findings group by 1) c on c.file_id = f.file_id where f.run_id = '{RUN}')"""


def _heat(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.heatmap(s.files, s.metrics, s.findings, RUN)


@query(f"with {ALL_SQL}, {_HEAT} select * from heat")
def heatmap(spark, sf_dir):
    return _heat(spark, sf_dir)


def _levels() -> str:
    """Folders from the leaves up, a step for each depth of the tree."""
    sums = ", ".join(f"sum({m} * w) / sum(w) as {m}" for m in ro.METRICS)
    cols = ", ".join(ro.METRICS)
    node = f"nodes as (select string_split(file_path, '/') as parts, len(string_split(file_path, '/')) as depth, size_bytes, 1 as files, cast(greatest(size_bytes, 1) as double) as w, {cols} from heat)"
    steps, above = [node], "select null::varchar[] as parts, 0 as depth, 0 as size_bytes, 0 as files, 0.0 as w, " + ", ".join(f"0.0 as {m}" for m in ro.METRICS) + " where false"
    for d in (3, 2, 1, 0):
        below = f"select parts, depth, size_bytes, files, w, {cols} from nodes where depth = {d + 1} union all select * from ({above})"
        steps.append(f"up{d} as (select min(parts[1:{d}]) as parts, {d} as depth, cast(sum(size_bytes) as bigint) as size_bytes, cast(sum(files) as bigint) as files, cast(greatest(sum(size_bytes), sum(files)) as double) as w, {sums} from ({below}) group by upper(array_to_string(parts[1:{d}], '/')))")
        above = f"select parts, depth, size_bytes, files, w, {cols} from up{d}"
    every = " union all ".join(f"select * from up{d}" for d in range(4))
    steps.append(f"folders as (select cast(depth as int) as depth, case when depth = 0 then '.' else array_to_string(parts, '/') end as directory, files, size_bytes, {', '.join(f'round({m}, 6) as {m}' for m in ro.METRICS)} from ({every}))")
    return ", ".join(steps)


@query(f"with {ALL_SQL}, {_HEAT}, {_levels()} select *, ownership_risk as metric from folders")
def dir_aggregates(spark, sf_dir):
    return ro.directory_aggregates(_heat(spark, sf_dir), "ownership_risk")


_NODES = f"""nodes2 as (
  select directory as path, true as is_directory, depth, files, size_bytes, density as metric from folders
  union all select file_path, false, cast(len(string_split(file_path, '/')) as int), 1, size_bytes, density from heat),
tree as (select *, case when depth = 0 then null when depth = 1 then '.' else regexp_replace(upper(path), '/[^/]*$', '') end as parent, list_last(string_split(path, '/')) as name from nodes2)"""


@query(f"with {ALL_SQL}, {_HEAT}, {_levels()}, {_NODES} select *, row_number() over (partition by parent order by is_directory desc, size_bytes desc, upper(name), path) as place from tree")
def treemap(spark, sf_dir):
    return ro.treemap(_heat(spark, sf_dir), "density")


@query(f"with {ALL_SQL}, {_HEAT}, {_levels()}, {_NODES} select max(metric) as most from tree")
def treemap_most(spark, sf_dir):
    return ro.most(_heat(spark, sf_dir), "density")


@query(f"with {ALL_SQL}, {_HEAT} select 'src/app' as directory, count(*) as files, cast(sum(size_bytes) as bigint) as size_bytes, round(avg(churn_score), 6) as metric from heat where file_path ilike 'src/app/%'")
def directory_drilldown(spark, sf_dir):
    return ro.drilldown(_heat(spark, sf_dir), "src/app")


@query(f"with {STORE_SQL} select file_id, file_path, category, language, {_PIVOT} from ({_joined(f"run_id = '{RUN}' and file_path ilike 'src/app/%'")}) group by 1, 2, 3, 4 order by total desc, file_path, file_id limit 10")
def drilldown_files(spark, sf_dir):
    s = sv.store(spark, sf_dir)
    return ro.drilldown_files(s.findings, s.files, RUN, "/src/app/")


@query(f"with {STORE_SQL} select t.*, coalesce(title, t.rule_id) as rule_title, coalesce(description, '') as rule_description from (select rule_id, {_PIVOT} from findings where run_id = '{RUN}' and file_path ilike 'src/app/%' group by 1 order by total desc, rule_id limit 10) t left join rules r on r.rule_id = t.rule_id")
def drilldown_rules(spark, sf_dir):
    return ro.drilldown_rules(sv.findings(spark, sf_dir), catalog.builtin(spark), RUN, "src/app")


# --- catalogue and gates --------------------------------------------------------------------------


@query(f"with {RULES_SQL}, own as (select 'HYGIENE.fixme' as rule_id, 'mine' as title, 'Info' as default_severity, '' as description union all select 'custom.' || p_brand, 'custom', 'Error', '' from part group by p_brand) select * from own union all select * from rules where lower(rule_id) not in (select lower(rule_id) from own)")
def merged_catalog(spark, sf_dir):
    from ..sources.driver_tables import table

    own = spark.createDataFrame([("HYGIENE.fixme", "mine", "Info", "")], "rule_id string, title string, default_severity string, description string")
    brands = table(spark, sf_dir, "part").select(F.concat(F.lit("custom."), "p_brand").alias("rule_id"), F.lit("custom").alias("title"), F.lit("Error").alias("default_severity"), F.lit("").alias("description")).distinct()
    return catalog.first_wins(own.unionByName(brands), catalog.builtin(spark))


@query(f"with {FINDINGS_SQL} select min({_RANK}) as rank from findings where run_id = '{RUN}' and rule_id like 'churn.%'")
def worst_severity(spark, sf_dir):
    return ro.worst(sv.findings(spark, sf_dir).where(f"run_id = '{RUN}' and rule_id like 'churn.%'"))


@query(
    f"with {FINDINGS_SQL}, f as (select * from findings where run_id = '{RUN}') (select 'severity' as kind, severity as name, count(*) as n from f group by 2) union all "
    "(select 'file', file_path, count(*) as n from f group by 2 order by n desc, 2 limit 10) union all (select 'rule', rule_id, count(*) as n from f group by 2 order by n desc, 2 limit 10)"
)
def console_summary(spark, sf_dir):
    return ro.console_summary(sv.findings(spark, sf_dir).where(f"run_id = '{RUN}'"))


