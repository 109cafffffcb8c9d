"""Registered queries over text, lines of code, settings, versions and suppressions, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import health as he
from ..operators import history as ho
from ..operators import lines as lo
from ..operators import portability as po
from ..operators import text as to
from ..sources.code_views import CODE_SQL, code_files
from ..sources.driver_tables import COMMITS_SQL, FINDINGS_SQL, TREE_SQL, commits, findings, table, tree
from .catalogue import _PIVOT, KINDS, NOW, _now, query

_STOPS = ", ".join(f"'{w}'" for w in fn.STOP_WORDS)


@query("select doc_id, round(coalesce(list_aggregate(string_split(text, ''), 'entropy'), 0.0), 5) as entropy from documents")
def entropy_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(fn.entropy(F.col("text")), 5).alias("entropy"))


@query(
    "with w as (select doc_id, text, regexp_extract_all(lower(text), '[a-z]{2,}') as words from documents) "
    f"select doc_id, coalesce(len(words) >= 3 and regexp_matches(text, '[.,;:!?]') and len(list_filter(words, lambda x: x in ({_STOPS}))) / greatest(len(words), 1) >= 0.35, false) as prose from w"
)
def natural_language_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.natural_language(F.col("text")).alias("prose"))


@query(
    f"with {COMMITS_SQL}, g as (select path as key, list_distinct(list(kind)) as envs, count(distinct lines % 50) as n from commits group by 1), "
    "r as (select key, case when len(envs) = 1 then [{'rule_id': 'drift.orphan', 'env': envs[1]}] else list_concat("
    + f"list_transform(list_filter({list(KINDS)!r}, lambda e: not list_contains(envs, e)), lambda e: {{'rule_id': 'drift.missing', 'env': e}}), "
    + "case when n >= 2 then [{'rule_id': 'drift.differs', 'env': cast(null as varchar)}] else [] end) end as hits from g), u as (select key, unnest(hits) as h from r) select key, h.rule_id as rule_id, h.env as env from u"
)
def config_drift(spark, sf_dir):
    return he.config_drift(commits(spark, sf_dir).select(F.col("path").alias("key"), F.col("kind").alias("env"), (F.col("lines") % 50).cast("string").alias("value")), KINDS)


@query(f"with {FINDINGS_SQL} select rule_id, count(*) filter (where line % 5 <> 0) as active, count(*) filter (where line % 5 = 0) as suppressed, count(*) as total from findings group by 1")
def suppression_by_rule(spark, sf_dir):
    return he.suppression_overview(findings(spark, sf_dir), F.col("line") % 5 == 0)


@query(f"with {FINDINGS_SQL} select count(*) filter (where line % 5 <> 0) as active, count(*) filter (where line % 5 = 0) as suppressed, count(*) as total from findings")
def suppression_overview(spark, sf_dir):
    f = suppression_by_rule(spark, sf_dir)
    return f.agg(*[F.sum(c).alias(c) for c in ("active", "suppressed", "total")])


_CUSTOM = (("x.notice", r"[Cc]opyright\s+[^\n]{1,40}", ("en", "de")), ("x.phone", r"\d{3}-\d{4}", ("en", "fr", "es", "de")))


@query("select * from (" + " union all ".join(f"select doc_id as file_id, '{i}' as rule_id, len(regexp_extract_all(text, '{p}')) as matches from documents where lang in ({', '.join(repr(x) for x in c)})" for i, p, c in _CUSTOM) + ") where matches > 0")
def custom_rules(spark, sf_dir):
    rules = spark.createDataFrame(list(_CUSTOM), "rule_id string, pattern string, categories array<string>")
    return he.custom_rules(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("lang").alias("category"), "text"), rules)


@query(
    f"with {COMMITS_SQL}, a as (select path, author, count(*) as n, max(ts) as newest from commits group by 1, 2), r as (select *, row_number() over (partition by path order by n) as i, count(*) over (partition by path) as m from a), "
    "c as (select path, round(case when max(m) = 1 then 1.0 else greatest(0.0, least(1.0, 2.0 * cast(sum(i * n) as double) / (max(m) * cast(sum(n) as double)) - (max(m) + 1.0) / max(m))) end, 6) as concentration from r group by 1), "
    "t as (select * from a qualify row_number() over (partition by path order by n desc, newest desc, author) = 1) "
    f"select path, cast(author as varchar) as author, concentration from t join c using (path) where concentration > 0.1 and epoch_us(timestamp '{NOW}') - epoch_us(newest) > 3 * 86400000000"
)
def churn_ownership(spark, sf_dir):
    c = commits(spark, sf_dir)
    return he.ownership_risk(c, ho.gini(c), _now(), least=0.1, idle_days=3)


@query(f"with {FINDINGS_SQL} select file_path, count(*) as total, count(*) filter (where starts_with(rule_id, 'S')) as of_prefix from findings group by 1")
def heatmap_files(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("file_path").agg(F.count("*").alias("total"), F.count_if(F.col("rule_id").startswith("S")).alias("of_prefix"))


@query(f"with {FINDINGS_SQL} select row_number() over (order by run_id desc, file_path, line, severity, confidence) as place, run_id, file_path, line, severity, confidence from findings where rule_id = (select min(p_type) from part) order by 1 limit 500")
def rule_history(spark, sf_dir):
    from pyspark.sql import Window

    rule = table(spark, sf_dir, "part").agg(F.min("p_type").alias("rule_id"))
    f = findings(spark, sf_dir).join(F.broadcast(rule), "rule_id")  # one row by definition
    order = [F.desc("run_id"), "file_path", "line", "severity", "confidence"]
    top = f.orderBy(*order).limit(500)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), "run_id", "file_path", "line", "severity", "confidence")


@query(
    f"with {TREE_SQL}, up as (select array_to_string(list_slice(string_split(path, '/'), 1, n), '/') as node, n as depth, n = 4 as leaf, size from tree, range(1, 5) t(n)) "
    "select node, cast(depth as int) as depth, leaf, cast(sum(size) as bigint) as size from up group by 1, 2, 3"
)
def treemap_nodes(spark, sf_dir):
    parts = F.split("path", "/")
    up = tree(spark, sf_dir).select("size", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    return up.groupBy(F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("node"), "depth", (F.col("depth") == F.size("parts")).alias("leaf")).agg(F.sum("size").alias("size"))


_CODE_LINES = f"{CODE_SQL}, rows as (select path as file_id, line, content from code)"


def _code(spark, sf_dir):
    return code_files(spark, sf_dir).select(F.col("path").alias("file_id"), "text")


def _code_lines(spark, sf_dir):
    return to.lines(_code(spark, sf_dir))


@query(f"with {_CODE_LINES}, hits as (select file_id, line, content, unnest(regexp_extract_all(content, '{po.IPV4}')) as value from rows) select file_id, line, value, strpos(content, value) as at from hits")
def text_scan_positions(spark, sf_dir):
    rows = _code_lines(spark, sf_dir).select("file_id", "line", F.explode(po.spots(F.col("content"), po.IPV4)).alias("s"))
    return rows.select("file_id", "line", "s.value", F.col("s.column").cast("long").alias("at"))


@query(
    f"with {_CODE_LINES}, n as (select file_id, line, sum(2 * length(content) - length(replace(content, '{{', '')) - length(content) - (length(content) - length(replace(content, '}}', '')))) over w as total from rows window w as (partition by file_id order by line)) "
    "select file_id, line, cast(total - least(0, min(total) over (partition by file_id order by line)) as bigint) as depth from n"
)
def brace_scope(spark, sf_dir):
    return lo.by_file(_code(spark, sf_dir), lo.depths, "depth long")


@query(f"with {CODE_SQL} select path as file_id, line, length(regexp_extract(content, '^( *)', 1)) as indent from code where language = 'python'")
def indent_scope(spark, sf_dir):
    rows = to.lines(code_files(spark, sf_dir).where("language = 'python'").select(F.col("path").alias("file_id"), "text"))
    return rows.select("file_id", "line", lo.indent(F.col("content")).cast("long").alias("indent"))


@query(f"with {_CODE_LINES} select file_id, line, max(contains(content, 'GetEnvironmentVariable(')) over (partition by file_id order by line rows between 5 preceding and 5 following) as near from rows")
def nearby_marker(spark, sf_dir):
    return lo.by_file(_code(spark, sf_dir), lambda lines: lo.within(["GetEnvironmentVariable(" in x for x in lines]), "near boolean")


@query(f"with {_CODE_LINES} select file_id, line, contains(content, 'lodestone: ignore') or coalesce(contains(lag(content) over (partition by file_id order by line), 'lodestone: ignore'), false) as suppressed from rows")
def line_suppressions(spark, sf_dir):
    def told(lines):
        own = ["lodestone: ignore" in x for x in lines]
        return [a or b for a, b in zip(own, [False, *own], strict=False)]

    return lo.by_file(_code(spark, sf_dir), told, "suppressed boolean")


_VERSION = "['', '>=', '^', '~'][p_size % 4 + 1] || p_size % 9 || case when p_size % 5 = 0 then '.x' when p_size % 5 = 1 then '' else '.' || p_size || '.' || p_partkey % 7 end"


def _weight_sql(v: str) -> str:
    token = f"regexp_replace(trim({v}), '^[=~^<>\\s]+', '')"
    part = lambda i: f"try_cast(regexp_extract(split_part({token}, '.', {i}), '^(\\d+)', 1) as double)"
    term = lambda i, w: f"case when split_part({token}, '.', {i}) = '' then 0 else {part(i)} * {w} end"
    return f"({part(1)} + {term(2, 0.01)} + {term(3, 0.0001)})"


@query(f"with v as (select p_partkey, {_VERSION} as version from part) select p_partkey, version, round(greatest(0.0, coalesce({_weight_sql("'7.5'")} - {_weight_sql('version')}, 0.0)), 6) as staleness from v")
def version_staleness(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    rest = F.when(n % 5 == 0, ".x").when(n % 5 == 1, "").otherwise(F.concat(F.lit("."), n.cast("string"), F.lit("."), (k % 7).cast("string")))
    version = F.concat(F.element_at(F.array(F.lit(""), F.lit(">="), F.lit("^"), F.lit("~")), (n % 4 + 1).cast("int")), (n % 9).cast("string"), rest)
    return table(spark, sf_dir, "part").select("p_partkey", version.alias("version")).select("*", F.round(fn.staleness(F.col("version"), F.lit("7.5")), 6).alias("staleness"))


@query(f"with {FINDINGS_SQL} select case when starts_with(rule_id, 'S') then 'standard' when starts_with(rule_id, 'P') then 'promo' else 'other' end as artifact, {_PIVOT} from findings group by 1")
def artifact_severity_summary(spark, sf_dir):
    from ..operators import findings as fo

    kind = F.when(F.col("rule_id").startswith("S"), "standard").when(F.col("rule_id").startswith("P"), "promo").otherwise("other")
    return fo.pivot_by(findings(spark, sf_dir).withColumn("artifact", kind), "artifact")
