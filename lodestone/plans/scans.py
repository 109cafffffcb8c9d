"""Detectors and scans over files made of the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from ..operators import portability as po
from ..sources import code_views as cv
from ..sources.code_views import CODE_SQL
from .catalogue import query

_ERRORS = ", ".join(f"'{r}'" for r, s in catalog.RULES.items() if s == "Error")
_DEFAULT = f"case when rule_id in ({_ERRORS}) then 'Error' else 'Warning' end"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list_of(values) -> str:
    return ", ".join(_quoted(x) for x in values)


_IS_IPV4 = "len(list_filter(string_split(x, '.'), lambda p: coalesce(try_cast(p as int) <= 255, false))) = 4 and len(string_split(x, '.')) = 4"
_IN_CLOUD = "(" + " or ".join(f"x like '%.{d}'" for d in po.CLOUD_DOMAINS) + ")"
_DRIVES, _ROOTS = f"(?:^|[^{po._NO_WORD}])({po._DRIVE_OR_SHARE})", f"(?:^|[^{po._NO_PATH}])({po._ROOTED})"
_ID = f"(?i){po.any_of(po.ID_KEYWORDS)}"


def _literal_rules(value: str) -> str:
    """A list of the rules of a value."""
    every = lambda p, v=value: f"regexp_extract_all({v}, {_quoted(p)})"
    some = lambda rows, test: f"len(list_filter({rows}, lambda x: {test})) > 0"
    ips, hosts = f"list_filter({every(po.DOTTED)}, lambda x: {_IS_IPV4})", every(po.HOST, f"lower({value})")
    tests = (
        f"(len({ips}) > 0 and {ips}[1] not in ('0.0.0.0', '127.0.0.1'))", some(hosts, _IN_CLOUD), f"regexp_matches({value}, {_quoted(_DRIVES)})", f"regexp_matches({value}, {_quoted(_ROOTS)})",
        f"(regexp_matches({value}, {_quoted(po.GUID)}) and regexp_matches({value}, {_quoted(_ID)}))", some(every(po.WORD, f"lower({value})"), f"x in ({_list_of(po.REGIONS)})"), some(hosts, f"x in ({_list_of(po.ENDPOINTS)})"),
        some(f"string_split({value}, ';')", f"contains(x, '=') and lower(trim(split_part(x, '=', 1))) in ({_list_of(po.SECRET_KEYS)})"), f"contains(lower({value}), 'localhost')", "(" + " or ".join(f"contains(upper({value}), 'HKEY_{h}\\')" for h in po.HIVES) + ")",
    )
    return "list_filter([" + ", ".join(f"case when {t} then '{r}' end" for r, t in zip(po.LITERAL_RULES, tests, strict=True)) + "], lambda x: x is not null)"


def _each_text_rule(rows: str) -> str:
    tests = (
        (po.DOTTED, 0, f"{_IS_IPV4} and x not in ('0.0.0.0', '127.0.0.1')"), (po.HOST, 0, _IN_CLOUD.replace("x like", "lower(x) like")), (_DRIVES, 1, "true"), (_ROOTS, 1, "category = 'Source'"),
        (po.GUID, 0, f"regexp_matches(content, {_quoted('(?i)' + po._ID_WORD + '.*')} || x)"), (po.WORD, 0, f"lower(x) in ({_list_of(po.REGIONS)})"), (po.HOST, 0, f"lower(x) in ({_list_of(po.ENDPOINTS)})"),
    )
    parts = [
        f"select path, line, content, '{r}' as rule_id, x as value from (select path, category, line, content, unnest(regexp_extract_all(content, {_quoted(p)}, {g})) as x from {rows}) where {test}" for r, (p, g, test) in zip(po.TEXT_RULES, tests, strict=True)
    ]
    return " union all ".join(parts)


_TEXT = f"select path, rule_id, line, value, {_DEFAULT} as severity, 'Medium' as confidence from ({_each_text_rule('code')})"


def _short(findings, value="matchedValue"):
    return findings.select("path", "rule_id", "line", F.get_json_object("metadata", f"$.{value}").alias("value"), "severity", "confidence")


@query(f"with {CODE_SQL} {_TEXT}")
def portability_text(spark, sf_dir):
    return _short(po.text_findings(cv.code_files(spark, sf_dir)))


_SEVERITY = f"case when is_test then 'Info' else {_DEFAULT} end"
_MARK = "lower(regexp_extract(content, '(?i)lodestone:\\s*ignore\\s+([a-z0-9.-]+)', 1))"
_SPARED = f"spared as (select *, {_MARK} as own, coalesce(lag({_MARK}) over (partition by path order by line), '') as above from tested)"


def _call(language: str) -> str:
    return "case " + " ".join(f"when language = '{language}' and contains(content, {_quoted(t)}) then {_quoted(t)}" for t in po.CALLS[language]) + " end"


_CALL = "coalesce(" + ", ".join(_call(x) for x in po.CALLS) + ")"
_LITERALS = f"""calls as (select *, {_CALL} as call from spared where category = 'Source' and language in ('cpp', 'python', 'rust')),
raw as (select *, unnest(regexp_extract_all(content, {_quoted(po.QUOTED)})) as quoted from calls),
named as (select *, unnest({_literal_rules("quoted[2:-2]")}) as rule_id from raw)"""


@query(
    f"with {CODE_SQL}, {_SPARED}, {_LITERALS}, ports as (select *, unnest(regexp_extract_all(content, '\\b[1-9][0-9]{{1,4}}\\b')) as port from calls where call is not null) "
    f"select path, rule_id, line, coalesce(call, 'unknown') as value, {_SEVERITY} as severity, case when call is null then 'Medium' else 'High' end as confidence from named where rule_id not in (own, above) "
    f"union all select path, 'portability.hardcoded.port', line, call, case when is_test then 'Info' else 'Warning' end, 'High' from ports where cast(port as int) between 1 and 65535 and port not in ('22', '80', '443') and 'portability.hardcoded.port' not in (own, above)"
)
def portability_lines(spark, sf_dir):
    return _short(po.line_findings(cv.code_files(spark, sf_dir)), "callsite")


_NEAR = "near as (select *, max(contains(content, 'GetEnvironmentVariable(')) over (partition by path order by line rows between 5 preceding and 5 following) as near_config from spared where language = 'csharp')"
#: Of each C# template with a hit: its rules, the call and the confidence, as read by a person.
_CS = (
    ("new Uri(", ("ipv4",), "Uri", "High"), ("Server=db", ("connectionstring",), "literal", "High"), ("client.Connect(", ("localhost",), "client.Connect", "High"),
    ("C:\\", ("filepath.windows",), "literal", "Medium"), ("[Route(", ("endpoint", "dns"), "Route", "High"), ("region eastus2", ("region",), "log.Write", "Medium"),
)
_CS_SQL = " union all ".join(f"select path, 'portability.hardcoded.{r}' as rule_id, line, '{call}' as value, is_test, near_config, own, above, '{c}' as confidence from near where contains(content, {_quoted(t)})" for t, rules, call, c in _CS for r in rules)


@query(
    f"with {CODE_SQL}, {_SPARED}, {_NEAR}, hits as ({_CS_SQL}) select path, rule_id, line, value, case when is_test or near_config then 'Info' else {_DEFAULT} end as severity, confidence from hits where rule_id not in (own, above) "
    "union all select path, 'portability.cloud.sdk.no_abstraction', line, 'new BlobServiceClient', case when is_test then 'Info' else 'Warning' end, 'High' from near where contains(content, 'new BlobServiceClient') "
    "union all select path, 'portability.hardcoded.port', line, 'client.Connect', case when is_test then 'Info' else 'Warning' end, 'High' from near where contains(content, 'client.Connect(') and cast(regexp_extract(content, ', (50[0-9]*)', 1) as int) <= 65535"
)
def portability_csharp(spark, sf_dir):
    return _short(po.csharp_findings(cv.code_files(spark, sf_dir)), "callsite")


_PS = (("Invoke-WebRequest", "Invoke-WebRequest", "ipv4"), ("System.Uri", "New-Object", "localhost"), ("Set-Content", "Set-Content", "filepath.linux"), ("Out-File", "Out-File", "filepath.windows"))


@query(f"with {CODE_SQL} " + " union all ".join(f"select path, 'portability.hardcoded.{r}' as rule_id, line, '{c}' as value, case when is_test then 'Info' else 'Warning' end as severity, 'High' as confidence from tested where language = 'powershell' and contains(content, '{t}')" for t, c, r in _PS))
def portability_powershell(spark, sf_dir):
    return _short(po.powershell_findings(cv.code_files(spark, sf_dir)), "callsite")


_CUSTOM = [
    {"id": "team.todo", "pattern": r"TODO\s+\w+", "message": "Left over", "severity": "Info", "categories": ["Source"], "source": "a.yaml"},
    {"id": "team.zone", "pattern": '"zone": "[a-z]+"', "message": "Zone", "categories": ["Config"]},
    {"id": "team.off", "pattern": ".", "message": "Off", "enabled": False},
]
_SUPPRESSIONS = [{"path": "src/*", "rule": "Portability.Hardcoded.LocalHost"}, {"path": "tools/*", "rule": "portability.hardcoded.ipv4", "fingerprint": "none"}]


@query(
    f"with {CODE_SQL} select path, rule_id, line, value, severity, 'Medium' as confidence from (select path, 'team.todo' as rule_id, line, unnest(regexp_extract_all(content, 'TODO\\s+\\w+')) as value, 'Info' as severity from code where category = 'Source' "
    "union all select path, 'team.zone', line, unnest(regexp_extract_all(content, '\"zone\": \"[a-z]+\"')), 'Warning' from code where category = 'Config')"
)
def portability_custom(spark, sf_dir):
    return _short(po.custom_findings(cv.code_files(spark, sf_dir), _CUSTOM), "match")


_REST = "(select * from code where language in ('go', 'json'))"
_ROUTED = f"""with {CODE_SQL}, {_SPARED}, {_NEAR}, hits as ({_CS_SQL}), {_LITERALS},
ports as (select *, unnest(regexp_extract_all(content, '\\b[1-9][0-9]{{1,4}}\\b')) as port from calls where call is not null),
told as (
  select path, rule_id from hits where rule_id not in (own, above)
  union all select path, 'portability.cloud.sdk.no_abstraction' from near where contains(content, 'new BlobServiceClient')
  union all select path, 'portability.hardcoded.port' from near where contains(content, 'client.Connect(') and cast(regexp_extract(content, ', (50[0-9]*)', 1) as int) <= 65535
  union all select path, rule_id from named where rule_id not in (own, above)
  union all select path, 'portability.hardcoded.port' from ports where cast(port as int) between 1 and 65535 and port not in ('22', '80', '443') and 'portability.hardcoded.port' not in (own, above)
  union all {" union all ".join(f"select path, 'portability.hardcoded.{r}' from tested where language = 'powershell' and contains(content, '{t}')" for t, _, r in _PS)}),
every as (
  select * from told where not (path like 'src/%' and rule_id = 'portability.hardcoded.localhost')
  union all select path, rule_id from ({_each_text_rule(_REST)})
  union all select path, 'team.todo' from code where category = 'Source' and regexp_matches(content, 'TODO\\s+\\w+')
  union all select path, 'team.zone' from code where category = 'Config' and contains(content, '"zone"'))
select path, rule_id, count(*) as n from every group by 1, 2"""


@query(_ROUTED)
def portability_scan(spark, sf_dir):
    return po.analyse(cv.code_files(spark, sf_dir), _SUPPRESSIONS, _CUSTOM).groupBy("path", "rule_id").agg(F.count("*").alias("n"))
