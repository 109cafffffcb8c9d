"""Deployment artifacts: their kind, and rules over the scalars of their JSON or YAML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import structured
from .portability import GUID, _json, any_of, default_severity, fingerprint

# fixed values
EV2_MARKERS = ("/ev2/", "/rollout", "/service-model", "/servicemodel", "/bindings/")
ADO_MARKERS = ("/azure-pipelines", "/pipelines/", "/ado/", "/.azuredevops/", "/build/")
EV2_WORDS, ADO_WORDS = ("rolloutSpec", "serviceModel", "waitDuration"), ("trigger:", "stages:", "pool:", "variables:")
ENVIRONMENTS = ("dev", "development", "test", "staging", "prod", "production")
CLOUD = ("windows.net", "azure.com", "core.windows.net", "database.windows.net", "microsoftonline.com")
REGIONS = ("eastus", "eastus2", "westus", "westus2", "westus3", "centralus", "northcentralus", "southcentralus", "westeurope", "northeurope", "uksouth", "ukwest", "southeastasia", "eastasia")
SECRETS = ("secret", "password", "token", "clientsecret", "apikey", "accesskey", "key")
PARAMETERS = ("$(", "${", "{{", "#{")
WINDOWS_PATH = r"[A-Za-z]:\\|\\\\"


def kind(path, text) -> F.Column:
    """``Ev2``, ``Ado`` or ``Unknown``: by markers in the path, then by words in a structured text."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    has = lambda c, words: c.rlike("(?i)" + any_of(words))
    structured_ = F.lower(path).rlike(r"\.(ya?ml|json)$") & (F.trim(F.coalesce(text, F.lit(""))) != "")
    return F.when(has(p, EV2_MARKERS), "Ev2").when(has(p, ADO_MARKERS), "Ado").when(structured_ & has(text, EV2_WORDS), "Ev2").when(structured_ & has(text, ADO_WORDS), "Ado").otherwise("Unknown")


def parameter(value) -> F.Column:
    """Whether a value is, or holds, a parameter."""
    return F.coalesce(value.rlike("|".join(any_of([p]) for p in PARAMETERS)) | F.lower(value).contains("[parameters("), F.lit(False))


def _finding(rows: DataFrame, rule, line, column, snippet, at, value, mode: str, error, message=None) -> DataFrame:
    text = message if message is not None else F.concat(F.lit("'"), value, F.lit("' at "), at, F.lit("."))
    return rows.select(
        "path", rule.alias("rule_id"), F.greatest(F.lit(1), line).cast("int").alias("line"), F.greatest(F.lit(1), column).cast("int").alias("column"), text.alias("message"), snippet.alias("snippet"),
        default_severity(rule).alias("severity"), F.lit("High" if mode == "structured" else "Medium").alias("confidence"), fingerprint(rule, F.col("path"), at, value).alias("fingerprint"),
        _json(engine="artifact-structured", parserMode=mode, artifactPath=at, matchedValue=value, parserError=error).alias("metadata"),
    )


def scalar_rules() -> F.Column:
    """The rules that a scalar breaks, from ``kind, at, key, value``; rows without a value break none."""
    key, at, value = F.lower(F.coalesce("key", F.lit(""))), F.lower("at"), F.col("value")
    said = lambda word: key.contains(word) | at.contains(word)
    fixed, guid = ~parameter(value), value.rlike(f"^{GUID}$")
    secret, low = key.rlike("(?i)" + any_of(SECRETS) + "$"), F.lower(value)
    vault = low.rlike("keyvault|kv://|secretref")
    secure = F.contains(value, F.lit("$(")) | F.contains(value, F.lit("${{")) | low.rlike(r"variables\[|keyvault")
    latest = low.contains(":latest") & ~low.contains("@sha256:")
    windows = value.rlike(WINDOWS_PATH)
    ev2 = {
        "hardcoded.subscription": said("subscription") & guid & fixed, "hardcoded.tenant": said("tenant") & guid & fixed, "hardcoded.endpoint": low.rlike(any_of(CLOUD)) & fixed,
        "hardcoded.region": said("region") & low.isin(*REGIONS) & fixed, "zero_bake_time": (key.contains("waitduration") | key.contains("wait_duration")) & (F.upper(value) == "PT0S"),
        "inline_secret": secret & ~vault & fixed, "env_constant": (key.contains("environment") | (key == "env")) & low.isin(*ENVIRONMENTS) & fixed,
    }
    ado = {
        "hardcoded.agentpool": (key.isin("pool", "name") | at.contains(".pool")) & at.contains("pool") & fixed, "hardcoded.path": (key.contains("path") | (key == "script")) & windows & fixed,
        "hardcoded.endpoint": (key.contains("serviceconnection") | key.contains("endpoint") | key.contains("connectedservicename")) & fixed, "inline_secret": secret & ~secure & fixed,
        "platform_assumption": ((key == "script") | key.contains("powershell") | key.contains("bash")) & windows, "container_latest": ((key == "image") | key.contains("container") | (key == "script")) & latest,
    }
    named = [F.when((F.col("kind") == k) & t, f"deploy.{k.lower()}.{r}") for k, rules in (("Ev2", ev2), ("Ado", ado)) for r, t in rules.items()]
    return F.when(F.trim(F.coalesce("value", F.lit(""))) != "", F.filter(F.array(*named), lambda x: x.isNotNull()))


def file_rules(scalars: DataFrame) -> DataFrame:
    """``(path, rule_id, value)``: what a whole artifact lacks, from ``path, kind, at, key, value``."""
    key, at, low = F.lower(F.coalesce("key", F.lit(""))), F.lower("at"), F.lower(F.coalesce("value", F.lit("")))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    region = F.when((key.contains("region") | at.contains("region")) & (F.trim("value") != ""), F.lower("value"))
    g = scalars.groupBy("path", "kind").agg(
        any_(key.contains("waitduration") | at.contains("waitduration")).alias("waits"), any_(key.contains("health") | at.contains("health")).alias("health"),
        F.countDistinct(region).alias("regions"), F.min(F.when(region.isNotNull(), F.col("value"))).alias("region"),
        any_((key == "stage") & low.contains("prod")).alias("prod"), any_(at.contains("approval") | at.contains("check") | key.contains("approval")).alias("approval"),
    )
    hit = lambda when, rule, value: F.when(when, F.struct(F.lit(rule).alias("rule_id"), value.alias("value")))
    ev2 = F.col("kind") == "Ev2"
    hits = F.array(
        hit(ev2 & ~F.col("waits"), "deploy.ev2.zero_bake_time", F.lit("missing WaitDuration")), hit(ev2 & ~F.col("health"), "deploy.ev2.no_health_check", F.lit("missing health checks")),
        hit(ev2 & (F.col("regions") == 1), "deploy.ev2.single_region", F.col("region")), hit((F.col("kind") == "Ado") & F.col("prod") & ~F.col("approval"), "deploy.ado.missing_approval", F.lit("production stage without approval")),
    )
    return g.select("path", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).select("path", "h.*")


def line_value(line) -> F.Column:
    """What stands after the first colon, or equals sign, of a line."""
    after = F.when(line.rlike(":."), F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).when(line.rlike("=."), F.regexp_extract(line, "^[^=]*=(.*)$", 1)).otherwise(line)
    return F.regexp_replace(F.trim(after), r"^[\"'\[\],]+|[\"'\[\],]+$", "")


def text_fallback(files: DataFrame) -> DataFrame:
    """Findings from the lines of artifacts ``files(path, kind, text, error)`` that are not structured or cannot be parsed."""
    rows = files.select("path", "kind", "error", F.posexplode(F.split("text", "\n", -1)).alias("i", "raw")).withColumn("raw", F.regexp_replace("raw", r"\r$", "")).withColumn("t", F.trim("raw"))
    rows = rows.where("t <> '' and t not like '#%'").withColumn("value", line_value(F.col("t")))
    low, guid = F.lower("t"), F.col("value").rlike(f"^{GUID}$")
    hit = lambda k, when, rule, value=None: F.when((F.col("kind") == k) & when, F.struct(F.lit(rule).alias("rule_id"), (F.col("value") if value is None else F.lit(value)).alias("hit")))
    hits = F.array(
        hit("Ev2", low.contains("subscription") & guid, "deploy.ev2.hardcoded.subscription"), hit("Ev2", low.contains("tenant") & guid, "deploy.ev2.hardcoded.tenant"),
        hit("Ev2", low.contains("waitduration") & low.contains("pt0s"), "deploy.ev2.zero_bake_time", "PT0S"), hit("Ado", low.contains("pool") & ~parameter(F.col("value")), "deploy.ado.hardcoded.agentpool"),
        hit("Ado", low.contains(":latest"), "deploy.ado.container_latest"),
    )
    found = rows.select("path", "error", (F.col("i") + 1).alias("line"), "raw", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).select("path", "error", "line", "raw", "h.*")
    return _finding(found, F.col("rule_id"), F.col("line"), F.lit(1), F.col("raw"), F.lit("$[line]"), F.col("hit"), "fallback", F.col("error"))


def keep_last(findings: DataFrame) -> DataFrame:
    """One finding for each rule and fingerprint, without case: the last in the file."""
    last = F.max(F.struct("line", "column", *[c for c in findings.columns if c not in ("line", "column")])).alias("r")
    return findings.groupBy(F.lower("rule_id").alias("__r"), F.lower("fingerprint").alias("__f")).agg(last).select(*[F.col(f"r.{c}").alias(c) for c in findings.columns])


def analyse(files: DataFrame) -> DataFrame:
    """Findings of the deployment artifacts among ``files(path, text)``."""
    own = files.withColumn("kind", kind(F.col("path"), F.col("text"))).where("kind <> 'Unknown'").select("path", "kind", "text")
    kinds = own.select("path", "kind")
    s = structured.scalars(own).join(kinds, "path")
    good, bad = s.where("error is null"), s.where("error is not null")
    told = good.withColumn("rule_id", F.explode(scalar_rules()))
    out = _finding(told, F.col("rule_id"), F.col("line"), F.col("column"), F.col("value"), F.col("at"), F.col("value"), "structured", F.lit(None).cast("string"))
    # an artifact without a single scalar lacks things as well
    parsed = own.where(F.lower("path").rlike(r"\.(json|ya?ml)$")).join(bad.select("path"), "path", "left_anti").select("path", "kind")
    whole = file_rules(good.select("path", "kind", "at", "key", "value").unionByName(parsed.withColumn("at", F.lit("$")).withColumn("key", F.lit(None).cast("string")).withColumn("value", F.lit(None).cast("string"))))
    none = F.lit(None).cast("string")
    out = out.unionByName(_finding(whole, F.col("rule_id"), F.lit(1), F.lit(1), none, F.lit("$"), F.col("value"), "structured", none))
    texts = own.join(bad.select("path", "error", "line", "column"), "path")
    snippet = F.regexp_replace(F.get(F.split("text", "\n", -1), F.greatest(F.col("line"), F.lit(1)) - 1), r"\r$", "")
    out = out.unionByName(_finding(texts, F.lit("deploy.artifact.parse_error"), F.col("line"), F.col("column"), snippet, F.lit("$"), F.col("error"), "structured", F.col("error"), F.concat(F.lit("Cannot be parsed: "), F.col("error"))))
    rest = own.where(~F.lower("path").rlike(r"\.(json|ya?ml)$")).withColumn("error", none)
    out = out.unionByName(text_fallback(texts.select("path", "kind", "text", "error").unionByName(rest.select("path", "kind", "text", "error"))))
    return keep_last(out)
