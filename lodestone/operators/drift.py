"""Configuration drift between environments, and the matrix that shows it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..sources import structured
from .portability import _json, fingerprint

# fixed values
ENVIRONMENTS = ("dev", "development", "test", "qa", "stage", "staging", "prod", "production", "uat")
#: How a value that is a token and nothing else begins and ends.
TOKENS = (("${", "}"), ("$(", ")"), ("{{", "}}"), ("%", "%"), ("@Microsoft.KeyVault(", ")"))


def environment_files(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """``files(path)`` that are named for an environment, with ``folder, base, env, ext``: by the user's ``pattern`` (base, environment, extension), else by the part before the extension."""
    name = F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1)
    parts = F.filter(F.transform(F.split(name, "[.]"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(parts)
    named = (n >= 3) & F.lower(F.get(parts, n - 2)).isin(*ENVIRONMENTS)
    told = {"base": F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), "."), "env": F.get(parts, n - 2), "ext": F.get(parts, n - 1)}
    for i, c in enumerate(told, 1):
        value = F.when(named, told[c])
        if pattern:
            value = F.when(name.rlike(pattern), F.regexp_extract(name, pattern, i)).otherwise(value)
        files = files.withColumn(c, value if c == "base" else F.lower(value))
    return files.withColumn("folder", fn.directory(F.col("path"))).where("env is not null")


def parameterised(value) -> F.Column:
    """A token and nothing else, or a reference to a vault."""
    text = F.trim(value)
    inner = lambda a, z: F.substring(text, F.lit(len(a) + 1), F.char_length(text) - len(a) - len(z))
    tests = [F.lower(text).startswith(a.lower()) & text.endswith(z) & (F.char_length(text) > len(a) + len(z)) & ~F.contains(inner(a, z), F.lit(z[0])) for a, z in TOKENS]
    vault = F.contains(F.lower(text), F.lit("keyvault")) | F.contains(F.lower(text), F.lit("vault.azure.net"))
    return F.coalesce(reduce(lambda a, b: a | b, tests, vault), F.lit(False))


def settings(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """``files(path, text)`` -> ``(config_set, path, env, key, value)`` of the JSON and YAML files named for an environment; files that cannot be read are left out."""
    own = environment_files(files, pattern).select("path", "text", F.concat_ws("/", F.lower("folder"), F.lower("base"), F.lower("ext")).alias("config_set"), "base", "env", "ext")
    flat = structured.flatten(own.select("path", "text")).where("error is null")
    return flat.drop("error").join(own.drop("text"), "path")


def groups(rows: DataFrame) -> DataFrame:
    """``(config_set, path, env, key, value)`` -> a row for each set and key, keys without case, in sets of two files or more."""
    sets = rows.groupBy("config_set").agg(F.countDistinct("path").alias("files"), F.array_sort(F.collect_set("env")).alias("environments")).where("files > 1").select("config_set", "environments")
    one = F.struct("path", "env", "value", "key")
    g = rows.groupBy("config_set", F.lower("key").alias("lower_key")).agg(F.array_sort(F.collect_list(one)).alias("at"))  # a row for each file of a set
    out = g.join(sets, "config_set").withColumn("key", F.get("at", F.lit(0))["key"]).withColumn("present", F.array_sort(F.array_distinct(F.transform("at", lambda x: x["env"]))))
    return out.withColumn("missing", F.array_except("environments", "present"))


def findings(rows: DataFrame) -> DataFrame:
    """Keys of one environment only; keys missing in some, a finding for each; keys whose values differ and are not all parameters."""
    g = groups(rows).withColumn("path", F.get("at", F.lit(0))["path"])
    values = F.array_distinct(F.transform("at", lambda x: F.trim(x["value"])))
    fixed = F.exists("at", lambda x: ~parameterised(x["value"]))
    hit = lambda rule, missing, differs, sure: F.struct(F.lit(rule).alias("rule_id"), missing.alias("without"), F.lit(differs).alias("differs"), F.lit(sure).alias("confidence"))
    none = F.array().cast("array<string>")
    lone = F.size("present") == 1
    gone = F.transform("missing", lambda e: hit("config.drift.missing_key", F.array(e), False, "High"))
    differ = F.when((F.size(values) >= 2) & fixed, F.array(hit("config.drift.hardcoded_env_value", none, True, "Medium"))).otherwise(F.slice(gone, 1, 0))
    hits = F.when(lone, F.array(hit("config.drift.orphan_key", F.col("missing"), False, "High"))).otherwise(F.concat(gone, differ))
    out = g.withColumn("h", F.explode(hits)).select("*", "h.*")
    preview = F.when(F.col("differs"), F.transform("at", lambda x: F.struct(x["env"].alias("Environment"), F.when(F.char_length(F.trim(x["value"])) > 32, F.concat(F.substring(F.trim(x["value"]), 1, 32), F.lit("..."))).otherwise(F.trim(x["value"])).alias("Value"))))
    told = _json(engine="config-drift", key=F.col("key"), configSet=F.col("config_set"), environments=F.col("environments"), presentEnvironments=F.col("present"), missingEnvironments=F.col("without"), valueDiffers=F.col("differs"), valuePreviews=preview)
    return out.select(
        "path", "rule_id", F.lit(1).alias("line"), F.lit(1).alias("column"), F.concat(F.lit("Key '"), "key", F.lit("' drifts.")).alias("message"), F.lit(None).cast("string").alias("snippet"), F.lit("Warning").alias("severity"), "confidence",
        fingerprint(F.col("rule_id"), F.col("path"), F.col("key"), F.array_join("present", "|"), F.array_join("without", "|")).alias("fingerprint"), told.alias("metadata"),
    )


def matrix(found: DataFrame, config_set: str = "", search: str = "", issues_only: bool = False) -> DataFrame:
    """Drift findings, read by their metadata -> ``(config_set, key, env, state)``: missing before differs before present; sensitive previews are hidden."""
    shape = "struct<key:string,configSet:string,environments:array<string>,presentEnvironments:array<string>,missingEnvironments:array<string>,valueDiffers:boolean,valuePreviews:array<struct<Environment:string,Value:string>>>"
    m = found.where(F.col("rule_id").startswith("config.drift.")).select(F.from_json("metadata", shape).alias("m")).select("m.*").where("key is not null and configSet is not null")
    place = F.struct(F.lit(None).cast("string").alias("Environment"), F.lit(None).cast("string").alias("Value"))
    cells = m.select("configSet", "key", "presentEnvironments", "missingEnvironments", "valueDiffers", F.coalesce("valuePreviews", F.slice(F.array(place), 1, 0)).alias("shown"), F.explode("environments").alias("env"))
    has = lambda c: F.array_contains(c, F.col("env"))
    value = F.get(F.transform(F.filter("shown", lambda x: x["Environment"] == F.col("env")), lambda x: x["Value"]), F.lit(0))
    rank = F.when(has("missingEnvironments"), 2).when(F.col("valueDiffers") & has("presentEnvironments"), 1).when(has("presentEnvironments"), 0)
    g = cells.select("configSet", "key", "env", rank.alias("rank"), fn.redacted(F.col("key"), value).alias("preview")).where("rank is not null")
    out = g.groupBy(F.col("configSet").alias("config_set"), "key", "env").agg(F.max("rank").alias("rank"), F.max("preview").alias("preview"))
    out = out.select("config_set", "key", "env", F.get(F.array(F.lit("present"), F.lit("differs"), F.lit("missing")), F.col("rank")).alias("state"), "preview")
    if config_set.strip():
        out = out.where(F.lower("config_set") == config_set.strip().lower())
    if search.strip():
        out = out.where(F.lower("key").contains(search.strip().lower()))
    if issues_only:
        bad = out.where("state <> 'present'").select("config_set", "key").distinct()
        out = out.join(bad, ["config_set", "key"], "left_semi")
    return out.orderBy(F.upper("config_set"), F.upper("key"), "env")
