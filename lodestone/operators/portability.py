"""Portability detectors over files: whole-text patterns, literals of several languages, ports, cloud clients.

``files(path, category, language, text)`` -> findings ``(path, rule_id, line, column, message, snippet,
severity, confidence, fingerprint, metadata)``. C# and PowerShell are cut into tokens by
``sources/code_tokens.py``, over whole files; all other work stays in expressions over one row a file, and
a file is opened into lines only if its whole text may hold a hit. Values are judged by their parts
(numbers with dots, names with dots, words, settings) and lists of names.

Defined results: a null or empty text has no findings; a null path is an empty one in fingerprints;
repeated rows of a file are reported each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.globs import loose
from ..sources import code_tokens as ct
from . import catalog, patterns

# fixed values
ALLOWED_IPS = ("0.0.0.0", "127.0.0.1")
CLOUD_DOMAINS = ("windows.net", "azure.com", "core.windows.net", "database.windows.net", "azurewebsites.net", "azure-api.net", "microsoftonline.com")
ENDPOINTS = ("management.azure.com", "login.microsoftonline.com", "169.254.169.254", "metadata.azure.internal")
REGIONS = (
    "eastus", "eastus2", "westus", "westus2", "westus3", "centralus", "northcentralus", "southcentralus", "westeurope", "northeurope", "uksouth", "ukwest", "southeastasia", "eastasia",
    "australiaeast", "australiasoutheast", "japaneast", "japanwest", "koreacentral", "koreasouth", "canadacentral", "canadaeast",
)
ID_KEYWORDS = ("subscription", "tenant", "resourcegroup")
ROOT_FOLDERS = ("var", "etc", "opt")
SECRET_KEYS = ("server", "data source", "accountkey")
HIVES = ("LOCAL_MACHINE", "CURRENT_USER", "CLASSES_ROOT", "USERS", "CURRENT_CONFIG")
CLOUD_CLIENTS = ("BlobServiceClient", "QueueServiceClient", "TableServiceClient", "SecretClient", "AmazonS3Client", "Google.Cloud")
CALLS = {
    "cpp": ("connect(", "getaddrinfo(", "curl_easy_setopt(", "fopen(", "ifstream", "ofstream", "filesystem::path"),
    "python": ("requests.", "socket.", "subprocess", "open(", "pathlib.Path("),
    "rust": ("reqwest::", "std::net::", "std::fs::", "Command::new(", "include_str!("),
}
SYMBOLS = ("Uri", "HttpClient", "WebRequest", "Dns", "Socket", "ProcessStartInfo", "File", "Path", "BlobServiceClient", "SqlConnection")
CONFIG_READS = ("GetEnvironmentVariable(", "IConfiguration", "Configuration[", "GetConnectionString(", "GetValue<")
CONFIG_CALLS = ("GetEnvironmentVariable", "GetConnectionString", "Configuration")
PORT_CALLS, PORT_TYPES = ("Connect", "Listen", "Bind"), ("IPEndPoint", "Socket")
CMDLETS = ("Invoke-WebRequest", "Invoke-RestMethod", "New-Object", "Set-Content", "Out-File")
USUAL_PORTS = (22, 80, 443)
TEXT_CATEGORIES = ("Source", "Config", "DeploymentArtifact")


def any_of(words) -> str:
    """An alternative of plain texts as a pattern."""
    return "(?:" + "|".join("".join(c if c.isalnum() or c in "_- /:!<" else f"\\{c}" for c in w) for w in words) + ")"


#: What a text is cut into before it is judged: numbers with dots, names with dots, words, and what is written like a GUID.
DOTTED, HOST, WORD = r"\b[0-9]+(?:[.][0-9]+)+\b", r"\b[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+\b", r"\b[A-Za-z0-9_]+\b"
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: An address wherever it stands, its four parts up to 255.
IPV4 = rf"\b(?:{_BYTE}[.]){{3}}{_BYTE}\b"
GUID = r"\b[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\b"
#: A path ends at a blank, a quote or a sign that no name has; what may not stand before it is kept apart for other engines.
_NO_WORD, _NO_PATH = r"\w", r"\w./-"
_DRIVE_OR_SHARE, _ROOTED = r"(?:[A-Za-z]:|\\\\[\w.-]+)\\[^\s\"'<>|*?]*", rf"/(?:{'|'.join(ROOT_FOLDERS)})/[\w.@%+~/-]*"
WINDOWS_PATH, LINUX_PATH = f"(?<![{_NO_WORD}]){_DRIVE_OR_SHARE}", f"(?<![{_NO_PATH}]){_ROOTED}"
_ID_WORD = r"\b" + any_of(ID_KEYWORDS) + r"\b"
#: The rules for whole texts; Linux paths count in source files only.
TEXT_RULES = tuple(f"portability.hardcoded.{x}" for x in ("ipv4", "dns", "filepath.windows", "filepath.linux", "guid", "region", "endpoint"))
LITERAL_RULES = (*TEXT_RULES, *(f"portability.hardcoded.{x}" for x in ("connectionstring", "localhost", "registrykey")))
#: Quoted texts: stretches without quotes and backslashes, between them a backslash with what it escapes.
QUOTED = "|".join(rf"{q}[^{q}\\]*(?:\\.[^{q}\\]*)*{q}" for q in "\"'")
MARKER = "lodestone"
FINDING = ("path", "rule_id", "line", "column", "message", "snippet", "severity", "confidence", "fingerprint", "metadata")


def fingerprint(*parts) -> F.Column:
    """Upper-case SHA-256 of the parts between bars; a null part is empty."""
    return F.upper(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256))


def spots(content, pattern) -> F.Column:
    """Matches of ``pattern``, from left to right: an array of (value, column from 1, text before)."""
    hits, gaps = F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), F.split(content, F.lit(pattern), F.lit(-1))
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("places"))
    step = lambda a, x: F.struct((a["at"] + F.char_length(x["0"]) + F.char_length(F.coalesce(x["1"], F.lit("")))).alias("at"), F.when(x["1"].isNull(), a["places"]).otherwise(F.concat(a["places"], F.array(a["at"] + F.char_length(x["0"])))).alias("places"))
    places = F.aggregate(F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda x: F.struct(x["g"].alias("0"), x["h"].alias("1"))), zero, step)["places"]
    return F.zip_with(hits, places, lambda v, p: F.struct(v.alias("value"), p.alias("column"), F.substring(content, F.lit(1), p - 1).alias("before")))


def is_ipv4(dotted) -> F.Column:
    """Whether a number with dots is an address: four parts, none above 255."""
    parts = F.split(dotted, "[.]")
    return (F.size(parts) == 4) & F.forall(parts, lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))


def in_cloud(host) -> F.Column:
    """Whether a name with dots lies in a cloud domain."""
    h = F.lower(host)
    return reduce(lambda a, b: a | b, [h.endswith(f".{d}") for d in CLOUD_DOMAINS])


def is_endpoint(host) -> F.Column:
    return F.lower(host).isin(*ENDPOINTS)


def is_region(word) -> F.Column:
    return F.lower(word).isin(*REGIONS)


def _holds(text, words) -> F.Column:
    """Whether a text holds one of some words."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def rules_of(value) -> F.Column:
    """The rules that a literal's value falls under; of addresses only the first is compared with those allowed. A value is cut into its parts only if it holds what a rule names."""
    every = lambda pattern: F.regexp_extract_all(value, F.lit(pattern), F.lit(0))
    first = F.get(F.filter(every(DOTTED), is_ipv4), F.lit(0))
    low, dotted = F.lower(value), value.rlike("[0-9][.][0-9]+[.][0-9]+[.][0-9]")
    tests = (
        dotted & first.isNotNull() & ~first.isin(*ALLOWED_IPS), _holds(low, CLOUD_DOMAINS) & F.exists(every(HOST), in_cloud), value.rlike(WINDOWS_PATH), value.rlike(LINUX_PATH), value.rlike(GUID) & value.rlike("(?i)" + any_of(ID_KEYWORDS)),
        _holds(low, REGIONS) & F.exists(every(WORD), is_region), _holds(low, ENDPOINTS) & F.exists(every(HOST), is_endpoint),
        F.contains(value, F.lit("=")) & _holds(low, SECRET_KEYS) & F.exists(F.split(value, ";"), lambda x: F.contains(x, F.lit("=")) & F.lower(F.trim(F.substring_index(x, "=", 1))).isin(*SECRET_KEYS)), F.contains(low, F.lit("localhost")), _holds(F.upper(value), [f"HKEY_{h}\\" for h in HIVES]),
    )
    return F.filter(F.array(*[F.when(t, r) for r, t in zip(LITERAL_RULES, tests, strict=True)]), lambda x: x.isNotNull())


def is_test(path) -> F.Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.coalesce(p.startswith("tests/") | p.contains("/tests/") | p.contains("/test/") | p.contains(".tests."), F.lit(False))


def odd_port(value) -> F.Column:
    """A port other than those of everyday services."""
    n = value.try_cast("int")
    return F.coalesce(n.between(1, 65535) & ~n.isin(*USUAL_PORTS), F.lit(False))


def default_severity(rule) -> F.Column:
    errors = [r for r, s in catalog.RULES.items() if s == "Error"]
    infos = [r for r, s in catalog.RULES.items() if s == "Info"]
    return F.when(rule.isin(*errors), "Error").when(rule.isin(*infos), "Info").otherwise("Warning")


def _finding(rows: DataFrame, value, message, severity, confidence, metadata) -> DataFrame:
    """Findings from rows with ``path, rule_id, line, column, content``; those that a comment spares go."""
    kept = rows.where(~F.array_contains("spared", F.lower("rule_id"))) if "spared" in rows.columns else rows
    return kept.select(
        "path", "rule_id", "line", "column", message.alias("message"), F.col("content").alias("snippet"), severity.alias("severity"), F.lit(confidence).alias("confidence") if isinstance(confidence, str) else confidence.alias("confidence"),
        fingerprint(F.col("rule_id"), F.col("path"), F.col("line"), F.col("column"), value).alias("fingerprint"), metadata.alias("metadata"),
    )


def _json(**fields) -> F.Column:
    return F.to_json(F.struct(*[(v if isinstance(v, F.Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def _severity() -> F.Column:
    return F.when(is_test(F.col("path")), "Info").otherwise(default_severity(F.col("rule_id")))


#: What text rules look at, by kind; words are those that name regions.
_LOOKED_AT = {"dotted": DOTTED, "host": HOST, "windows": WINDOWS_PATH, "linux": LINUX_PATH, "guid": GUID, "region": rf"(?i:\b(?:{'|'.join(REGIONS)})\b)"}


def text_findings(files: DataFrame) -> DataFrame:
    """Matches of the text rules in files of any language; suppressions do not apply."""
    rows = ct.tokens(files.where(F.col("category").isin(*TEXT_CATEGORIES)), lambda text: ct.found_in(text, _LOOKED_AT, {"guid": _ID_WORD}), ct.TEXT)
    kind, value = F.col("kind"), F.col("value")
    tests = (
        (kind == "dotted") & is_ipv4(value) & ~value.isin(*ALLOWED_IPS), (kind == "host") & in_cloud(value), kind == "windows", (kind == "linux") & (F.col("category") == "Source"), kind == "guid", kind == "region", (kind == "host") & is_endpoint(value),
    )
    rules = F.filter(F.array(*[F.when(t, r) for r, t in zip(TEXT_RULES, tests, strict=True)]), lambda x: x.isNotNull())
    found = rows.withColumn("rule_id", F.explode(rules))
    return _finding(found, value, F.concat(F.lit("Hard-coded value '"), value, F.lit("'.")), default_severity(F.col("rule_id")), "Medium", _json(engine="regex", ruleVersion="1", matchedValue=value))


def line_findings(files: DataFrame) -> DataFrame:
    """C and C++, Python, Rust: literals on any line, and ports on lines that call the network or the file system."""
    sources = files.where((F.col("category") == "Source") & F.col("language").isin(*CALLS))
    rows = ct.tokens(sources, lambda text: ct.in_lines(text, {"string": QUOTED, "number": r"\b[1-9][0-9]{1,4}\b"}, MARKER), ct.LINES)
    call = F.lit(None).cast("string")
    for language, tokens in reversed(CALLS.items()):
        first = F.coalesce(*[F.when(F.contains("content", F.lit(t)), t) for t in tokens])
        call = F.when(F.col("language") == language, first).otherwise(call)
    rows = rows.withColumn("call", call).withColumn("value", F.when(F.col("kind") == "string", F.expr("substring(value, 2, char_length(value) - 2)")).otherwise(F.col("value")))
    port = F.when(F.col("call").isNotNull() & odd_port(F.col("value")), F.array(F.lit("portability.hardcoded.port")))
    found = rows.withColumn("rule_id", F.explode(F.when(F.col("kind") == "string", rules_of(F.col("value"))).otherwise(port)))
    told = _json(engine="line-heuristic", language=F.col("language"), heuristicCallsiteMatched=F.col("call").isNotNull(), callsite=F.coalesce("call", F.lit("unknown")))
    text = F.when(F.col("kind") == "number", F.concat(F.lit("Hard-coded port "), F.col("value"), F.lit("."))).otherwise(F.concat(F.lit("Hard-coded value in "), F.col("language"), F.lit(" code.")))
    return _finding(found, F.col("value"), text, _severity(), F.when(F.col("call").isNotNull(), "High").otherwise("Medium"), told)


def _named(symbol, words) -> F.Column:
    """Whether a name holds one of some names, case and all."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(symbol, F.lit(w)) for w in words]), F.lit(False))


def csharp_findings(files: DataFrame) -> DataFrame:
    """C#: literals by the call or attribute that they are an argument of, cloud clients made directly, ports in network calls; calls may run over any number of lines."""
    sources = files.where((F.col("category") == "Source") & (F.col("language") == "csharp"))
    rows = ct.tokens(sources, lambda text: ct.csharp(text, CONFIG_READS, MARKER), ct.CSHARP)
    kind, value = F.col("kind"), F.col("value")
    read = ~F.col("made") & _named(F.col("symbol"), CONFIG_CALLS)
    network = F.filter("calls", lambda c: _named(c, PORT_CALLS) | (c.startswith("new ") & _named(c, PORT_TYPES)))
    # tokens are read once: what a token falls under depends on its kind
    literal = F.when((F.trim("value") != "") & ~read, rules_of(value))
    client = F.when(_named(value, CLOUD_CLIENTS), F.array(F.lit("portability.cloud.sdk.no_abstraction")))
    port = F.when(F.col("call").isNotNull() & odd_port(value), F.array(F.lit("portability.hardcoded.port")))
    called = rows.withColumn("call", F.when(kind == "number", F.regexp_replace(F.get(network, F.lit(0)), "^new ", "")))
    found = called.withColumn("rule_id", F.explode(F.when(kind == "string", literal).when(kind == "new", client).when(kind == "number", port)))
    certain = F.col("rule_id").isin("portability.hardcoded.connectionstring", "portability.hardcoded.localhost")
    sure = (kind != "string") | F.col("attribute").isNotNull() | _named(F.col("symbol"), SYMBOLS) | certain
    mild = is_test(F.col("path")) | ((kind == "string") & F.col("near_config"))
    site = F.when(kind == "string", F.coalesce(F.nullif("attribute", F.lit("")), "symbol", F.lit("literal"))).when(kind == "new", F.concat(F.lit("new "), value)).otherwise(F.col("call"))
    text = F.when(kind == "string", F.concat(F.lit("Hard-coded value '"), value, F.lit("'."))).when(kind == "new", F.concat(F.lit("Cloud client '"), value, F.lit("' is made directly.")))
    text = text.otherwise(F.concat(F.lit("Hard-coded port "), value, F.lit(" in '"), F.col("call"), F.lit("'.")))
    told = _json(engine="csharp-tokens", astConfirmed=F.when(kind == "string", F.lit(False)), callsite=site)
    return _finding(found, value, text, F.when(mild, "Info").otherwise(default_severity(F.col("rule_id"))), F.when(sure, "High").otherwise("Medium"), told)


def powershell_findings(files: DataFrame) -> DataFrame:
    """PowerShell: quoted and bare arguments of five commands, whatever lines they stand on; of ``New-Object`` only where a URI is made."""
    rows = ct.tokens(files.where((F.col("category") == "Source") & (F.col("language") == "powershell")), lambda text: ct.powershell(text, MARKER), ct.POWERSHELL)
    own = F.lower("command").isin(*[c.lower() for c in CMDLETS])
    uri = F.exists("words", lambda w: F.contains(F.lower(w), F.lit("system.uri")))
    found = rows.where(own & ((F.lower("command") != "new-object") | uri)).withColumn("rule_id", F.explode(rules_of(F.col("value"))))
    told = _json(engine="powershell-tokens", callsite=F.col("command"), parameter=F.col("parameter"))
    return _finding(found, F.col("value"), F.concat(F.lit("Hard-coded value passed to '"), F.col("command"), F.lit("'.")), _severity(), "High", told)


def custom_findings(files: DataFrame, rules: list[dict]) -> DataFrame:
    """Matches of a user's own rules (``id, pattern, message, severity, categories, enabled``, a configuration) in whole texts; suppressions do not apply.

    Rules are rows that files meet by their category, so any number of them makes one plan.
    """
    table = [(r["id"], r["pattern"], r["message"], r.get("severity", "Warning"), r.get("source", ""), c) for r in rules if r.get("enabled", True) for c in dict.fromkeys(r.get("categories", ("Source", "Config")))]
    own = files.sparkSession.createDataFrame(table, "rule_id string, __pattern string, __message string, __severity string, __source string, category string")
    rows = files.join(F.broadcast(own), "category").where(F.rlike("text", F.col("__pattern")))  # a row a rule and category; by category, files would meet in one task
    hits = rows.select("path", "text", "rule_id", "__message", "__severity", "__source", F.explode(spots(F.col("text"), F.col("__pattern"))).alias("s")).select("*", "s.value", "s.before").drop("s")
    line = F.regexp_count("before", F.lit("\n")) + 1
    hits = hits.withColumn("line", line).withColumn("column", F.char_length(F.substring_index("before", "\n", -1)) + 1).withColumn("content", F.regexp_replace(F.get(F.split("text", "\n", -1), F.col("line") - 1), r"\r$", ""))
    return _finding(hits, F.col("value"), F.col("__message"), F.col("__severity"), "Medium", _json(engine="custom-regex", source=F.col("__source"), match=F.col("value")))


def analyse(files: DataFrame, suppressions: list[dict] | None = None, custom: list[dict] | None = None) -> DataFrame:
    """All portability findings: source files by their language's detector, all others by the text rules, the user's rules for every file."""
    own = ("csharp", "powershell", *CALLS)
    rest = files.where(~((F.col("category") == "Source") & F.coalesce(F.col("language").isin(*own), F.lit(False))))
    told = csharp_findings(files).unionByName(line_findings(files)).unionByName(powershell_findings(files))
    told = patterns.without(told, [e for e in suppressions or [] if (e.get("path") or "").strip() and (e.get("rule") or "").strip()], loose)
    out = told.unionByName(text_findings(rest))
    return out.unionByName(custom_findings(files, custom)) if custom else out
