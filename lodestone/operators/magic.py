"""Magic strings: literals worth a name, their scores, limits and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions.globs import loose
from ..sources import code_tokens as ct
from ..sources.store import keep
from .portability import GUID, QUOTED, _json, any_of, fingerprint, is_test, rules_of

# fixed values
SINKS = {
    "csharp": ("Console.Write", "ILogger", "Log", "Trace", "Debug", "Serilog"),
    "cpp": ("std::cout", "std::cerr", "printf", "spdlog", "log("),
    "python": ("logging.", "logger.", "print("),
    "powershell": ("Write-Host", "Write-Output", "Write-Verbose", "Write-Debug", "Write-Information"),
    "rust": ("println!", "eprintln!", "log::", "tracing::"),
}
CALLS = {
    "cpp": ("connect(", "getaddrinfo(", "curl_easy_setopt(", "fopen(", "if", "switch", "throw"),
    "python": ("requests.", "socket.", "open(", "if ", "match ", "raise"),
    "rust": ("reqwest::", "std::net::", "std::fs::", "if ", "match ", "panic!"),
    "javascript": ("if (", "switch(", "throw new", "console."),
    "typescript": ("if (", "switch(", "throw new", "console."),
    "jsx": ("if (", "switch(", "throw new", "console."),
}
COMPARISONS, CONDITIONS, EXCEPTIONS = ("==", "!=", "case ", "match ", "ContainsKey", "TryGetValue"), ("if ", "if(", "else if", "while "), ("throw", "raise", "panic!")
#: Quoted texts that end on their line.
IN_LINE = QUOTED.replace("\\\\]", "\\\\\\n]")
MIN_USES, PER_DIRECTORY, TOTAL, MAX_ENTROPY = 2, 50, 500, 4.2


def identifier(value) -> F.Column:
    """Values that name nothing by themselves: one with a GUID in it, one with a word that begins with a date of the calendar, a version of three numbers."""
    dated = F.exists(F.split(value, r"\s+"), lambda w: w.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}") & F.substring(w, 1, 10).try_cast("date").isNotNull())
    core = F.split(F.regexp_replace(value, "^[vV]|[-+].*$", ""), "[.]")
    version = (F.size(core) == 3) & F.forall(core, lambda x: x.rlike("^[0-9]+$"))
    return value.rlike(GUID) | F.coalesce(dated, F.lit(False)) | version


def _has(text, words):
    return text.rlike("(?i)" + any_of(words)) if words else F.lit(False)


def _by_language(tables: dict, of):
    out = F.lit(None)
    for language, words in tables.items():
        out = F.when(F.col("language") == language, of(words)).otherwise(out)
    return out


def _like_any(value, globs) -> F.Column:
    return F.coalesce(value.rlike("|".join(loose(g) for g in globs)), F.lit(False)) if globs else F.lit(False)


def occurrences(files: DataFrame, sinks: dict | None = None, allow=(), deny=(), max_entropy: float = MAX_ENTROPY) -> DataFrame:
    """``files(path, language, text)`` -> a row for each literal that may be worth a name, with the flags of its line.

    Literals on lines that log are left out; so are short ones, those allowed, portability values, ids,
    dates, versions, prose and likely secrets, unless ``deny`` names them. ``sinks`` replaces the logging
    calls of a language; an empty list leaves them as they are.
    """
    sinks = SINKS | {k: tuple(v) for k, v in (sinks or {}).items() if v}
    told = files.select("path", F.lit(None).cast("string").alias("category"), "language", "text")
    rows = ct.tokens(told, lambda text: ct.found_in(text, {"quoted": IN_LINE}, {}), ct.TEXT)
    logged = F.coalesce(_by_language(sinks, lambda w: _has(F.col("content"), w)), F.lit(False))
    call = _by_language(CALLS, lambda w: F.coalesce(*[F.when(F.lower("content").contains(t.lower()), t) for t in w]))
    found = rows.where(~logged).withColumn("call", call.cast("string"))
    inner = F.expr("substring(value, 2, char_length(value) - 2)")
    found = found.withColumn("raw", inner).withColumn("literal", fn.collapse(F.regexp_replace(inner, r"\r", ""))).where("char_length(literal) > 2")
    # files are read once: every use below begins at what is written here
    flags = [_has(F.col("content"), words).alias(name) for words, name in ((COMPARISONS, "compared"), (CONDITIONS, "condition"), (EXCEPTIONS, "exception"))]
    found = keep(found.select("path", "language", "line", "column", "raw", "literal", "call", *flags, is_test(F.col("path")).alias("test")))
    lit = F.col("literal")
    dull = _like_any(lit, allow) | (F.size(rules_of(lit)) > 0) | identifier(lit) | fn.natural_language(lit) | ((F.char_length(lit) >= 16) & (fn.entropy(lit) >= max_entropy))
    # what a literal is like is found once for each; written first, or the planner would ask at every place
    few = keep(keep(found.select("literal").distinct()).where(_like_any(lit, deny) | ~dull))
    return found.join(few, "literal", "left_semi").select(found.columns)


def score(n, compared, conditions, tests, exceptions) -> F.Column:
    """Score of a literal from its number of uses and those in comparisons, conditions, tests and exceptions; halves round to even."""
    boost = 1 + F.when(compared > 0, 0.9).otherwise(0.0) + F.when(conditions > 0, 0.4).otherwise(0.0)
    penalty = F.when(tests == n, 0.45).otherwise(0.0) + F.least(F.lit(0.35), 0.35 * exceptions / n)
    return F.bround(F.log2(n + 1) * boost * (1 - F.least(F.lit(0.9), penalty)), 4)


def candidates(found: DataFrame, min_uses: int = MIN_USES) -> DataFrame:
    """A row for each literal, exactly as written after ``collapse``, used ``min_uses`` times or more: counts, score, rule, first place, the places by file and languages."""
    place = F.struct("path", "line", "column")
    count = lambda c: F.count_if(F.col(c)).alias(c)
    # the places are counted by file first, so a frequent literal brings one row a file
    by_file = found.groupBy("literal", "path").agg(F.count("*").alias("n"), F.min(place).alias("first"), *[count(c) for c in ("compared", "condition", "exception", "test")], F.array_sort(F.collect_set(F.coalesce("language", F.lit("unknown")))).alias("languages"), F.min("call").alias("call"))
    sums = [F.sum(c).alias(c) for c in ("compared", "condition", "exception", "test")]
    g = by_file.groupBy("literal").agg(F.sum("n").alias("n"), F.count("*").alias("files"), F.min("first").alias("first"), *sums, F.array_sort(F.array_distinct(F.flatten(F.collect_set("languages")))).alias("languages"), F.min("call").alias("call")).where(F.col("n") >= min_uses)
    rule = F.when(F.col("compared") > 0, "magic-string.comparison-used").when(F.col("n") >= max(2 * min_uses, 5), "magic-string.high-frequency").otherwise("magic-string.candidate")
    return g.select(
        "literal", "n", "files", F.col("first.path").alias("path"), F.col("first.line").alias("line"), F.col("first.column").alias("column"), "compared", "condition", "exception", "test", "languages", "call",
        score(F.col("n"), F.col("compared"), F.col("condition"), F.col("test"), F.col("exception")).alias("score"), rule.alias("rule_id"),
    )


def limited(rows: DataFrame, per_directory: int = PER_DIRECTORY, total: int = TOTAL) -> DataFrame:
    """The best candidates, at most ``per_directory`` of a folder (of the first place, without case) and ``total`` of all."""
    order = [F.desc("score"), F.desc("n"), "literal"]
    w = Window.partitionBy(F.lower(fn.directory(F.col("path")))).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_directory).drop("__n").orderBy(*order).limit(total)


def findings(rows: DataFrame, found: DataFrame, per_file: int = 5) -> DataFrame:
    """Candidates as findings; the metadata hold a summary and the first places by file of each."""
    w = Window.partitionBy("literal").orderBy("path", "line", "column")
    places = found.join(rows.select("literal"), "literal", "left_semi").withColumn("o", F.row_number().over(w)).where(F.col("o") <= per_file)
    top = places.groupBy("literal").agg(F.array_sort(F.collect_list(F.struct("path", "line", "column"))).alias("top"))
    r = rows.join(top, "literal")
    summary = F.concat(F.lit("languages: "), F.array_join("languages", ", "), F.when(F.col("call").isNotNull(), F.concat(F.lit("; call: "), "call")).otherwise(""))
    told = _json(strategy="literal", contextSummary=summary, scoring=F.struct("score", F.col("n").alias("occurrences"), F.col("compared").alias("comparisons"), F.col("test").alias("tests")), topLocations=F.col("top"))
    return r.select(
        "path", "rule_id", F.col("line").cast("int").alias("line"), F.col("column").cast("int").alias("column"), F.concat(F.lit("Literal '"), "literal", F.lit("' is used "), F.col("n").cast("string"), F.lit(" times.")).alias("message"),
        F.lit(None).cast("string").alias("snippet"), F.lit("Info").alias("severity"), F.when(F.col("compared") > 0, "High").otherwise("Medium").alias("confidence"), fingerprint(F.col("rule_id"), F.col("literal"), F.col("n")).alias("fingerprint"), told.alias("metadata"),
    )


def ranked(rows: DataFrame, min_score: float = 0.0, min_uses: int = MIN_USES, language: str = "", path_prefix: str = "", top: int = 25, found: DataFrame | None = None) -> DataFrame:
    """Candidates by score after filters; ``path_prefix`` holds for any of the places in ``found``, or, without them, for the first place."""
    rows = rows.where((F.col("score") >= min_score) & (F.col("n") >= min_uses))
    if language.strip():
        rows = rows.where(F.exists("languages", lambda x: F.lower(x) == language.strip().lower()))
    if path_prefix.strip():
        begins = F.lower("path").startswith(path_prefix.strip().lower())
        rows = rows.where(begins) if found is None else rows.join(found.where(begins).select("literal"), "literal", "left_semi")
    return rows.orderBy(F.desc("score"), F.desc("n"), F.upper("literal"), "literal").limit(min(max(1, top), 100))


def by_module(rows: DataFrame, per_module: int = 10) -> DataFrame:
    """The best candidates of each top folder, with their place there."""
    module = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(".")
    w = Window.partitionBy(F.lower("module")).orderBy(F.desc("score"), F.desc("n"), F.upper("literal"), "literal")
    return rows.withColumn("module", module).withColumn("place", F.row_number().over(w)).where(F.col("place") <= min(max(1, per_module), 100))
