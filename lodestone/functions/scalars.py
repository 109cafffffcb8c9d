"""Column functions of the findings engine; all but ``entropy`` built from JVM expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# fixed values
STOP_WORDS = ("the", "a", "an", "and", "or", "is", "are", "to", "for", "of", "in", "on", "this", "that", "with", "from", "at", "by")
SENSITIVE = r"(?i)password|passwd|secret|token|apikey|api_key|connectionstring|connstr|privatekey|clientsecret"


def directory(path) -> F.Column:
    """The path before its last slash, ``.`` at the top; backslashes count as slashes."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(".")


def extension(path) -> F.Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def collapse(text) -> F.Column:
    """One line, trimmed, with single spaces."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


@F.arrow_udf(DoubleType())
def _entropy(texts: pa.Array) -> pa.Array:
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        codes = np.frombuffer((text.as_py() or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(codes):
            counts = np.bincount(codes) if codes.max() < 1 << 10 else np.unique(codes, return_counts=True)[1]
            counts = counts[counts > 0]
            out[i] = max(0.0, np.log2(len(codes)) - (counts * np.log2(counts)).sum() / len(codes))
    return pa.array(out)


def entropy(text) -> F.Column:
    """Shannon entropy in bits per character; 0 for null and empty texts. The characters are counted in tasks by arrays."""
    return _entropy(text)


def natural_language(text) -> F.Column:
    """Three words of two letters or more, a punctuation mark, and at least 35 % stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))
    stops = F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS)))
    return F.coalesce((F.size(words) >= 3) & text.rlike("[.,;:!?]") & (stops / F.greatest(F.size(words), F.lit(1)) >= 0.35), F.lit(False))


def literals(line) -> F.Column:
    """Contents of double- or single-quoted literals of a line, escapes kept."""
    return F.transform(F.regexp_extract_all(line, F.lit(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2))


def port_like(value) -> F.Column:
    """A port outside 22, 80 and 443."""
    return value.between(1, 65535) & ~value.isin(22, 80, 443)


def version_weight(version) -> F.Column:
    """Major + minor / 100 + patch / 10000 by the leading digits of up to three parts, without a sign of comparison before; null if a part has no digits."""
    bare = F.regexp_replace(F.trim(F.coalesce(version, F.lit(""))), r"^[=~^<>\s]+", "")
    parts = F.slice(F.filter(F.split(bare, r"\."), lambda x: x != ""), 1, 3)
    digits = F.transform(parts, lambda x: F.regexp_extract(x, r"^(\d{1,9})", 1).try_cast("double"))
    weight = F.aggregate(F.zip_with(digits, F.array(F.lit(1.0), F.lit(0.01), F.lit(0.0001)), lambda d, w: F.when(d.isNotNull(), d * w)), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.when((F.size(digits) > 0) & ~F.exists(digits, lambda d: d.isNull()), weight)


def staleness(current, latest) -> F.Column:
    """How far ``latest`` is ahead, never below 0; 0 if either is missing or not a version."""
    return F.greatest(F.lit(0.0), F.coalesce(version_weight(latest) - version_weight(current), F.lit(0.0)))


def pinned(ecosystem, version) -> F.Column:
    """Whether a requirement names one exact version in its ecosystem's notation."""
    exact = F.when(ecosystem == "NuGet", version.rlike(r"^(\d[\w.+-]*|\[[^,\]]+\])$")).when(ecosystem == "PyPI", version.rlike(r"^==[^*]+$"))
    exact = exact.when(ecosystem == "crates.io", version.rlike(r"^=\s*\d")).when(ecosystem == "npm", version.rlike(r"^\d+\.\d+\.\d+([-+][\w.+-]+)?$"))
    return F.coalesce(exact, F.lit(False))


def advisory_severity(score) -> F.Column:
    """A number or a word as Critical, High, Medium, Low or Unknown."""
    n = F.regexp_extract(F.coalesce(score, F.lit("")), r"(\d+(?:\.\d+)?)\s*$", 1).try_cast("double")
    word = F.initcap(F.regexp_extract(F.lower(F.coalesce(score, F.lit(""))), "(critical|high|medium|low)", 1))
    return F.when(n >= 9, "Critical").when(n >= 7, "High").when(n >= 0, "Medium").when(word != "", word).otherwise("Unknown")


def advisory_rank(severity) -> F.Column:
    return F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for p in (("critical", 4), ("high", 3), ("medium", 2), ("low", 1)) for x in p]), lambda k, v: k == F.lower(severity))), F.lit(0)), F.lit(0))


def redacted(key, value) -> F.Column:
    """A preview of at most 32 characters; the value of a sensitive key is hidden."""
    return F.when(key.rlike(SENSITIVE), "[REDACTED]").when(F.char_length(value) > 32, F.concat(F.substring(value, 1, 32), F.lit("..."))).otherwise(value)


def flag_name(text) -> F.Column:
    """A feature flag's name without quotes and with single underscores between its parts."""
    return F.replace(F.regexp_replace(F.trim(text), "^[\"']+|[\"']+$", ""), F.lit("__"), F.lit("_"))
