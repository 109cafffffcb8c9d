"""Dependencies and frameworks of package manifests.

XML needs a parser and is read a batch of files at a time; all other manifests are read by expressions
over their lines. Defined results: a manifest that cannot be parsed gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lines as lo

RECORD = "path string, line int, ecosystem string, name string, version string"
# fixed values
OLD_DOTNET = ("netcoreapp3.1", "net5.0")
SEMVER = r"^\d+\.\d+\.\d+([-+][0-9A-Za-z.+-]+)?$"
REQUIREMENT = r"^\s*([A-Za-z0-9_.-]+)(?:\[[^\]]*\])?\s*(===|==|>=|<=|~=|!=|>|<)?\s*([^\s;,#\"']*)"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def xml_items(name: str, text: str | None) -> list[tuple]:
    """``(kind, line, name, version)`` of a project file: packages and target frameworks, with the line of each element."""
    from xml.parsers import expat

    out: list[tuple] = []
    stack: list[list] = []
    config, props = name == "packages.config", name == "directory.packages.props"
    wanted = "package" if config else "PackageVersion" if props else "PackageReference"
    p = expat.ParserCreate()

    def start(tag, attributes):
        stack.append([_local(tag), attributes, p.CurrentLineNumber, "", {}])

    def end(tag):
        t, a, line, text_, inner = stack.pop()
        if stack:
            stack[-1][4][t] = text_.strip()
        if t == wanted:
            package = a.get("id") if config else a.get("Include") or a.get("Update")
            version = a.get("version") if config else a.get("Version") or inner.get("Version", "")
            if (package or "").strip():
                out.append(("package", line, package.strip(), (version or "").strip()))
        elif t in ("TargetFramework", "TargetFrameworks") and not (config or props):
            out.extend(("framework", line, token.strip(), "") for token in text_.split(";") if token.strip())

    def data(s):
        if stack:
            stack[-1][3] += s

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, data
    try:
        p.Parse((text or "").lstrip("﻿").encode(), True)
    except expat.ExpatError:
        return []
    return out


def _xml(files: DataFrame) -> DataFrame:
    """``(path, kind, line, name, version)`` of the XML manifests."""

    def run(batches):
        for b in batches:
            rows = [(p, *r) for p, f, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in xml_items(f, t)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "kind", "line", "name", "version"])

    own = files.where("file = 'directory.packages.props' or file = 'packages.config' or file like '%.csproj'")
    return own.select("path", "file", "text").mapInArrow(run, "path string, kind string, line int, name string, version string")


def _named(files: DataFrame) -> DataFrame:
    return files.select("path", F.lower(F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1)).alias("file"), F.col("text"))


def _lines(files: DataFrame, name: str) -> DataFrame:
    rows = files.where(F.col("file") == name).select("path", "file", F.posexplode(F.split("text", "\n", -1)).alias("i", "content"))
    return rows.select("path", "file", (F.col("i") + 1).alias("line"), F.trim(F.regexp_replace("content", r"\r$", "")).alias("content"))


def _required(rows: DataFrame, requirement, ecosystem: str = "PyPI") -> DataFrame:
    g = lambda i: F.regexp_extract(requirement, REQUIREMENT, i)
    return rows.select("path", "line", F.lit(ecosystem).alias("ecosystem"), g(1).alias("name"), F.concat(g(2), g(3)).alias("version")).where("name <> ''")


def _array_lines(rows: DataFrame) -> DataFrame:
    """Lines of a TOML ``dependencies`` list: from the line that opens it up to its closing bracket or the next section.

    A list that is opened and closed on one line is read as one requirement, the first."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.lower("content").startswith("dependencies") & F.contains("content", F.lit("["))
    alone = opens & F.col("content").rlike(r"\[.*\]")
    mark = F.when(alone, False).when(opens, True).when(F.col("content").startswith("[") | F.col("content").startswith("]"), False)
    return rows.withColumn("inside", F.last(mark, ignorenulls=True).over(w) | alone).where("inside")


def dependencies(files: DataFrame) -> DataFrame:
    """``files(path, text)`` -> ``(path, line, ecosystem, name, version)`` of eight kinds of manifest."""
    f = _named(files)
    net = _xml(f).where("kind = 'package'").select("path", "line", F.lit("NuGet").alias("ecosystem"), "name", "version")
    req = _lines(f, "requirements.txt").where("content <> '' and not content rlike '^[#-]'")
    py = _required(req, F.col("content"))
    quoted = F.regexp_extract_all("content", F.lit(r"[\"']([A-Za-z0-9_.-]+(?:\[[^\]]*\])?\s*(?:===|==|>=|<=|~=|!=|>|<)\s*[^\"']+)[\"']"), F.lit(1))
    setup = _lines(f, "setup.py").select("path", "line", F.explode(quoted).alias("q"))
    toml = _array_lines(_lines(f, "pyproject.toml")).withColumn("q", F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r"(?i)^dependencies\s*=\s*\[\s*", ""), r"^[\"']", ""), r"[\"',\]\s]+$", "")).where("q <> ''")
    entry = r"^([A-Za-z0-9_-]+)\s*=\s*(?:\"([^\"]*)\"|\{.*?version\s*=\s*\"([^\"]*)\".*\})"
    e = lambda i: F.regexp_extract("content", entry, i)
    cargo = _lines(f, "cargo.toml").withColumn("file_id", F.col("path"))
    cargo = lo.sections(cargo).where("section in ('dependencies', 'dev-dependencies', 'build-dependencies')")
    rust = cargo.select("path", "line", F.lit("Cargo").alias("ecosystem"), e(1).alias("name"), F.concat(e(2), e(3)).alias("version")).where("name <> ''")
    part = lambda k: F.map_entries(F.coalesce(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    js = f.where("file = 'package.json'").select("path", F.lit(1).alias("line"), F.lit("npm").alias("ecosystem"), F.explode(F.concat(part("dependencies"), part("devDependencies"))).alias("x"))
    js = js.select("path", "line", "ecosystem", F.col("x.key").alias("name"), F.col("x.value").alias("version"))
    out = net
    for rows in (py, _required(setup, F.col("q")), _required(toml, F.col("q")), rust, js):
        out = out.unionByName(rows)
    return out.select("path", F.col("line").cast("int").alias("line"), "ecosystem", F.trim("name").alias("name"), F.trim(F.coalesce("version", F.lit(""))).alias("version"))


def pinned_version(ecosystem, version) -> F.Column:
    """The exact version that a requirement names, or null."""
    bare = r"^\d[0-9A-Za-z.+-]*$"
    inner = F.trim(F.regexp_extract(version, r"^\[(.*)\]$", 1))
    nuget = F.when(version.rlike(bare), version).when(inner.rlike(bare), inner)
    return F.when(ecosystem == "NuGet", nuget).when((ecosystem == "PyPI") & version.startswith("==") & (F.char_length(version) > 2), F.trim(F.regexp_replace(version, "^==", ""))).when((ecosystem == "Cargo") & version.startswith("="), F.trim(F.regexp_replace(version, "^=", ""))).when((ecosystem == "npm") & version.rlike(SEMVER), version)


def with_central_versions(deps: DataFrame) -> DataFrame:
    """NuGet references without a version take that of the central file, by name without case; one row for each place and requirement."""
    name = F.lower(F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1))
    exact = pinned_version(F.col("ecosystem"), F.col("version"))
    central = deps.where(name == "directory.packages.props").withColumn("__v", exact).where("__v is not null").groupBy(F.lower("name").alias("__n")).agg(F.min_by("__v", F.struct("path", "line")).alias("__v"))
    j = deps.join(central, (F.lower(deps["name"]) == F.col("__n")) & (F.col("ecosystem") == "NuGet") & (F.col("version") == ""), "left")
    out = j.withColumn("version", F.coalesce("__v", "version")).drop("__n", "__v")
    first = F.min(F.struct("name", "version", "path")).alias("r")
    g = out.groupBy("ecosystem", F.lower("name").alias("__n"), F.lower("path").alias("__p"), "line", F.lower("version").alias("__v")).agg(first)
    out = g.select("r.path", "line", "ecosystem", "r.name", "r.version")
    return out.withColumn("exact", pinned_version(F.col("ecosystem"), F.col("version"))).withColumn("pinned", F.col("exact").isNotNull())


#: Frameworks that are named anywhere in a manifest (fixed values).
OLD_NAMED = ("netcoreapp3.1", "net5.0")


def old_frameworks(files: DataFrame) -> DataFrame:
    """``(path, line, framework, reason)``: frameworks and runtimes past their support, once for each line."""
    f = _named(files).where("file like '%.csproj' or file in ('directory.packages.props', 'packages.config', 'requirements.txt', 'setup.py', 'pyproject.toml', 'cargo.toml', 'package.json')")
    net = _xml(f).where((F.col("kind") == "framework") & F.lower("name").isin(*OLD_DOTNET)).select("path", "line", F.col("name").alias("framework"), F.lit("Out-of-support .NET target framework.").alias("reason"))
    py = f.where("file in ('pyproject.toml', 'setup.py')").select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "content")).where(F.lower("content").contains("python"))
    said = F.array(F.when(F.contains("content", F.lit("3.6")), "Python 3.6"), F.when(F.contains("content", F.lit("2.")), "Python 2.x"))
    py = py.select("path", (F.col("i") + 1).alias("line"), F.explode(F.filter(said, lambda x: x.isNotNull())).alias("framework"), F.lit("Out-of-support Python runtime.").alias("reason"))
    # a name, perhaps blanks, and its numbers
    name, number = r"\b([A-Za-z]+)[ \t]*[0-9][0-9.]*", r"\b[A-Za-z]+[ \t]*([0-9]+(?:[.][0-9]+)*)"
    at = f.where(F.col("text").rlike("(?i)netcoreapp|net|python")).select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "content"))
    told = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(number), F.lit(g)).alias(c) for g, c in ((0, "said"), (1, "number"))])
    kind = lambda x: F.lower(F.regexp_extract(x["said"], name, 1))
    old = lambda x: F.concat(kind(x), x["number"]).isin(*OLD_NAMED) | ((kind(x) == "python") & ((x["number"] == "2") | x["number"].startswith("2.") | (x["number"] == "3.6")))
    words = at.select("path", (F.col("i") + 1).alias("line"), F.explode(F.transform(F.filter(told, old), lambda x: x["said"])).alias("framework"), F.lit("Out-of-support framework/runtime detected.").alias("reason"))
    every = net.withColumn("o", F.lit(0)).unionByName(py.withColumn("o", F.lit(1))).unionByName(words.withColumn("o", F.lit(2)))
    g = every.groupBy("path", "line", F.lower("framework").alias("k")).agg(F.min(F.struct("o", "framework", "reason")).alias("r"))
    return g.select("path", F.col("line").cast("int").alias("line"), "r.framework", "r.reason")
