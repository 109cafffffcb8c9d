"""Files of a repository as tables: discovery, classification, commit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import globs
from ..functions import scalars as fn

MAX_BYTES = 2 << 20
# fixed values
GENERATED = ("bin", "obj", "out", "dist", "target", "__pycache__")
VENDORED = ("node_modules", "third_party", "vendor", "packages")
TOOLS = (".vs", ".vscode", ".idea")
EXCLUDED_NAMES, EXCLUDED_ENDINGS = ("thumbs.db", "desktop.ini"), (".db-shm", ".db-wal", ".db-journal")
SOURCE = (".cs", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".hh", ".hxx", ".py", ".ps1", ".rs", ".java", ".go", ".js", ".ts", ".tsx", ".jsx", ".swift", ".kt", ".kts")
CONFIG, DOCS = (".json", ".yaml", ".yml", ".ini", ".config", ".toml", ".xml", ".properties"), (".md", ".rst", ".txt", ".adoc")
DEPLOYMENT = ("/ev2/", "/rollout/", "/service-model/", "/servicemodel/", "/bindings/", "/azure-pipelines", "/pipelines/", "/ado/", "/.azuredevops/", "/helm/", "/k8s/", "/manifests/", "/deploy/")
LANGUAGES = {
    ".cs": "csharp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "cpp", ".h": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".py": "python", ".ps1": "powershell", ".rs": "rust",
    ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "jsx", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".md": "markdown",
}


def classify(path, markers=DEPLOYMENT) -> F.Column:
    """Category of a path, the first that applies of: generated, vendor, tools, deployment, source, config, docs.

    A marker is a folder in the path, whatever its slashes.
    """
    folders = F.split(F.lower(fn.directory(path)), "/")
    inside = lambda names: F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]))
    e, whole = fn.extension(path), F.concat(F.lit("/"), F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))
    deploys = F.lit(False)
    for m in markers:
        deploys = deploys | F.contains(whole, F.lit("/" + m.lower().replace("\\", "/").strip().strip("/") + "/"))
    out = F.when(inside(GENERATED), "Generated").when(inside(VENDORED), "Vendor").when(inside(TOOLS), "IDE").when(deploys, "DeploymentArtifact")
    return out.when(e.isin(*SOURCE), "Source").when(e.isin(*CONFIG), "Config").when(e.isin(*DOCS), "Docs").otherwise("Unknown")


def language(path) -> F.Column:
    """Language of a file by its extension, or null."""
    return F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p]), lambda k, v: k == fn.extension(path))), F.lit(0))


def excluded(path, ignore: list[str] | None = None, dot_folders: bool = True) -> F.Column:
    """Whether a file is never scanned: by its name or ending, in a hidden folder, or by the lines of an ignore file."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.lower(F.element_at(F.split(p, "/"), -1))
    out = name.isin(*EXCLUDED_NAMES) | name.rlike("(" + "|".join(x.replace(".", "[.]") for x in EXCLUDED_ENDINGS) + ")$") | p.rlike(r"(?i)(^|/)[.]git(/|$)")
    if dot_folders:
        out = out | p.rlike(r"(^|/)[.][^/]+/")
    return out | p.rlike(globs.ignored(ignore)) if ignore else out


def discover(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, ignore: list[str] | None = None, hashes: bool = True) -> DataFrame:
    """``(path, category, language, size_bytes, hash, text)`` of the files below ``root``, without generated, vendored, excluded, ignored and too large ones."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_bytes)
    top = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.col("path"), F.lit("^.*?" + "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in top) + "/"), F.lit(""))
    named = raw.select(path.alias("path"), F.col("length").alias("size_bytes"), "content")
    named = named.withColumn("category", classify(F.col("path"))).where(~F.col("category").isin("Generated", "Vendor", "IDE") & ~excluded(F.col("path"), ignore))
    digest = F.sha2("content", 256) if hashes else F.lit("")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return named.select("path", "category", language(F.col("path")).alias("language"), "size_bytes", digest.alias("hash"), text.alias("text"))


def renamed(path) -> tuple[F.Column, F.Column]:
    """``(new, old)`` of a path as the log writes it: ``a/{b => c}/d`` or ``a => b``; old is null without a rename."""
    braces, plain = r"^(.*)[{](.*) => (.*)[}](.*)$", r"^(.*) => (.*)$"
    part = lambda p, i: F.regexp_extract(path, p, i)
    joined = lambda i: F.regexp_replace(F.concat(part(braces, 1), part(braces, i), part(braces, 4)), "//", "/")
    new = F.when(path.rlike(braces), joined(3)).when(path.rlike(plain), part(plain, 2)).otherwise(path)
    return new, F.when(path.rlike(braces), joined(2)).when(path.rlike(plain), part(plain, 1))


def commit_log(lines: DataFrame) -> DataFrame:
    """Lines of ``git log --numstat --format='commit %H%x09%ae%x09%at'`` (``file_id, line, content``) -> ``(sha, author, ts, path, old_path, added, removed)``; binary files have no lines."""
    p = r"^commit ([0-9a-f]{7,64})\t([^\t]*)\t(\d+)$"
    tagged = lines.withColumn("head", F.when(F.col("content").rlike(p), F.col("content")))
    w = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = tagged.withColumn("of", F.last("head", ignorenulls=True).over(w)).where("head is null and content like '%\\t%\\t%' and of is not null")
    part = lambda i: F.regexp_extract("of", p, i)
    num = lambda i: F.coalesce(F.get(F.split("content", "\t"), F.lit(i)).try_cast("long"), F.lit(0))
    new, old = renamed(F.get(F.split("content", "\t"), F.lit(2)))
    return rows.select(part(1).alias("sha"), part(2).alias("author"), F.timestamp_seconds(part(3).cast("long")).alias("ts"), new.alias("path"), old.alias("old_path"), num(0).alias("added"), num(1).alias("removed"))
