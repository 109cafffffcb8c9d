"""The analytical store: five Parquet tables, partitioned by run, with one commit over all of them.

Every write puts its files into folders of its own. What the store holds is named by the latest of its
snapshots, small files numbered without gaps: for each table and run the folders with its rows. A write
becomes visible in all tables at once, when the next snapshot gets its name; until then, and if it fails
at any point, readers see the one before. A writer that finds the number taken starts from the newer
snapshot, unless that changed the same run: then it fails with ``Conflict`` and nothing of it is visible.

A run is written as a whole. ``clear`` replaces what the run had; without it files are added whose paths
the run does not have yet, and findings and metrics are appended. The rules of every run are kept, and
the last written of an id counts. Ids are hashes, so writing a run again gives the same ids. Folders that
no recent snapshot names stay until ``vacuum``.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNS = "repo_root string, commit_sha string, started_at timestamp, ended_at timestamp, tool_version string, config_hash string, run_id string"
FILES = "file_id long, path string, category string, size_bytes long, hash string, language string, run_id string"
FINDINGS = "finding_id long, rule_id string, file_id long, file_path string, line int, `column` int, message string, snippet string, severity string, confidence string, fingerprint string, metadata string, run_id string"
RULES = "rule_id string, title string, default_severity string, description string, written_at timestamp, run_id string"
METRICS = (
    "metric_id long, file_id long, file_path string, last_commit_at timestamp, commits_30d long, commits_90d long, commits_180d long, commits_365d long, authors long, concentration double, lines_added long, lines_removed long, "
    "churn_score double, stale_score double, top_author string, top_author_pct double, run_id string"
)
TABLES = {"runs": RUNS, "files": FILES, "findings": FINDINGS, "rules": RULES, "metrics": METRICS}


@dataclass
class Store:
    """The tables of a store, as they are when read."""

    runs: DataFrame
    files: DataFrame
    findings: DataFrame
    rules: DataFrame
    metrics: DataFrame


def scratch(spark: SparkSession) -> str:
    """A new folder for a store that will not be kept, below the shared folder or else the warehouse."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/store-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once to a new folder and read back, for tables that are looked at several times."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(RuntimeError):
    """Another writer changed the same run in the meantime."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@dataclass
class Snapshot:
    """``folders``: table -> run -> names of the folders with its rows, below ``root/table/run_id=run``."""

    number: int = 0
    folders: dict = field(default_factory=lambda: {name: {} for name in TABLES})


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def snapshots(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the snapshots that are there, in order."""
    fs, p = _path(spark, f"{root}/snapshots")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d{12}[.]json", n))


def snapshot(spark: SparkSession, root: str, number: int | None = None) -> Snapshot:
    """The latest snapshot, or an earlier one; empty if nothing was written yet."""
    numbers = snapshots(spark, root)
    if number is None:
        number = numbers[-1] if numbers else 0
    if not number:
        return Snapshot()
    return Snapshot(number, json.loads(_read_text(spark, f"{root}/snapshots/{number:012d}.json"))["folders"])


def _claim(spark: SparkSession, root: str, new: Snapshot) -> bool:
    """Write ``new`` under its number by renaming a finished file; False if the number is taken."""
    fs, top = _path(spark, f"{root}/snapshots")
    fs.mkdirs(top)
    mine = uuid.uuid4().hex
    _, draft = _path(spark, f"{root}/snapshots/.{mine}.tmp")
    _, name = _path(spark, f"{root}/snapshots/{new.number:012d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"writer": mine, "folders": new.folders}).encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE  # fails where the name exists
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(name), options)
    except Py4JJavaError:
        fs.delete(draft, False)
        if not fs.exists(name):
            raise
    return json.loads(_read_text(spark, f"{root}/snapshots/{new.number:012d}.json"))["writer"] == mine


def commit(spark: SparkSession, root: str, base: Snapshot, run_id: str, change) -> Snapshot:
    """``change(folders)`` of one run, on top of ``base`` or of what other writers made of it."""
    seen = {name: base.folders[name].get(run_id) for name in TABLES}
    while True:
        new = Snapshot(base.number + 1, json.loads(json.dumps(base.folders)))
        change(new.folders)
        if _claim(spark, root, new):
            return new
        base = snapshot(spark, root)
        if {name: base.folders[name].get(run_id) for name in TABLES} != seen:
            raise Conflict(f"run {run_id} was changed by another writer")


def ensure(spark: SparkSession, root: str) -> None:
    """Make the folders that are not there; harmless if repeated."""
    for name in (*TABLES, "snapshots"):
        fs, p = _path(spark, f"{root}/{name}")
        fs.mkdirs(p)


def table(spark: SparkSession, root: str, name: str, at: Snapshot | None = None) -> DataFrame:
    """A table with its schema, as the latest or a given snapshot has it."""
    at = at or snapshot(spark, root)
    places = [f"{root}/{name}/run_id={run}/{f}" for run, folders in sorted(at.folders[name].items()) for f in folders]
    if not places:
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).option("basePath", f"{root}/{name}").parquet(*places)


def read(spark: SparkSession, root: str, number: int | None = None) -> Store:
    """All tables of one snapshot; of the rules the last written of each id."""
    at = snapshot(spark, root, number)
    t = {name: table(spark, root, name, at) for name in TABLES}
    w = Window.partitionBy(F.lower("rule_id")).orderBy(F.desc("written_at"), F.desc("run_id"))
    t["rules"] = t["rules"].withColumn("n", F.row_number().over(w)).where("n = 1").select("rule_id", "title", "default_severity", "description")
    return Store(**t)


def delete_run(spark: SparkSession, root: str, run_id: str, names=("files", "findings", "metrics")) -> None:
    """Delete what a run has in some tables; the run itself stays unless named."""

    def change(folders):
        for name in names:
            folders[name].pop(run_id, None)

    commit(spark, root, snapshot(spark, root), run_id, change)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all snapshots but the last ``keep`` and the folders that none of these names; only while nobody writes. The number of folders deleted."""
    numbers = snapshots(spark, root)
    kept = [snapshot(spark, root, n) for n in numbers[-keep:]]
    named = {(name, run, f) for s in kept for name, runs in s.folders.items() for run, folders in runs.items() for f in folders}
    gone = 0
    for name in TABLES:
        fs, top = _path(spark, f"{root}/{name}")
        for run in fs.listStatus(top) if fs.exists(top) else ():
            for f in fs.listStatus(run.getPath()):
                if (name, run.getPath().getName().removeprefix("run_id="), f.getPath().getName()) not in named:
                    fs.delete(f.getPath(), True)
                    gone += 1
    for n in numbers[:-keep]:
        fs, p = _path(spark, f"{root}/snapshots/{n:012d}.json")
        fs.delete(p, False)
    return gone


def _write(rows: DataFrame, root: str, name: str, run_id: str, folder: str) -> None:
    names = [c.strip().split(" ")[0].strip("`") for c in TABLES[name].split(",")][:-1]
    kinds = dict(zip(names, (c.strip().split(" ")[1] for c in TABLES[name].split(",")), strict=False))
    cols = [F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names]
    rows.select(*cols).write.parquet(f"{root}/{name}/run_id={run_id}/{folder}")


def file_id(run_id: str, path="path") -> F.Column:
    return F.xxhash64(F.lit(run_id), F.lower(path))


def write_run(spark: SparkSession, root: str, run: dict, files: DataFrame, findings: DataFrame, rules: DataFrame, metrics: DataFrame | None = None, clear: bool = True) -> None:
    """Write ``run`` (``run_id`` and the columns of a run) with its files, findings (by ``path``), rules and perhaps metrics (by ``path``).

    Paths are compared without case. Findings and metrics whose file the run does not have are left out.
    """
    run_id = run["run_id"]
    ensure(spark, root)
    base, folder = snapshot(spark, root), uuid.uuid4().hex
    written = []

    def put(rows: DataFrame, name: str) -> None:
        _write(rows, root, name, run_id, folder)
        written.append(name)

    names = [c.strip().split(" ")[0] for c in RUNS.split(",")][:-1]
    kinds = ", ".join(RUNS.split(",")[:-1])
    put(spark.createDataFrame([tuple(run.get(c) for c in names)], kinds), "runs")
    put(rules.withColumn("written_at", F.lit(run.get("started_at")).cast("timestamp")), "rules")
    w = Window.partitionBy("file_id").orderBy("path", "hash")
    new = files.withColumn("file_id", file_id(run_id)).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    before = table(spark, root, "files", base).where(F.col("run_id") == run_id) if not clear else None
    put(new if before is None else new.join(before.select("file_id"), "file_id", "left_anti"), "files")
    known = spark.read.schema(FILES.rsplit(",", 1)[0]).parquet(f"{root}/files/run_id={run_id}/{folder}").select("file_id", F.col("path").alias("file_path"))
    known = known if before is None else known.unionByName(before.select("file_id", F.col("path").alias("file_path")))
    held = lambda rows: rows.withColumn("file_id", file_id(run_id)).drop("file_path").join(known, "file_id")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("rule_id", "path", "line", "column", "fingerprint", "message")]
    put(held(findings).withColumn("finding_id", F.xxhash64(F.lit(run_id), *parts)), "findings")
    if metrics is not None:
        put(held(metrics).withColumn("metric_id", F.col("file_id")), "metrics")

    def change(folders):
        for name in TABLES:
            replaced = clear or name in ("runs", "rules")
            mine = ([] if replaced else folders[name].get(run_id, [])) + ([folder] if name in written else [])
            folders[name].pop(run_id, None)
            if mine:
                folders[name][run_id] = mine

    commit(spark, root, base, run_id, change)
