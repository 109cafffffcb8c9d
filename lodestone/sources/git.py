"""History of a repository as tables: commits as a data source that tasks read by ranges, blame by groups of files.

The repository must lie in a folder that every worker sees. The driver only counts revisions; each task
walks its own range of them, leaves out those outside the wanted times before it compares anything, and
compares the others with their first parents.

    spark.dataSource.register(Commits)
    spark.read.format("commits").option("path", root).option("mode", "paths").load()

Defined results: a folder without history has no rows; a root commit adds all its files; a merge is what
it changes for its first parent; files without lines (binary ones) count none; a path is as git stores it.
"""

from __future__ import annotations

import datetime as dt
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMA = "sha string, author string, ts timestamp, path string, old_path string, added long, removed long"
#: Revisions a task, and revisions compared by one call of git.
RANGE, CALL = 1000, 200
_SHA = re.compile(rb"[0-9a-f]{40}|[0-9a-f]{64}")


def _git(root: str, *args: str, given: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], input=given, capture_output=True, check=True).stdout


def has_history(root: str) -> bool:
    """Whether git finds a commit at ``root``."""
    try:
        return subprocess.run(["git", "-C", root, "rev-parse", "--verify", "-q", "HEAD"], capture_output=True, check=False).returncode == 0
    except OSError:
        return False


class Revisions(InputPartition):
    """So many revisions behind the first ``skip`` of those reachable from ``head``."""

    def __init__(self, head: str, skip: int, count: int):
        self.head, self.skip, self.count = head, skip, count


class Commits(DataSource):
    """Changed files of all commits reachable from HEAD.

    Options: ``path``; ``mode``, ``numstat`` (lines added and removed, renames followed) or ``paths`` (names
    only, lines are zero, much cheaper); ``since``, seconds since 1970 that author times must reach;
    ``range``, revisions a task; ``pushdown``, ``true`` in sessions that allow it
    (``spark.sql.python.filterPushdown.enabled``), where conditions ``ts >=`` and ``ts >`` then count as ``since``.
    """

    @classmethod
    def name(cls) -> str:
        return "commits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else CommitReader)(self.options)


class CommitReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.mode = options["path"], options.get("mode", "numstat")
        if self.mode not in ("numstat", "paths"):
            raise ValueError(f"no such mode: {self.mode}")
        self.since, self.size = float(options.get("since", "-inf")), int(options.get("range", RANGE))

    def partitions(self) -> list[Revisions]:
        if not has_history(self.root):
            return [Revisions("", 0, 0)]
        head = _git(self.root, "rev-parse", "HEAD").decode().strip()
        n = int(_git(self.root, "rev-list", "--count", head))
        return [Revisions(head, i, min(self.size, n - i)) for i in range(0, n, self.size)]

    def read(self, partition: Revisions) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        told = _git(self.root, "log", "--topo-order", f"--skip={partition.skip}", f"--max-count={partition.count}", "--format=%H%x09%P%x09%at%x09%ae", partition.head)
        wanted = {}
        for line in told.decode("utf-8", "replace").splitlines():
            sha, parents, at, author = line.split("\t", 3)
            if int(at) >= self.since:
                wanted[sha] = (parents.split()[:1], int(at), author)
        shas = list(wanted)
        for i in range(0, len(shas), CALL):
            rows = list(self._changes(shas[i : i + CALL], wanted))
            if rows:
                sha, path, old, added, removed = zip(*rows, strict=True)
                ts = pa.array([wanted[s][1] * 1_000_000 for s in sha], pa.int64()).cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sha), pa.array([wanted[s][2] for s in sha]), ts, pa.array(path), pa.array(old, pa.string()), pa.array(added, pa.int64()), pa.array(removed, pa.int64())], names=["sha", "author", "ts", "path", "old_path", "added", "removed"]
                )

    def _changes(self, shas, wanted) -> Iterator[tuple]:
        given = "".join(f"{' '.join([s, *wanted[s][0]])}\n" for s in shas).encode()
        how = ["--numstat", "-M"] if self.mode == "numstat" else ["--name-status", "--no-renames"]
        fields = iter(_git(self.root, "diff-tree", "--stdin", "--root", "-r", "-z", "--relative", *how, given=given).split(b"\0"))
        text = lambda b: b.decode("utf-8", "replace")
        sha = ""
        for field in fields:
            field = field.lstrip(b"\n")
            if not field:
                continue
            if _SHA.fullmatch(field):
                sha = field.decode()
            elif self.mode == "paths":
                yield sha, text(next(fields)), None, 0, 0
            else:
                added, removed, path = field.split(b"\t", 2)
                old = None if path else text(next(fields))
                yield sha, text(path) if path else text(next(fields)), old, *(int(x) if x.isdigit() else 0 for x in (added, removed))


class PushingReader(CommitReader):
    def pushFilters(self, filters):
        """Takes lower bounds of ``ts``; Spark still applies every condition that is given back."""
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("ts",) and isinstance(f.value, dt.datetime):
                self.since = max(self.since, f.value.timestamp())
            yield f


def commits(spark: SparkSession, root: str, since: dt.datetime | None = None, mode: str = "numstat", size: int = RANGE) -> DataFrame:
    """The changed files of all commits since an author time, or of all."""
    spark.dataSource.register(Commits)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("commits").option("path", root).option("mode", mode).option("range", str(size)).option("pushdown", push)
    return (reader.option("since", str(since.timestamp())) if since else reader).load()


#: Files a task at most, so that a large repository is many tasks.
GROUP = 50


def blame(files: DataFrame, root: str, parts: int | None = None) -> DataFrame:
    """``files(path)`` -> ``(path, line, author, author_time)`` of every line of theirs that git knows.

    Git tells stretches of lines with one origin, a row each; lines are made of them by expressions. A file
    that git does not know has no rows.
    """

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    told = _git(root, "blame", "--incremental", "HEAD", "--", path)
                except subprocess.CalledProcessError:
                    continue
                rows = list(origins(told.decode("utf-8", "replace")))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)]], names=["path", "first", "n", "author", "at"])

    paths = files.select("path").where("path is not null").distinct()
    n = parts or max(1, -(-paths.count() // GROUP))
    spans = paths.repartition(n, "path").mapInArrow(run, "path string, first int, n int, author string, at long")
    who = F.when(F.trim("author") != "", F.trim("author")).otherwise("unknown")
    return spans.select("path", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("line"), who.alias("author"), F.timestamp_seconds("at").alias("author_time"))


def origins(told: str) -> Iterator[tuple[int, int, str, int | None]]:
    """``(first line, lines, author, author time)`` of each stretch in incremental blame output; the facts of a commit are told once."""
    known: dict[str, dict] = {}
    cur, first, n = {}, 0, 0
    for line in told.splitlines():
        word, _, rest = line.partition(" ")
        if len(word) >= 40 and not word.strip("0123456789abcdef"):
            _, a, b = rest.split()
            cur, first, n = known.setdefault(word, {}), int(a), int(b)
        elif word == "filename":
            at = cur.get("author-time", "")
            yield first, n, cur.get("author", ""), int(at) if at.isdigit() else None
        else:
            cur[word] = rest
