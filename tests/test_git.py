import datetime as dt
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.operators import hygiene, reports, scan
from lodestone.sources import git, store

START = 1_600_000_000


def run(root, *args, given=None):
    return subprocess.run(["git", "-C", str(root), *args], input=given, capture_output=True, check=True).stdout.decode()


def put(sign, author, at, changes, parents=()):
    """One commit for ``git fast-import``."""
    head = f"commit refs/heads/main\nmark :{sign}\nauthor {author} <{author}@x> {at} +0000\ncommitter C <c@x> {at} +0000\ndata 1\nm\n"
    return head + "".join(f"{word} :{p}\n" for word, p in parents) + changes + "\n"


def body(path, text):
    return f"M 100644 inline {path}\ndata {len(text.encode())}\n{text}\n"


@pytest.fixture(scope="module")
def history(tmp_path_factory):
    """10,000 commits over 60 files, one rename, one merge and one binary file."""
    root = tmp_path_factory.mktemp("history")
    run(root, "init", "-q", "-b", "main")
    out = []
    for i in range(1, 9_998):
        text = "\n".join(f"{j} {i if (i + j) % 4 == 0 else 0}" for j in range(6))
        out.append(put(i, f"a{i % 5}", START + 3600 * i, body(f"d{i % 3}/f é{i % 60}.txt", text)))
    out.append(put(9_998, "r", START + 3600 * 9_998, "R \"d0/f \\303\\2510.txt\" moved.txt\n"))
    out.append(put(9_999, "b", START + 3600 * 9_997, "M 100644 inline b.bin\ndata 3\n\0x\0\n", [("from", 9_000)]))
    out.append(put(10_000, "m", START + 3600 * 10_000, "M 100644 inline b.bin\ndata 3\n\0x\0\n", [("from", 9_998), ("merge", 9_999)]))
    run(root, "fast-import", "--quiet", "--force", given="".join(out).encode())
    run(root, "reset", "-q", "--hard", "main")
    return str(root)


def test_commits_are_read_by_ranges(spark, history):
    got = git.commits(spark, history)
    assert got.rdd.getNumPartitions() == 10
    want, sha, author, at = {}, None, None, None
    log = run(history, "-c", "core.quotePath=false", "log", "-m", "--first-parent", "--numstat", "--no-renames", "--format=@%H %ae %at")
    for line in log.splitlines():
        if line.startswith("@"):
            sha, author, at = line[1:].split()
        elif line:
            added, removed, path = line.split("\t")
            want[sha, path] = (author, int(at), *(0 if x == "-" else int(x) for x in (added, removed)))
    rows = got.select("sha", "path", "old_path", "author", F.unix_seconds("ts").alias("at"), "added", "removed").collect()
    moved = [r for r in rows if r.old_path]
    assert [(r.path, r.old_path, r.added, r.removed) for r in moved] == [("moved.txt", "d0/f é0.txt", 0, 0)]
    plain = {(r.sha, r.path): (r.author, r.at, r.added, r.removed) for r in rows if not r.old_path}
    side = {k for k in plain if plain[k][0] == "b@x"}  # off the first-parent line, so not in the plain log
    assert {k: v for k, v in plain.items() if k not in side} == {k: v for k, v in want.items() if k[0] != moved[0].sha} and len(side) == 1
    assert ("m@x", 0, 0) in {(v[0], *v[2:]) for k, v in plain.items() if k[1] == "b.bin"}
    paths = git.commits(spark, history, mode="paths")
    assert {(r.sha, r.path) for r in paths.collect()} == set(plain) | {(moved[0].sha, p) for p in ("moved.txt", "d0/f é0.txt")}


def test_author_times_are_pushed_down(spark, history):
    since = dt.datetime.fromtimestamp(START + 3600 * 9_990, dt.timezone.utc)
    assert git.commits(spark, history, since).count() == 11
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        late = git.commits(spark, history).where(F.col("ts") >= F.lit(since))
        assert late.count() == 11 and sorted(r.path for r in late.where("author = 'r@x'").collect()) == ["moved.txt"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="no such mode"):
        git.commits(spark, history, mode="x").count()


def test_blame_of_all_lines_equals_porcelain(spark, history):
    names = [n for n in run(history, "ls-files", "-z").split("\0") if n]
    files = spark.createDataFrame([(n,) for n in [*names, "absent", None]], "path string")
    told = [(n, run(history, "blame", "--line-porcelain", "--", n)) for n in names if n != "b.bin"]
    want = hygiene.parse_blame(spark.createDataFrame(told, "path string, text string"))
    got = git.blame(files.where("path is null or path <> 'b.bin'"), history, 4)
    key = lambda df: sorted((r.path, r.line, r.author, r.author_time) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) > 300


def test_no_history_has_no_rows(spark, tmp_path):
    assert git.commits(spark, str(tmp_path)).count() == 0 and git.blame(spark.createDataFrame([("a",)], "path string"), str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    """A repository with something for every scan, its side files and three years of history."""
    root = tmp_path_factory.mktemp("repository")
    run(root, "init", "-q", "-b", "main")
    old, now = START, START + 3 * 365 * 86_400
    files = {
        "src/Old.cs": "// TODO tidy\nvar f = flags.IsEnabled(\"OldPanel\");\nvar u = new Uri(\n    \"http://10.1.2.3/\");\n",
        "src/Spared.cs": "var u = new Uri(\"http://10.9.9.9/\");\n",
        "src/Words.cs": "a(\"needle-in-hay\"); b(\"needle-in-hay\"); c(\"listed-word\"); d(\"listed-word\");\n",
        "cfg/app.dev.json": '{"a": "1", "b": "x"}', "cfg/app.prod.json": '{"a": "2"}',
        "requirements.txt": "alpha==1.0\nbeta\n",
        "rules/rules.yaml": "rules:\n  deps.unpinned_version: error\nsettings:\n  churn:\n    sinceDays: 2000\n",
        "lodestone.suppressions.yaml": "- path: src/Spared.cs\n  rule: portability.hardcoded.ipv4\n",
        "lodestone.literals.yaml": "minOccurrences: 2\nallowlist: [listed-word]\n",
        "service-map.txt": "core=src/*\n",
    }
    out = [put(1, "ann", old, "".join(body(p, t) for p, t in files.items()))]
    out += [put(i, "ann", old + i, body("src/Busy.cs", f"int x = {i};\n")) for i in range(2, 12)]
    out.append(put(12, "bob", now - 86_400, body("src/Busy.cs", "int x = 0;\n// HACK now\n")))
    run(root, "fast-import", "--quiet", "--force", given="".join(out).encode())
    run(root, "reset", "-q", "--hard", "main")
    return str(root), dt.datetime.fromtimestamp(now, dt.timezone.utc)


def test_scan_knows_history_blame_and_side_files(spark, repository, tmp_path):
    root, now = repository
    advice = spark.createDataFrame([("PyPI", "alpha", "1.0", "A-1", "9.8", "bad")], "ecosystem string, name string, version string, advisory_id string, score string, summary string")
    assert scan.scan_repository(spark, root, str(tmp_path / "s"), "r1", now, advisories=advice) == 1
    s = store.read(spark, str(tmp_path / "s"))
    found = {(r.file_path, r.rule_id, r.line): r for r in s.findings.collect()}
    assert {
        ("src/Old.cs", "hygiene.todo_old", 1), ("src/Old.cs", "hygiene.stale_feature_flag", 2), ("src/Old.cs", "portability.hardcoded.ipv4", 4), ("src/Busy.cs", "hygiene.hack", 2),
        ("requirements.txt", "deps.vulnerable.critical", 1), ("requirements.txt", "deps.unpinned_version", 2), ("src/Words.cs", "magic-string.candidate", 1), ("cfg/app.dev.json", "config.drift.orphan_key", 1),
    } <= set(found)
    assert not [k for k in found if k[0] == "src/Spared.cs"] and not [r for r in found.values() if "listed-word" in r.message]
    assert '"ageDays":1095' in found["src/Old.cs", "hygiene.todo_old", 1].metadata and '"author":"ann"' in found["src/Old.cs", "hygiene.todo_old", 1].metadata
    m = {r.file_path: r for r in s.metrics.collect()}
    assert (m["src/Busy.cs"].commits_30d, m["src/Busy.cs"].commits_365d, m["src/Busy.cs"].lines_added) == (1, 1, 12) and m["src/Old.cs"].last_commit_at.timestamp() == START
    assert found["requirements.txt", "deps.unpinned_version", 2].severity == "Error"


def test_orphaned_files_name_their_modules(spark, repository):
    root, _ = repository
    c = scan.context(spark, root, dt.datetime.fromtimestamp(START + 200 * 86_400, dt.timezone.utc))
    found, metrics = scan.run(c, ["churn"])
    got = found.where("path = 'src/Old.cs'").collect()
    assert [r.rule_id for r in got] == ["churn.ownership.orphaned_knowledge_risk"] and '"moduleDirectory":"src"' in got[0].metadata and '"moduleService":"core"' in got[0].metadata
    assert c.since_days == 2000 and scan.context(spark, root, c.now, since="30d").since_days == 30
    hot = reports.console_summary(found.withColumnRenamed("path", "file_path"), metrics=metrics.withColumnRenamed("path", "file_path")).where("kind = 'hotspot'").first()
    assert hot.name == "src/Busy.cs"


def test_a_detector_of_ones_own_takes_part(spark, repository):
    root, now = repository

    @scan.detector("own")
    def own(c):
        return scan.portability_scan(c.files.where("path = 'src/Old.cs'"), c.bundle).withColumn("rule_id", F.lit("team.own"))

    try:
        found, _ = scan.run(scan.context(spark, root, now), ["own", "hygiene"])
        assert {"team.own", "hygiene.todo_old"} <= {r.rule_id for r in found.collect()}
    finally:
        del scan.DETECTORS["own"]
    with pytest.raises(ValueError, match="own"):
        scan.run(scan.context(spark, root, now), ["own"])


def test_commands(spark, repository, tmp_path):
    root, _ = repository
    said: list[str] = []
    assert cli.main(["rules", "list", "--repo", root], say=said.append) == 0 and "deps.unpinned_version\tError\ton\tbuilt-in" in said
    out = str(tmp_path / "s")
    assert cli.main(["scan", "deps", "--repo", root, "--store", out, "--run-id", "x"], spark, said.append) == 1 and "rule\tdeps.unpinned_version\t1" in said
    assert cli.main(["scan", "hygiene", "--repo", root, "--store", out, "--run-id", "x", "--append", "--rule", "hygiene.hack=off"], spark, said.append) == 1
    rules = {r.rule_id for r in store.read(spark, out).findings.collect()}
    assert {"deps.unpinned_version", "hygiene.todo_old"} <= rules and "hygiene.hack" not in rules
    bad = tmp_path / "bad"
    (bad / "rules").mkdir(parents=True)
    (bad / "rules" / "rules.yaml").write_text("rules:\n  no.such: error\n")
    assert cli.main(["rules", "validate", "--repo", str(bad)], say=said.append) == 2 and any("no.such" in x for x in said)
    assert cli.main(["scan", "all", "--repo", str(bad), "--store", out], spark, said.append) == 2
    assert cli.main(["rules", "init", "--repo", str(tmp_path)], say=said.append) == 0 and os.path.exists(tmp_path / "rules" / "allowlist.yaml")
