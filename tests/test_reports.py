import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalog, history, reports
from lodestone.sources import export, store

NOW = dt.datetime(2024, 6, 30)
COMMITS = "path string, author string, ts timestamp, added long, removed long, sha string"
FOUND = "path string, rule_id string, line int, `column` int, message string, snippet string, severity string, confidence string, fingerprint string, metadata string"


def now():
    return F.lit("2024-06-30 00:00:00").cast("timestamp")


def days(n):
    return NOW - dt.timedelta(days=n)


def commits(spark, rows):
    return spark.createDataFrame([(p, a, days(n), x, y, str(i)) for i, (p, a, n, x, y) in enumerate(rows)], COMMITS)


def test_history_of_the_seed_repository(spark):
    a, b = "a@x", "b@x"
    log = [("src/one.cs", a, 220, 10, 2), ("src/one.cs", a, 150, 5, 0), ("src/two.cs", a, 220, 600, 0), ("docs/r.md", a, 150, 1, 1), ("src/new.cs", b, 10, 4, 4), ("src/new.cs", a, 150, 1, 0), ("src/old.cs", a, 500, 900, 0), ("SRC/ONE.CS", a, 500, 7, 7)]
    files = spark.createDataFrame([(p, c) for p, c in (("src/one.cs", "Source"), ("src/two.cs", "Source"), ("docs/r.md", "Docs"), ("src/new.cs", "Source"), ("src/old.cs", "Source"), ("src/never.g.cs", "Source"))], "path string, category string")
    m = {r.path: r for r in history.file_metrics(files, commits(spark, log), now()).collect()}
    one = m["src/one.cs"]
    assert (one.commits_365d, one.commits_180d, one.commits_90d, one.authors, one.concentration, one.lines_added, one.lines_removed, one.top_author, one.top_author_pct) == (2, 1, 0, 1, 1.0, 15, 2, a, 1.0)
    assert one.churn_score == pytest.approx(2 * math.log(18), abs=1e-4) and one.stale_score == pytest.approx(1 - math.exp(-150 / 180), abs=1e-6) and one.ownership_risk and not one.never_changed
    assert m["src/two.cs"].never_changed and m["docs/r.md"].stale_score is None and m["src/never.g.cs"].stale_score is None and not m["src/new.cs"].ownership_risk
    old = m["src/old.cs"]
    assert (old.commits_365d, old.concentration, old.top_author, old.last_commit_at) == (0, 0.0, None, days(500)) and old.stale_score == pytest.approx(1 - math.exp(-500 / 180), abs=1e-6) and not old.never_changed
    found = {(r.path, r.rule_id.split(".")[-1]) for r in history.history_findings(history.file_metrics(files, commits(spark, log), now())).collect()}
    assert found == {("docs/r.md", "orphaned_knowledge_risk"), ("src/one.cs", "orphaned_knowledge_risk"), ("src/two.cs", "orphaned_knowledge_risk"), ("src/two.cs", "never_changed_since_import"), ("src/old.cs", "file_risk")}


def test_top_author_ties_and_gini(spark):
    log = commits(spark, [("p", "Zoe", 3, 0, 0), ("p", "zoe", 9, 0, 0), ("p", "amy", 4, 0, 0), ("p", "amy", 8, 0, 0), ("p", "bob", 1, 0, 0), ("q", "b", 5, 0, 0), ("q", "a", 5, 0, 0)])
    assert {r.path: (r.top_author, r.top_author_pct) for r in history.top_author(log).collect()} == {"p": ("Zoe", 0.4), "q": ("a", 0.5)}
    r = random.Random(2)
    rows = [(f"f{i % 7}", f"w{r.randrange(i % 7 + 1)}", r.randrange(300), 1, 1) for i in range(400)]
    want = {}
    for p in {x[0] for x in rows}:
        counts = sorted([sum(1 for x in rows if x[:2] == (p, a)) for a in {x[1] for x in rows if x[0] == p}])
        n, total = len(counts), sum(counts)
        want[p] = 1.0 if n == 1 else 2 * sum((i + 1) * x for i, x in enumerate(counts)) / (n * total) - (n + 1) / n
    assert {x.path: x.concentration for x in history.gini(commits(spark, rows)).collect()} == pytest.approx(want, abs=1e-6)


def test_ageing_bounds(spark):
    ages = spark.createDataFrame([(x,) for x in (0.0, 29.9, 30.0, 90.0, 91.0, 180.0, 365.0, 365.5, None)], "age_days double")
    assert [r.n for r in history.ageing(ages).orderBy("bucket").collect()] == [2, 2, 2, 1, 1]
    assert [r.n for r in history.ageing(ages.limit(0)).orderBy("bucket").collect()] == [0] * 5


def test_modules_renames_and_newest_commits(spark):
    paths = ["a/b/App.csproj", "a/b/c/x.cs", "a/y.cs", "Root.csproj", "z.cs", "A/B/q.cs", "w/Cargo.toml", "w/v/u/t.rs"]
    f = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.module_project for r in history.project_keys(f).collect()}
    assert got == {"a/b/App.csproj": "a/b/App.csproj", "a/b/c/x.cs": "a/b/App.csproj", "a/y.cs": "a", "Root.csproj": ".", "z.cs": ".", "A/B/q.cs": "a/b/App.csproj", "w/Cargo.toml": "w/Cargo.toml", "w/v/u/t.rs": "w/Cargo.toml"}
    assert {r.path: r.module_service for r in history.service_keys(f, [("one", "a/*"), ("two", "*.cs")]).collect()}["z.cs"] == "two"
    changes = spark.createDataFrame([("a/Y.cs", None, 1), ("gone.cs", "z.cs", 2), ("gone.cs", "also.cs", 3)], "path string, old_path string, n int")
    assert sorted((r.path, r.n) for r in history.tracked(changes, f).collect()) == [("a/y.cs", 1), ("z.cs", 2)]
    log = commits(spark, [("p", "a", n, 0, 0) for n in (5, 1, 3)])
    assert sorted((r.place, r.ts) for r in history.newest_commits(log).collect()) == [(1, days(1)), (2, days(3))]


def tree(spark, n, seed):
    r, rows = random.Random(seed), []
    for i in range(n):
        folders = [r.choice(["a", "B", "c"]) for _ in range(r.randrange(4))]
        rows.append((i, "/".join([*folders, f"f{i}"]), r.choice([0, 0, 1, 5, 100]), *[float(r.randrange(10)) for _ in reports.METRICS]))
    return rows, spark.createDataFrame(rows, "file_id long, file_path string, size_bytes long, " + ", ".join(f"{m} double" for m in reports.METRICS))


def test_folders_from_the_leaves_up_with_files_of_no_bytes(spark):
    rows, heat = tree(spark, 60, 3)

    def fold(prefix):
        """(size, files, metric) of a folder by recursion."""
        size = files = total = weighted = 0
        inner = {}
        for _, p, b, churn, *_ in rows:
            if p.startswith(prefix):
                rest = p[len(prefix) :].split("/")
                if len(rest) == 1:
                    size, files, total, weighted = size + b, files + 1, total + max(b, 1), weighted + max(b, 1) * churn
                else:
                    inner[rest[0]] = None
        for d in inner:
            s, n, m = fold(f"{prefix}{d}/")
            w = max(s, n)
            size, files, total, weighted = size + s, files + n, total + w, weighted + w * m
        return size, files, weighted / total

    got = {r.directory: (r.size_bytes, r.files, r.churn_score) for r in reports.directories(heat).collect()}
    assert got["."] == pytest.approx(fold(""), abs=1e-5)
    for d, v in got.items():
        if d != ".":
            assert v == pytest.approx(fold(f"{d}/"), abs=1e-5)
    assert len(got) == 1 + len({"/".join(p.split("/")[:i]) for _, p, *_ in rows for i in range(1, p.count("/") + 1)})
    walk = [r.directory for r in reports.directory_aggregates(heat).collect()]
    size, by = {d: v[0] for d, v in got.items()}, {}
    for d in size:
        by.setdefault("" if d == "." else d.rpartition("/")[0] or ".", []).append(d)

    def steps(d):
        return [d] + [x for c in sorted(by.get(d, []), key=lambda c: (-size[c], c.upper())) for x in steps(c)]

    assert walk == steps(".")


def test_tree_drilldown_and_nesting(spark):
    _, heat = tree(spark, 40, 5)
    top = reports.nested(reports.treemap(heat))
    kinds = [c["is_directory"] for c in top["children"]]
    assert kinds == sorted(kinds, reverse=True) and top["files"] == 40
    sizes = [c["size_bytes"] for c in top["children"] if c["is_directory"]]
    assert sizes == sorted(sizes, reverse=True)
    assert reports.drilldown(heat, "no/such").count() == 0 and reports.drilldown(heat, ".").first().files == 40 and reports.drilldown(heat, "b/").first().files == reports.drilldown(heat, "B").first().files
    assert reports.most(heat).first().most == 9.0 and reports.most(heat.limit(0)).first().most == 0.0


def found(spark, *rows):
    base = {"path": "a.cs", "rule_id": "hygiene.fixme", "line": 1, "column": 1, "message": "m", "snippet": None, "severity": "Warning", "confidence": "High", "fingerprint": "F", "metadata": None}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], FOUND)


def test_store_writes_clears_and_appends(spark, tmp_path):
    root = str(tmp_path / "s")
    files = spark.createDataFrame([("a.cs", "Source", 5, "h1", "csharp"), ("B.cs", "Source", 6, "h2", "csharp")], "path string, category string, size_bytes long, hash string, language string")
    rules = catalog.builtin(spark)
    run = {"run_id": "r1", "repo_root": "/x", "started_at": days(2), "tool_version": "1"}
    metrics = spark.createDataFrame([("a.cs", 3, 1.5), ("gone.cs", 1, 2.0)], "path string, commits_90d long, churn_score double")
    store.ensure(spark, root)
    assert store.read(spark, root).findings.count() == 0
    for _ in range(2):
        store.write_run(spark, root, run, files, found(spark, {}, {"path": "b.CS", "line": 2}, {"path": "gone.cs"}), rules, metrics)
    s = store.read(spark, root)
    assert sorted((r.file_path, r.line) for r in s.findings.collect()) == [("B.cs", 2), ("a.cs", 1)] and s.files.count() == 2 and s.runs.count() == 1 and [(r.file_path, r.churn_score) for r in s.metrics.collect()] == [("a.cs", 1.5)]
    ids = {r.finding_id for r in s.findings.collect()}
    more = spark.createDataFrame([("A.CS", "Docs", 9, "new", None), ("c.cs", "Source", 1, "h3", None)], files.schema)
    second = run | {"started_at": days(1), "repo_root": "/y"}
    store.write_run(spark, root, second, more, found(spark, {"path": "c.cs", "fingerprint": "G"}), rules.limit(1).withColumn("title", F.lit("changed")), clear=False)
    s = store.read(spark, root)
    assert {r.path: r.hash for r in s.files.collect()} == {"a.cs": "h1", "B.cs": "h2", "c.cs": "h3"} and ids < {r.finding_id for r in s.findings.collect()} and s.runs.first().repo_root == "/y" and s.metrics.count() == 1
    store.write_run(spark, root, {"run_id": "r2", "started_at": days(0)}, files, found(spark, {}), rules)
    s = store.read(spark, root)
    assert s.rules.count() == 53 and s.rules.where("title = 'changed'").count() == 0 and s.runs.count() == 2 and s.findings.where("run_id = 'r2'").count() == 1
    store.write_run(spark, root, second, files, found(spark).limit(0), rules)
    assert store.read(spark, root).findings.where("run_id = 'r1'").count() == 0
    store.delete_run(spark, root, "r2")
    assert store.read(spark, root).findings.count() == 0 and store.read(spark, root).runs.count() == 2


def test_suppressions_by_their_metadata(spark):
    rows = [None, "not json", "{}", '{"suppressed": true, "suppressionReason": "why"}', '{"isSuppressed":"True","reason":"r2"}', '{"suppressed":false,"suppressionSource":" INLINE "}', '{"suppressed":true,"x":"AllowList"}', '{"suppressed":true,"x":"Inline"}', '{"suppressed":true,"suppressionSource":"odd"}']
    f = spark.createDataFrame([(m,) for m in rows], "metadata string").select(reports.suppressed().alias("s"), reports.suppression_reason().alias("r"), reports.suppression_source().alias("w"), reports.suppression_source(None).alias("n"), reports.artifact_path().alias("p"))
    got = [tuple(r) for r in f.collect()]
    assert [g[0] for g in got] == [False, False, False, True, True, False, True, True, True] and got[3][1] == "why" and got[4][1] == "r2"
    assert [g[2] for g in got] == ["config", "config", "config", "config", "config", "inline", "allowlist", "inline", "config"] and [g[3] for g in got][:4] == [None] * 4 and {g[4] for g in got} == {"$"}


def test_exit_codes_and_console(spark):
    f = found(spark, {}, {"severity": "Info", "path": "b"}).withColumnRenamed("path", "file_path")
    assert [reports.exit_code(f, x) for x in ("Error", "warning", "Info")] == [0, 1, 1] and reports.exit_code(f.limit(0), "Info") == 0 and reports.exit_code(f, errors=1) == 2
    assert {(r.kind, r.name, r.n) for r in reports.console_summary(f).collect()} == {("severity", "Warning", 1), ("severity", "Info", 1), ("file", "a.cs", 1), ("file", "b", 1), ("rule", "hygiene.fixme", 2)}


def test_exports(spark, tmp_path):
    f = found(spark, {"message": 'say "x" <b>', "line": 0, "severity": "Error"}, {"path": "b", "severity": "Info"}).withColumnRenamed("path", "file_path").withColumn("run_id", F.lit("r")).orderBy("file_path")
    run = {"run_id": "r<", "tool_version": "1"}
    for kind in ("json", "sarif", "html", "csv", "parquet"):
        export.export(f, str(tmp_path / kind), kind, run=run, filters={"severity": ""})
    doc = json.loads((tmp_path / "json").read_text())
    assert doc["run"]["run_id"] == "r<" and doc["filters"] == {"severity": ""} and [x["file_path"] for x in doc["findings"]] == ["a.cs", "b"] and doc["findings"][0]["snippet"] is None
    sarif = json.loads((tmp_path / "sarif").read_text())
    assert sarif["version"] == "2.1.0" and [(x["ruleId"], x["level"], x["locations"][0]["physicalLocation"]["region"]) for x in sarif["runs"][0]["results"]] == [("hygiene.fixme", "error", {"startLine": 1, "startColumn": 1}), ("hygiene.fixme", "note", {"startLine": 1, "startColumn": 1})]
    assert [(r["id"], r["defaultConfiguration"]["level"]) for r in sarif["runs"][0]["tool"]["driver"]["rules"]] == [("hygiene.fixme", "error")]
    page = (tmp_path / "html").read_text()
    assert "r&lt;" in page and "say &quot;x&quot; &lt;b&gt;" in page and page.count("<tr>") == 3
    lines = [p.read_text() for p in sorted((tmp_path / "csv").glob("part-*"))]
    assert lines[0].splitlines()[0] == ",".join(f'"{c}"' for c in export.COLUMNS) or lines[0].splitlines()[0] == ",".join(export.COLUMNS)
    assert any('"say ""x"" <b>"' in x for x in lines) and spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    with pytest.raises(ValueError):
        export.export(f, str(tmp_path / "x"), "pdf")
    export.export(f.limit(0), str(tmp_path / "none"), "sarif")
    assert json.loads((tmp_path / "none").read_text())["runs"][0]["results"] == []


def test_catalogue_of_rules(spark):
    assert len(catalog.RULES) == 53 and catalog.merged({"A.b": "Info"}, {"a.B": "Error"}) == {"a.B": "Error"}
    one = spark.createDataFrame([("HYGIENE.fixme", "mine", "Info", "")], "rule_id string, title string, default_severity string, description string")
    got = {r.rule_id: r.title for r in catalog.first_wins(one, catalog.builtin(spark)).collect()}
    assert len(got) == 53 and got["HYGIENE.fixme"] == "mine" and "hygiene.fixme" not in got


@pytest.mark.parametrize(("sort", "descending"), [("severity", False), ("line", False), ("line", True), ("rule", True), ("path", False), ("confidence", True)])
def test_pages_by_cursor_follow_each_other(spark, sort, descending):
    rows = [("r", i, 1, f"rule{i % 3}", f"p{i % 4}", None if i % 5 == 0 else i % 2, ("Error", "Info")[i % 2], ("High", "Low")[i % 2], None) for i in range(23)]
    found = spark.createDataFrame(rows, "run_id string, finding_id int, file_id int, rule_id string, file_path string, line int, severity string, confidence string, metadata string")
    files = spark.createDataFrame([("r", 1, "Source", "csharp")], "run_id string, file_id int, category string, language string")
    rules = spark.createDataFrame([("rule1", "t", "d")], "rule_id string, title string, description string")
    want = [r.finding_id for r in reports.findings_page(found, files, rules, "r", 0, 500, sort, descending).collect()]
    cursor, got = None, []
    while page := reports.findings_after(found, files, rules, "r", cursor, 9, sort, descending).orderBy(*([F.desc("page_key")] if descending else ["page_key"]), "finding_id").collect():
        got += [r.finding_id for r in page]
        cursor = (page[-1].page_key, page[-1].finding_id)
    assert got == want and len(got) == 23
