import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalog
from lodestone.sources import export, store

AT = dt.datetime(2024, 1, 1)


def files(spark, *paths):
    return spark.createDataFrame([(p, "Source", 1, "h", None) for p in paths], "path string, category string, size_bytes long, hash string, language string")


def found(spark, *paths):
    row = ("hygiene.fixme", 1, 1, "m", None, "Warning", "High", "f", None)
    return spark.createDataFrame([(p, *row) for p in paths], "path string, rule_id string, line int, `column` int, message string, snippet string, severity string, confidence string, fingerprint string, metadata string")


def write(spark, root, run, *paths, clear=True):
    store.write_run(spark, root, {"run_id": run, "repo_root": run, "started_at": AT}, files(spark, *paths), found(spark, *paths), catalog.builtin(spark), clear=clear)


def seen(spark, root, number=None):
    s = store.read(spark, root, number)
    return sorted((r.run_id, r.file_path) for r in s.findings.collect()), sorted(r.run_id for r in s.runs.collect()), s.files.count()


@pytest.mark.parametrize("step", range(6))
def test_a_write_that_dies_leaves_the_old_run(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "s")
    write(spark, root, "r", "a.cs")
    calls = []

    def dying(real):
        def f(*a, **k):
            calls.append(1)
            if len(calls) == step + 1:
                raise KeyboardInterrupt
            return real(*a, **k)

        return f

    monkeypatch.setattr(store, "_write", dying(store._write))
    monkeypatch.setattr(store, "_claim", dying(store._claim))
    if step < 5:  # runs, rules, files, findings, the commit itself
        with pytest.raises(KeyboardInterrupt):
            write(spark, root, "r", "b.cs", "c.cs")
        assert seen(spark, root) == ([("r", "a.cs")], ["r"], 1)
    else:
        write(spark, root, "r", "b.cs", "c.cs")
        assert seen(spark, root) == ([("r", "b.cs"), ("r", "c.cs")], ["r"], 2)


def test_writers_of_other_runs_are_both_kept_and_of_one_run_the_second_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    write(spark, root, "r", "a.cs")
    real, other = store._claim, []

    def late(*a):
        if other:
            run = other.pop()
            write(spark, root, run, "x.cs")
        return real(*a)

    monkeypatch.setattr(store, "_claim", late)
    other.append("q")
    write(spark, root, "r", "b.cs")  # q is committed between the writing of r and its commit
    assert seen(spark, root)[0] == [("q", "x.cs"), ("r", "b.cs")]
    other.append("r")
    with pytest.raises(store.Conflict):
        write(spark, root, "r", "c.cs", clear=False)
    assert seen(spark, root)[0] == [("q", "x.cs"), ("r", "x.cs")]


def test_snapshots_are_kept_until_vacuum(spark, tmp_path):
    root = str(tmp_path / "s")
    store.ensure(spark, root)
    assert seen(spark, root) == ([], [], 0)
    write(spark, root, "r", "a.cs")
    write(spark, root, "r", "a.cs", "B.cs", clear=False)
    write(spark, root, "q", "z.cs")
    assert store.snapshots(spark, root) == [1, 2, 3] and seen(spark, root, 1) == ([("r", "a.cs")], ["r"], 1)
    assert seen(spark, root) == ([("q", "z.cs"), ("r", "B.cs"), ("r", "a.cs"), ("r", "a.cs")], ["q", "r"], 3)  # the second write told of a.cs again
    store.delete_run(spark, root, "r", tuple(store.TABLES))
    assert seen(spark, root) == ([("q", "z.cs")], ["q"], 1) and len(seen(spark, root, 3)[0]) == 4
    assert store.vacuum(spark, root, 1) > 0 and store.snapshots(spark, root) == [4] and seen(spark, root) == ([("q", "z.cs")], ["q"], 1) and store.vacuum(spark, root, 1) == 0


def test_documents_are_the_same_bytes_whatever_the_partitions_and_the_file_system(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.far.link./out", f"file://{tmp_path}")
    rows = spark.range(500).select(F.format_string("f%04d", "id").alias("file_path"), F.lit("r.x").alias("rule_id"), F.lit("Error").alias("severity"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit('é "q" \\ \n<b>').alias("message"), F.lit("p").alias("fingerprint"))
    for kind in ("json", "sarif", "html"):
        told = []
        for n in (1, 3, 7):
            dealt = rows.repartitionByRange(n, "file_path").sortWithinPartitions("file_path")
            export.export(dealt, f"viewfs://far/out/{kind}{n}", kind, run={"run_id": "r"})
            told.append((tmp_path / f"{kind}{n}").read_bytes())
        assert told[0] == told[1] == told[2]
    doc = json.loads((tmp_path / "json3").read_text(encoding="utf-8"))
    assert len(doc["findings"]) == 500 and doc["findings"][7]["message"] == 'é "q" \\ \n<b>' and len(json.loads((tmp_path / "sarif7").read_text(encoding="utf-8"))["runs"][0]["results"]) == 500
    assert not [p for p in tmp_path.iterdir() if p.name.endswith((".parts", ".tmp"))]
    export.export(rows.limit(0), "viewfs://far/out/json1", "json")  # in place of the one that is there
    assert json.loads((tmp_path / "json1").read_text())["findings"] == []
