import random
import re
import time

from pyspark.sql import functions as F

from lodestone.functions import globs
from lodestone.operators import patterns, portability, scan
from lodestone.operators.history import service_keys
from lodestone.sources import config

FINDING = "rule_id string, path string, message string, snippet string, fingerprint string, severity string"
PARTS = ("src", "Lib", "a b", "x.y", "deep")


def paths(rng, n):
    return ["/".join(rng.choice(PARTS) for _ in range(rng.randrange(4))) + ("/" if rng.random() < 0.9 else "") + f"f{rng.randrange(9)}.cs" for _ in range(n)]


def some_globs(rng, n):
    out = []
    for p in paths(rng, n):
        p = p.upper() if rng.random() < 0.2 else p
        k = rng.randrange(5)
        out.append(p if k == 0 else p[: rng.randrange(len(p))] + "**" if k == 1 else re.sub("[0-9]", "?", p) if k == 2 else "**/" + p.rpartition("/")[2] if k == 3 else p.replace("src", "*"))
    return out


def test_thousands_of_entries_plan_quickly_and_cover_what_they_cover_one_by_one(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["r.A", "R.b", None]), p, f"m{rng.randrange(3)}", None if rng.random() < 0.3 else "s1", f"P{rng.randrange(4)}", "Warning") for p in [*paths(rng, 300), None]]
    findings = spark.createDataFrame(rows, FINDING)
    for dialect in (globs.strict, globs.loose):
        entries = [{"path": g, "rule": rng.choice(["R.a", "r.b"]), "pattern": rng.choice([None, "M1", "s1$"]), "fingerprint": rng.choice([None, None, "p1"])} for g in some_globs(rng, 60)]

        def covers(e, r):
            rule, path, message, snippet, mark, _ = r
            told = f"{message}\n{snippet or ''}"
            return bool(
                rule and path is not None and rule.lower() == e["rule"].lower() and re.search(dialect(e["path"]), path) and (not e["pattern"] or re.search(e["pattern"], told, re.IGNORECASE)) and (not e["fingerprint"] or e["fingerprint"] == mark.lower())
            )

        want = sorted(map(str, (r for r in rows if not any(covers(e, r) for e in entries))))
        got = sorted(str(tuple(r)) for r in patterns.without(findings, entries, dialect).collect())
        assert got == want and 0 < len(want) < len(rows)
    many = [{"path": g, "rule": "r.a"} for g in some_globs(rng, 5000)]
    bundle = config.Bundle(rules={}, allow=many)
    scan.apply_policy(findings, config.Bundle(allow=many[:1]))._jdf.queryExecution().executedPlan()
    began = time.perf_counter()
    kept = scan.apply_policy(findings, bundle)
    kept._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 2
    tests = [re.compile(globs.strict(e["path"])) for e in many]
    assert kept.count() == sum(not (r[0] and r[0].lower() == "r.a" and r[1] is not None and any(t.search(r[1]) for t in tests)) for r in rows)


def test_first_service_by_place(spark):
    rng = random.Random(9)
    maps = [(f"s{i}", g) for i, g in enumerate(some_globs(rng, 500))]
    names = sorted(set(paths(rng, 200)))
    got = {r.path: r.module_service for r in service_keys(spark.createDataFrame([(n,) for n in names], "path string"), maps).collect()}
    assert got == {n: next((s for s, g in maps if re.search(globs.loose(g), n)), ".") for n in names}


def test_many_rules_of_ones_own_make_one_plan(spark):
    files = spark.createDataFrame([("a.cs", "Source", "csharp", "id7 x\nid42"), ("b.json", "Config", "json", "id7"), ("c.md", "Docs", None, "id7"), ("n", "Source", None, None)], "path string, category string, language string, text string")
    rules = [{"id": f"t.{i}", "pattern": rf"\bid{i}\b", "message": f"m{i}", "categories": ["Source", "Source"] if i == 42 else ["Source", "Config"]} for i in range(3000)]
    began = time.perf_counter()
    found = portability.custom_findings(files, rules)
    found._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 4
    assert sorted((r.path, r.rule_id, r.line, r.column, r.message) for r in found.collect()) == [("a.cs", "t.42", 2, 1, "m42"), ("a.cs", "t.7", 1, 1, "m7"), ("b.json", "t.7", 1, 1, "m7")]


def test_folders():
    assert [patterns.folder_of(g) for g in ("src/A/*.cs", "src/a?b/c", "x.cs", "**", "A\\B\\c.cs")] == ["src/a", "src", "", "", "a/b"]
