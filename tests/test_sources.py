from lodestone.functions import scalars as fn
from lodestone.operators import lines as lo
from lodestone.operators import text as to
from lodestone.sources import export, files, manifests
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_discovery_leaves_out_generated_hidden_and_large_files(spark, tmp_path):
    for name in ("src/a.py", "bin/b.py", ".git/c", "node_modules/d.js", "conf/e.json", "big.md", "bad.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * (3000 if name == "big.md" else 3) if name != "bad.txt" else b"a\xff")
    got = files.discover(spark, str(tmp_path), 1000)
    assert rows(got, "path", "category") == [("bad.txt", "Docs"), ("conf/e.json", "Config"), ("src/a.py", "Source")]
    assert {r.path: r.text for r in got.collect()}["bad.txt"] == "a\ufffd"  # as any reader that replaces what it cannot decode


def test_manifests_of_four_ecosystems(spark):
    texts = [
        ("requirements.txt", "# c\nalpha==1.2\nbeta >= 2 ; python\n-r other\n"),
        ("x/app.csproj", '<Project>\n<PackageReference Include="Gamma" Version="3.0.1" />\n</Project>'),
        ("Cargo.toml", '[package]\nname = "me"\n[dependencies]\ndelta = "0.4"\neps = { version = "=1.0", features = [] }\n'),
        ("package.json", '{"dependencies": {"zeta": "^1.0.0"}, "devDependencies": {"eta": "2.0.0"}}'),
        ("package.json", "{}"), ("empty/Cargo.toml", None),
    ]
    got = manifests.dependencies(spark.createDataFrame(texts, "path string, text string"))
    assert rows(got, "ecosystem", "name", "version", "line") == [
        ("Cargo", "delta", "0.4", 4), ("Cargo", "eps", "=1.0", 5), ("NuGet", "Gamma", "3.0.1", 2), ("PyPI", "alpha", "==1.2", 2), ("PyPI", "beta", ">=2", 3),
        ("npm", "eta", "2.0.0", 1), ("npm", "zeta", "^1.0.0", 1),
    ]


def test_commit_log(spark):
    log = "commit abcdef1234567890\ta@x\t86400\n\n3\t1\tsrc/a.py\n-\t-\timg.png\ncommit 1234567\tb@x\t0\n1\t0\tz"
    got = files.commit_log(to.lines(spark.createDataFrame([(1, log)], "file_id int, text string")))
    assert rows(got, "author", "path", "added", "removed") == [("a@x", "img.png", 0, 0), ("a@x", "src/a.py", 3, 1), ("b@x", "z", 1, 0)]


def test_lines_in_order(spark):
    lines = to.lines(spark.createDataFrame([(1, "}\n{ {\n}\n[a]\nx = 1\n# TODO y\n// fixme z")], "file_id int, text string")).withColumn("age_days", F.lit(10))
    assert [r.depth for r in lo.brace_depth(lines).orderBy("line").collect()] == [0, 2, 1, 1, 1, 1, 1]
    assert [r.section for r in lo.sections(lines).orderBy("line").collect()] == [None, None, None, "a", "a", "a", "a"]
    assert rows(lo.debt(lines), "line", "keyword") == [(7, "FIXME")]


def test_functions(spark):
    one = spark.range(1)
    got = one.select(
        fn.directory(F.lit("a\\b/c.py")).alias("d"), fn.extension(F.lit("x/Y.PY")).alias("e"), fn.literals(F.lit("f(\"a\\\"b\", 'c')")).alias("l"), fn.entropy(F.lit("abab")).alias("h"),
        fn.redacted(F.lit("dbPassword"), F.lit("x")).alias("r"), fn.advisory_rank(F.lit("High")).alias("k"), fn.port_like(F.lit(443)).alias("p"), fn.entropy(F.lit(None).cast("string")).alias("z"),
    ).first()
    assert tuple(got) == ("a/b", ".py", ['a\\"b', "c"], 1.0, "[REDACTED]", 3, False, 0.0)


def test_export_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("a", 'say "x", y'), ("b", None)], "rule_id string, message string")
    export.export(f, str(tmp_path / "o"))
    assert rows(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "o")).na.fill(""), "rule_id", "message") == [("a", 'say "x", y'), ("b", "")]
    assert export.html_rows(f).first().row == "<tr><td>a</td><td>say &quot;x&quot;, y</td></tr>"
