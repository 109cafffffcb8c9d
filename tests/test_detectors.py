import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.functions import globs, metadata
from lodestone.functions import scalars as fn
from lodestone.operators import artifacts, dependencies, drift, hygiene, magic, portability, scan
from lodestone.sources import config, files, manifests, structured

FILE = "path string, category string, language string, text string"


def sources(spark, *rows):
    return spark.createDataFrame([(p, c, lang, t) for p, c, lang, t in rows], FILE)


def rules(df):
    return sorted((r.path, r.rule_id, r.line) for r in df.collect())


@pytest.mark.parametrize(
    ("make", "glob", "yes", "no"),
    [
        (globs.strict, "src/*.cs", ["src/a.cs", "SRC/B.CS"], ["src/x/a.cs", "a.cs"]),
        (globs.strict, "src/**", ["src/x/a.cs"], ["lib/src/a"]),
        (globs.strict, "a?.(b)", ["ax.(b)"], ["a/.(b)"]),
        (globs.loose, "*.g.cs", ["src/x/a.g.cs"], ["a.cs"]),
        (globs.loose, "a^b$c", ["A^B$C"], ["ab"]),
        (lambda g: globs.ignored([g, "# note", "!kept", ""]), "out/", ["out/x", "a/Out/b"], ["output/x", "kept"]),
        (lambda g: globs.ignored([g]), "*.tmp", ["a/b.tmp"], ["a.tmp.x"]),
        (lambda g: globs.ignored([g]), "notes.txt", ["notes.txt", "a/notes.txt", "notes.txt/x"], ["a/notes.txt.old"]),
    ],
)
def test_globs(make, glob, yes, no):
    import re

    pattern = make(glob)
    assert all(re.search(pattern, p) for p in yes) and not any(re.search(pattern, p) for p in no)
    with pytest.raises(ValueError):
        globs.strict("[ab]")


def test_versions_and_previews(spark):
    cases = [("1.0", "1.2.3", 0.0203), (">=4.0", "6.0.0", 2.0), ("~1.2", "2.0.0", 0.98), ("1.x", "9.0", 0.0), ("x", "2", 0.0), (None, "2", 0.0), ("2.0", "1.0", 0.0), ("^1.2.3.9", "1.2.4", 0.0001)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string").select(F.round(fn.staleness(F.col("a"), F.col("b")), 6).alias("s"))
    assert [r.s for r in df.collect()] == [w for *_, w in cases]
    keys = spark.createDataFrame([("PrivateKey", "x"), ("connstr", "x"), ("name", "y" * 40), ("name", "z")], "k string, v string")
    assert [r[0] for r in keys.select(fn.redacted(F.col("k"), F.col("v"))).collect()] == ["[REDACTED]", "[REDACTED]", "y" * 32 + "...", "z"]


def test_entropy_against_counts(spark):
    import math
    from collections import Counter

    texts = ["", "a", "abab", "hello world", "é𝄞é", None, "x" * 500 + "y"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fn.entropy(F.col("t"))).collect()]
    want = [-sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0 for t in texts]
    assert got == pytest.approx(want, abs=1e-9)


def test_text_rules_of_portability(spark):
    body = "a 10.0.0.1 127.0.0.1\nx.blob.core.windows.net\n\"C:\\Temp\\x\"\n /var/log/x\ntenant 12345678-1234-4abc-8abc-1234567890ab\nwesteurope\nlogin.microsoftonline.com"
    f = sources(spark, ("a.go", "Source", "go", body), ("b.json", "Config", "json", "/etc/x 10.0.0.2"), ("c.md", "Docs", None, "10.0.0.3"), ("d", "Source", None, None), ("e", "Source", None, ""))
    h = "portability.hardcoded."
    want = [("a.go", h + r, n) for r, n in (("ipv4", 1), ("dns", 2), ("filepath.windows", 3), ("filepath.linux", 4), ("guid", 5), ("region", 6), ("endpoint", 7), ("dns", 7))]
    assert rules(portability.text_findings(f)) == sorted([*want, ("b.json", h + "ipv4", 1)])
    at = {r.rule_id: (r.column, r.severity, r.confidence, r.snippet) for r in portability.text_findings(f).where("line = 1 and path = 'a.go'").collect()}
    assert at == {h + "ipv4": (3, "Warning", "Medium", "a 10.0.0.1 127.0.0.1")}
    assert portability.text_findings(f.limit(0)).count() == 0


def test_fingerprints_are_hashes_of_the_parts(spark):
    import hashlib

    f = portability.text_findings(sources(spark, ("a.go", "Source", "go", "x 10.0.0.9"))).first()
    assert f.fingerprint == hashlib.sha256(b"portability.hardcoded.ipv4|a.go|1|3|10.0.0.9").hexdigest().upper()


def test_csharp_calls_clients_ports_and_suppressions(spark):
    lines = [
        'var a = new Uri("http://10.1.1.1");', 'var b = Environment.GetEnvironmentVariable("localhost");', 'var c = "localhost";', "", "", "", "", "",
        'new TcpClient().Connect("h", 5001);', "var k = new SecretClient(uri);", 'var s = "5002"; Bind(443, 22, 6000);', "// lodestone: ignore portability.hardcoded.ipv4", 'F("10.2.2.2");',
        "var p = @\"C:\\a\\b\";", 'var q = "C:\\\\c\\\\d";', '[Link("10.3.3.3")]',
    ]
    f = sources(spark, ("src/a.cs", "Source", "csharp", "\n".join(lines)), ("tests/t.cs", "Source", "csharp", 'x = "localhost";\r\n'))
    got = {(r.path, r.line, r.rule_id.split("portability.")[1]): (r.severity, r.confidence) for r in portability.csharp_findings(f).collect()}
    assert got == {
        ("src/a.cs", 1, "hardcoded.ipv4"): ("Info", "High"), ("src/a.cs", 3, "hardcoded.localhost"): ("Info", "High"), ("src/a.cs", 9, "hardcoded.port"): ("Warning", "High"), ("src/a.cs", 10, "cloud.sdk.no_abstraction"): ("Warning", "High"),
        ("src/a.cs", 11, "hardcoded.port"): ("Warning", "High"), ("src/a.cs", 14, "hardcoded.filepath.windows"): ("Warning", "Medium"), ("src/a.cs", 15, "hardcoded.filepath.windows"): ("Warning", "Medium"),
        ("src/a.cs", 16, "hardcoded.ipv4"): ("Warning", "High"), ("tests/t.cs", 1, "hardcoded.localhost"): ("Info", "High"),
    }


def test_lines_of_other_languages(spark):
    f = sources(
        spark,
        ("a.py", "Source", "python", 'requests.get("http://10.0.0.4", 8080)\nx = "/etc/x"\ny = 9090'), ("a.ps1", "Source", "powershell", "Invoke-WebRequest http://10.0.0.5/\nWrite-Host '10.0.0.6'\nnew-object Net.X '10.0.0.7'\nNew-Object System.Uri 'localhost'"),
        ("a.rs", "Source", "rust", 'let k = "HKEY_USERS\\x";'), ("a.cpp", "Source", "cpp", "connect(s, 443); connect(s, 7000);"), ("a.json", "Config", "python", "'10.0.0.8'"),
    )
    h = "portability.hardcoded."
    assert rules(portability.line_findings(f)) == [("a.cpp", h + "port", 1), ("a.py", h + "filepath.linux", 2), ("a.py", h + "ipv4", 1), ("a.py", h + "port", 1), ("a.py", h + "port", 1), ("a.rs", h + "registrykey", 1)]
    assert rules(portability.powershell_findings(f)) == [("a.ps1", h + "ipv4", 1), ("a.ps1", h + "localhost", 4)]
    spared = portability.analyse(f, [{"path": "*.py", "rule": h + "IPV4"}, {"path": "a.rs", "rule": h + "registrykey", "fingerprint": "other"}, {"path": "x"}])
    assert ("a.py", h + "ipv4", 1) not in rules(spared) and ("a.rs", h + "registrykey", 1) in rules(spared) and ("a.json", h + "ipv4", 1) in rules(spared)


def test_custom_rules_span_lines(spark):
    f = sources(spark, ("a.cs", "Source", "csharp", "x\nfoo\nbar foo\nbar"), ("b.md", "Docs", None, "foo\nbar"))
    rule = {"id": "t.x", "pattern": r"foo\nbar", "message": "m", "categories": ["Source"]}
    got = portability.custom_findings(f, [rule]).orderBy("line").collect()
    assert [(r.path, r.line, r.column, r.snippet) for r in got] == [("a.cs", 2, 1, "foo"), ("a.cs", 3, 5, "bar foo")]
    assert portability.custom_findings(f, []).count() == 0


def test_scopes_of_asynchronous_code(spark):
    cs = "async Task A()\n{\n  x.Wait();\n  if (y) { z.Result; }\n}\nint B() { q.Wait(); }\nasync void C(int n) { }\nasync void D(object sender, EventArgs e) { r.GetAwaiter().GetResult(); }\nlock (typeof(X)) { }\nlock (gate) { }\n}}}\nasync Task E() {\n w.Result;"
    py = "async def a():\n    b()\n    asyncio.run(c())\n\n# note\n    asyncio.run(d())\ndef e():\n    asyncio.run(f())\nasync def g(): asyncio.run(h())"
    rs = "async fn a()\n{\n  rt.block_on(x);\n}\nfn b() { block_on(y); }"
    f = sources(spark, ("a.cs", "Source", "csharp", cs), ("a.py", "Source", "python", py), ("a.rs", "Source", "rust", rs), ("n.cs", "Source", "csharp", None))
    got = rules(hygiene.async_findings(f))
    assert [(r.split(".")[1], n) for p, r, n in got if p == "a.cs"] == sorted([("async_void", 7), ("sync_over_async", 3), ("sync_over_async", 4), ("sync_over_async", 8), ("sync_over_async", 13), ("bad_lock_target", 9)], key=lambda x: ("thread" if x[0].startswith("bad") else "async", x))
    assert [(p, n) for p, r, n in got if r == "async.nested_runtime"] == [("a.py", 3), ("a.py", 6), ("a.rs", 3)]


def test_flags_debt_and_blame(spark):
    sha = "a" * 40
    text = f"{sha} 1 1 2\nauthor Ann\nauthor-time 1700000000\n\tx\n{sha} 2 2\nauthor Ann\nauthor-time 1700000000\n\ty\n{'b' * 40} 9 3 1\nauthor \nauthor-time x\n\tz\n"
    blame = hygiene.parse_blame(spark.createDataFrame([("A.cs", text)], "path string, text string"))
    rows = sorted((r.line, r.author, r.author_time.timestamp() if r.author_time else None) for r in blame.collect())
    assert [(n, a) for n, a, _ in rows] == [(1, "Ann"), (2, "Ann"), (3, "unknown")] and rows[2][2] is None
    now = F.timestamp_seconds(F.lit(1700000000 + 200 * 86400))
    f = sources(spark, ("a.cs", "Source", "csharp", 'if (f.IsEnabled("Old")) {} // TODO x\n"old": true // XXX\nconst string N = "Dead__One"; // fixme y'), ("b.py", "Source", "python", "x = 1  # hack\n* TODO"))
    found = hygiene.analyse(f, now, blame)
    assert rules(found) == sorted([("a.cs", "hygiene.stale_feature_flag", 1), ("a.cs", "hygiene.todo_old", 1), ("a.cs", "hygiene.todo_old", 2), ("a.cs", "hygiene.fixme", 3), ("a.cs", "hygiene.dead_feature_flag", 3), ("b.py", "hygiene.hack", 1)])
    assert rules(hygiene.analyse(f, now)) == sorted([("a.cs", "hygiene.fixme", 3), ("a.cs", "hygiene.dead_feature_flag", 3), ("b.py", "hygiene.hack", 1)])


def test_scalars_of_json_and_yaml():
    assert structured.scalars_of("a.json", '{"a": [1.50, {"b": true}], "c": null, "d": "x"}') == [("$.a[0]", "a", "1.50", 1, 1, None), ("$.a[1].b", "b", "True", 1, 1, None), ("$.d", "d", "x", 1, 1, None)]
    assert structured.scalars_of("a.yml", "a:\n- x\n- b: yes\n---\nc: 1\n") == [("$.a[0]", None, "x", 2, 3, None), ("$.a[1].b", "b", "yes", 3, 6, None), ("$.c", "c", "1", 5, 4, None)]
    assert structured.scalars_of("a.json", "{\n x")[0][:5] == ("$", None, None, 2, 2) and structured.scalars_of("a.yaml", "a: [")[0][-1]
    assert structured.scalars_of("a.json", None)[0][-1] and structured.scalars_of("a.yml", None) == []
    assert structured.flat_of("a.json", '{"A": {"b": 1}, "a": {"B": null}, "c": [false]}') == [("A.b", "", None), ("c[0]", "False", None)]
    deep = "[" * 5000 + "]" * 5000
    assert structured.scalars_of("a.json", deep) in ([], [("$", None, None, 1, 1, "nested too deeply")])


def test_artifacts_of_both_kinds_and_broken_ones(spark):
    ev2 = '{"rolloutSpec": {"tenantId": "12345678-1234-4abc-8abc-1234567890ab", "region": "EastUS", "password": "[parameters(p)]", "env": "prod", "wait": 1}}'
    ado = "stages:\n- stage: Production\n  pool:\n    name: agents\n  script: echo\n  container: r/x:latest\n  approvals: none\n"
    f = spark.createDataFrame(
        [("a/ev2/r.json", ev2), ("x.yml", ado), ("b.json", "{rolloutSpec"), ("c.json", '{"x": 1}'), ("d/pipelines/e.txt", "pool: $(p)\npool: fixed"), ("e/ev2/f.json", ""), ("n.json", None)], "path string, text string"
    )
    got = sorted((r.path, r.rule_id) for r in artifacts.analyse(f).collect())
    e, a = "deploy.ev2.", "deploy.ado."
    assert got == sorted(
        [("a/ev2/r.json", e + x) for x in ("hardcoded.tenant", "hardcoded.region", "env_constant", "zero_bake_time", "no_health_check", "single_region")]
        + [("x.yml", a + x) for x in ("hardcoded.agentpool", "container_latest")] + [("b.json", "deploy.artifact.parse_error"), ("d/pipelines/e.txt", a + "hardcoded.agentpool"), ("e/ev2/f.json", "deploy.artifact.parse_error")]
    )
    assert artifacts.analyse(f.limit(0)).count() == 0


def test_drift_of_three_environments(spark):
    texts = {"dev": '{"Url": "a", "only": 1, "p": "${P}", "Secret": "s1"}', "prod": '{"url": "b", "p": "${Q}", "Secret": "s2", "late": true}', "qa": "url: a\np: x\nlate: true\n"}
    rows = [(f"c/app.{e}.{'yaml' if e == 'qa' else 'json'}", t) for e, t in texts.items()] + [("c/app.json", "{}"), ("c/lone.test.json", '{"a": 1}'), ("c/app.test.json", "{broken")]
    s = drift.settings(spark.createDataFrame(rows, "path string, text string"))
    f = drift.findings(s)
    m = lambda c, n: F.get_json_object(c, f"$.{n}")
    got = sorted((r[0], r[1]) for r in f.select(m("metadata", "key"), "rule_id").collect())
    assert got == [("Secret", "config.drift.hardcoded_env_value"), ("Url", "config.drift.hardcoded_env_value"), ("late", "config.drift.orphan_key"), ("only", "config.drift.orphan_key")]
    cells = {(r.key, r.env): (r.state, r.preview) for r in drift.matrix(f, search="s").collect()}
    assert cells == {("Secret", "dev"): ("differs", "[REDACTED]"), ("Secret", "prod"): ("differs", "[REDACTED]")}
    assert {r.state for r in drift.matrix(f, config_set="C/APP/json", issues_only=True).where("key = 'only'").collect()} == {"present", "missing"}


def test_manifests_and_their_findings(spark):
    rows = [
        ("a/App.csproj", '<Project><ItemGroup>\n<PackageReference Include="Cen" />\n<PackageReference Update="Two"\n Version="1.*" /></ItemGroup></Project>'), ("Directory.Packages.props", '<Project><ItemGroup><PackageVersion Include="cen" Version="2.0.0"/></ItemGroup></Project>'),
        ("bad.csproj", "<Project"), ("pyproject.toml", 'dependencies = ["one==1.0"]\nrequires-python = "python 3.6"'), ("package.json", "{"), ("x/requirements.txt", "a[b]==1 # c\n\n"), ("n.csproj", None),
    ]
    d = manifests.with_central_versions(manifests.dependencies(spark.createDataFrame(rows, "path string, text string")))
    got = sorted((r.path, r.line, r.ecosystem, r.name, r.version, r.exact, r.pinned) for r in d.collect())
    assert got == sorted([
        ("a/App.csproj", 2, "NuGet", "Cen", "2.0.0", "2.0.0", True), ("a/App.csproj", 3, "NuGet", "Two", "1.*", None, False), ("Directory.Packages.props", 1, "NuGet", "cen", "2.0.0", "2.0.0", True),
        ("pyproject.toml", 1, "PyPI", "one", "==1.0", "1.0", True), ("x/requirements.txt", 1, "PyPI", "a", "==1", "1", True),
    ], key=lambda r: r[:4])
    a = spark.createDataFrame([("NuGet", "CEN", "2.0.0", "V1", "9.1", "s")], "ecosystem string, name string, version string, advisory_id string, score string, summary string")
    n = spark.createDataFrame([("NuGet", "cen", "3.0.0")], "ecosystem string, name string, latest string")
    f = dependencies.analyse(spark.createDataFrame(rows, "path string, text string"), a, n)
    assert rules(f) == sorted([("Directory.Packages.props", "deps.vulnerable.critical", 1), ("a/App.csproj", "deps.unpinned_version", 3), ("a/App.csproj", "deps.vulnerable.critical", 2), ("pyproject.toml", "deps.eol.framework", 2)])
    h = dependencies.health(f.withColumn("finding_id", F.col("fingerprint")))
    assert {(r.name.lower(), r.version, r.latest, r.pinned, r.advisories, r.severity_rank, r.staleness) for r in h.collect()} == {("cen", "2.0.0", "3.0.0", True, 1, 4, 1.0), ("two", "1.*", None, False, 0, 0, 0.0)}
    assert [r.name for r in dependencies.health_page(h, pinned="no").collect()] == ["Two"] and dependencies.health_page(h, search="CEN", advisories_only=True, sort="name", descending=True).count() == 1
    assert dependencies.health_page(h, end_of_life_only=True).count() == 0 and [r.framework for r in dependencies.frameworks(f.withColumn("finding_id", F.col("fingerprint"))).collect()] == ["Python 3.6"]


def test_magic_strings(spark):
    lines = 'if (x == "active") {}\nlog("active");\nConsole.Write("ignored thing");\nvar a = "active"; var g = "12345678-1234-4abc-8abc-1234567890ab"; var v = "1.2.3";\nvar n = "ab"; var i = "10.0.0.1";'
    f = sources(spark, ("src/a.cs", "Source", "csharp", lines), ("tests/b.py", "Source", "python", "x = 'active'\ny = 'keep*me'\nz = 'keep*me'"))
    found = magic.occurrences(f)
    c = {r.literal: (r.n, r.files, r.compared, r.condition, r.test, r.rule_id, r.path, r.line) for r in magic.candidates(found).collect()}
    assert c == {"active": (3, 2, 1, 1, 1, "magic-string.comparison-used", "src/a.cs", 1), "keep*me": (2, 1, 0, 0, 2, "magic-string.candidate", "tests/b.py", 2)}
    assert [r.literal for r in magic.limited(magic.candidates(found), per_directory=1, total=1).collect()] == ["active"]
    assert "keep*me" not in {r.literal for r in magic.occurrences(f, allow=["KEEP*"]).collect()} and "1.2.3" in {r.literal for r in magic.occurrences(f, deny=["1.2.*"]).collect()}
    assert "ignored thing" in {r.literal for r in magic.occurrences(f, sinks={"csharp": ["Other"]}).collect()} and "ignored thing" not in {r.literal for r in magic.occurrences(f, sinks={"csharp": []}).collect()}
    told = magic.findings(magic.candidates(found), found).where("rule_id like '%used'").first()
    assert told.confidence == "High" and '"topLocations":[{"path":"src/a.cs"' in told.metadata
    score = spark.range(1).select(magic.score(F.lit(3), F.lit(1), F.lit(1), F.lit(1), F.lit(0))).first()[0]
    assert score == pytest.approx(2 * 2.3, abs=1e-4)


def test_files_and_renames(spark):
    cases = {
        "src/a.cs": ("Source", "csharp"), "obj/a.cs": ("Generated", "csharp"), "x/vendor/a.py": ("Vendor", "python"), "azure-pipelines.yml": ("Config", "yaml"), "azure-pipelines/a.yml": ("DeploymentArtifact", "yaml"), "k8s/a.cs": ("DeploymentArtifact", "csharp"),
        "a.kts": ("Source", None), "a.properties": ("Config", None), "a.adoc": ("Docs", None), "a": ("Unknown", None), "A.TSX": ("Source", "typescript"), "a\\helm\\b.yaml": ("DeploymentArtifact", "yaml"),
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string").select("path", files.classify(F.col("path")).alias("c"), files.language(F.col("path")).alias("l"))
    assert {r.path: (r.c, r.l) for r in df.collect()} == cases
    log = "commit " + "a" * 40 + "\tA@x\t1700000000\n\n3\t1\tsrc/{old => new}/f.cs\n-\t-\tb.png\n2\t0\tx.py => y.py\n1\t1\t{ => sub}/z.cs"
    lines = spark.createDataFrame([(1, i, s) for i, s in enumerate(log.split("\n"))], "file_id int, line int, content string")
    assert sorted((r.path, r.old_path, r.added, r.removed) for r in files.commit_log(lines).collect()) == [("b.png", None, 0, 0), ("src/new/f.cs", "src/old/f.cs", 3, 1), ("sub/z.cs", "/z.cs", 1, 1), ("y.py", "x.py", 2, 0)]


def test_configuration(tmp_path):
    made = config.scaffold(str(tmp_path))
    assert len(made) == 3 and config.scaffold(str(tmp_path)) == [] and config.validate(str(tmp_path)) == ([], [])
    (tmp_path / "rules" / "rules.yaml").write_text("rules:\n  hygiene.fixme: Error\n  hygiene.hack: false\n  no.such: Info\nextra: 1\nallowlist:\n- rule: hygiene.fixme\n  path: 'src/**'\n- path: '[x]'\n")
    (tmp_path / "rules" / "z.yaml").write_text("rules: {hygiene.fixme: Info}\n")
    (tmp_path / "rules" / "broken.yaml").write_text("a: [")
    (tmp_path / "rules" / "custom" / "c.yaml").write_text("customRules:\n- {id: t.a, pattern: 'x+', message: m}\n- {id: T.A, pattern: y, message: m}\n- {id: t.b, pattern: '(', message: m}\n- {id: t.c, message: m}\n")
    b = config.load(str(tmp_path), {"churn.stale.file_risk": "Error", "hygiene.todo_old": False})
    assert b.rules["hygiene.fixme"] == ("hygiene.fixme", True, "Info") and not b.rules["hygiene.hack"][1] and b.rules["churn.stale.file_risk"][2] == "Error" and not b.rules["hygiene.todo_old"][1]
    assert [c["id"] for c in b.custom] == ["t.a"] and b.allow == [{"path": "src/**", "rule": "hygiene.fixme", "pattern": None}]
    assert len(b.errors) == 6 and len(b.warnings) == 2 and b.digest() != config.load(str(tmp_path)).digest() and ("t.a", "Warning", True, "rules/custom/c.yaml") in config.rule_list(b)
    assert config.suppressions("# c\n- path: 'src/*'\n  rule_id: a.b\n- rule: c\n- path: x\n  rule: y\n  fingerprint: \"F\"\n") == [{"path": "src/*", "rule": "a.b"}, {"path": "x", "rule": "y", "fingerprint": "F"}]
    assert config.services("a=src/*\n# x\nb: lib/** # y\nbad") == [("a", "src/*"), ("b", "lib/**")] and (config.days("90D", 7), config.days("x", 7), config.days(None, 7)) == (90, 7, 7)
    assert config.literal_settings("minOccurrences: 3\nallowlist: [a]\nloggingSinks: {CSharp: [L]}\nbad: {x: 1}\n") == {"numbers": {"minOccurrences": 3}, "allow": ["a"], "deny": [], "sinks": {"csharp": ["L"]}}
    git = tmp_path / ".git" / "refs"
    git.mkdir(parents=True)
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/main\n")
    assert config.head_sha(str(tmp_path)) is None
    (git / "main").write_text("abc\n")
    assert config.head_sha(str(tmp_path)) == "abc" and config.find_root(str(tmp_path / "rules")) == str(tmp_path) and config.head_sha("/nonexistent") is None


def test_scan_of_a_repository(spark, tmp_path):
    from lodestone.sources import store

    root = tmp_path / "repo"
    for name, text in {
        "src/a.cs": 'var s = "server=x";\nvar t = "10.0.0.1"; // FIXME\n', "tests/b.cs": 'var t = "localhost";', "obj/c.cs": 'x = "10.0.0.2"', "skip/d.py": "requests.get('10.0.0.3')", "cfg/app.dev.json": '{"a": 1}', "cfg/app.prod.json": '{"a": 1, "b": 2}',
        ".gitignore": "skip/\n", "requirements.txt": "a>=1\n", "big.cs": "x" * (3 << 20), "rules/rules.yaml": "rules: {config.drift.orphan_key: Error}\n", "bad.cs": None,
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b'var z = "10.0.0.9"; \xff' if text is None else text.encode())
    (root / ".git").mkdir()
    at, out = dt.datetime(2024, 1, 1), f"{tmp_path}/store"
    assert scan.scan_repository(spark, str(root), out, "r1", at) == 1
    s = store.read(spark, out)
    got = sorted((r.file_path, r.rule_id, r.severity) for r in s.findings.collect())
    assert got == sorted([
        ("bad.cs", "portability.hardcoded.ipv4", "Warning"), ("cfg/app.prod.json", "config.drift.orphan_key", "Error"), ("requirements.txt", "deps.unpinned_version", "Warning"), ("src/a.cs", "hygiene.fixme", "Warning"),
        ("src/a.cs", "portability.hardcoded.connectionstring", "Error"), ("src/a.cs", "portability.hardcoded.ipv4", "Warning"), ("tests/b.cs", "portability.hardcoded.localhost", "Warning"),
    ])
    assert {r.path for r in s.files.collect()} == {"src/a.cs", "tests/b.cs", "cfg/app.dev.json", "cfg/app.prod.json", "requirements.txt", "rules/rules.yaml", "bad.cs"} and s.runs.first().repo_root == str(root) and s.rules.count() == 53
    (root / "rules" / "rules.yaml").write_text("rules: {nothing: Error}\n")
    assert scan.scan_repository(spark, str(root), out, "r2", at) == 2


def test_metadata_of_any_shape(spark):
    rows = [
        ("a", '{"Keyword":"HACK","AGEDAYS":" 7 ","x":1}'), ("b", '{"keyword":5,"ageDays":7.5}'), ("c", '{"ageDays":"7.5","keyword":null}'), ("d", "{"), ("e", None), ("f", "[1]"),
        ("g", '{"KEYWORD":"low","keyword":"own","ageDays":99999999999999999999}'), ("h", '{"a":1,"a":2,"keyword":"k"}'), ("i", '{"ageDays":true,"keyword":{"a":[1]}}'), ("j", '{"ageDays":-3,"author":"x"}'),
    ]
    f = spark.createDataFrame([(p, 1, "hygiene.HACK", m) for p, m in rows] + [("z", 1, "other", "{}")], "path string, line int, rule_id string, metadata string")
    got = {r.path: (r.keyword, r.author, r.age_days) for r in hygiene.debt_rows(f).collect()}
    none = ("TODO", "unknown", None)
    assert got == {
        "a": ("HACK", "unknown", 7), "b": ("5", "unknown", None), "c": none, "d": none, "e": none, "f": none, "g": ("own", "unknown", None), "h": none, "i": ('{"a":[1]}', "unknown", None), "j": ("TODO", "x", -3),
    }
    shapes = [("true", True, None), ('" FALSE "', False, None), ('"yes"', None, None), ("1", None, 1), ("2.5", None, 2), ('"3.5"', None, 4), ('"-1e2"', None, -100), ('"1e30"', None, None), ("null", None, None), ("[]", None, None)]
    m = spark.createDataFrame([(i, '{"V":' + s + "}") for i, (s, _, _) in enumerate(shapes)], "i int, metadata string").withColumn("m", metadata.fields("metadata"))
    assert [(r.a, r.b) for r in m.select("i", metadata.flag("m", "v").alias("a"), metadata.rounded("m", "v").alias("b")).orderBy("i").collect()] == [(a, b) for _, a, b in shapes]
    assert hygiene.debt_rows(f.limit(0)).count() == 0


def test_flags_from_metadata_parse_each_row_once(spark):
    rows = [
        ("hygiene.stale_feature_flag", '{"flagname":"One","ReferenceCount":"4","definitionCount":2.0,"introducedDaysAgo":"200.5","lastChangedDaysAgo":91.4,"locations":[{"FilePath":"x","Line":"9"},3,{"filepath":" "},{"filePath":"y"}]}'),
        ("hygiene.dead_feature_flag", '{"flagName":"Two","locations":{}}'), ("hygiene.fixme", "{}"), ("hygiene.dead_feature_flag", None),
    ]
    f = spark.createDataFrame([("p", i, r, m) for i, (r, m) in enumerate(rows)], "path string, line int, rule_id string, metadata string")
    out = hygiene.flag_rows(f)
    got = [(r.flag, r.status, r.refs, r.defs, r.introduced_days, r.changed_days, [tuple(x) for x in r.places]) for r in out.orderBy("line").collect()]
    assert got == [("One", "stale", 4, 2, 200, 91, [("x", 9), ("y", 0)]), ("Two", "dead", 0, 0, None, None, [("p", 1)]), (None, "dead", 0, 0, None, None, [("p", 3)])]
    for df in (out, hygiene.debt_rows(f), hygiene.projected(f)):
        assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1


def test_scan_of_all_rules_leaves_no_scan_and_no_rule_out(spark, monkeypatch):
    from conftest import SF

    from lodestone.plans import detectors

    rows = [
        ("a/f1.cs", "Source", "csharp", 'if (f.IsEnabled("Old")) { }\nx(); // TODO tidy it'),
        ("a/f2.cs", "Source", "csharp", 'const string Flag = "Dead";'),
        ("a/f3.py", "Source", "python", "async def work():\n    asyncio.run(main())"),
        ("a/f4.json", "Config", "json", '{ "zone": "uksouth" }'),
        ("a/f5.py", "Source", "python", "\n".join(f'x = "alpha{i}"' for i in range(60)) * 2),
        ("a/pipelines/t.txt", "DeploymentArtifact", None, "pool = agents"),
        ("cfg/a.dev.json", "Config", "json", '{"k": "1"}'),
        ("cfg/a.prod.json", "Config", "json", '{"k": "2"}'),
        ("m/requirements.txt", "Docs", None, "zeta>=1.0"),
    ]
    files = spark.createDataFrame(rows, "path string, category string, language string, text string")
    blame = spark.sql("select 'a/f1.cs' as path, l as line, 'A' as author, timestamp '2023-01-01 00:00:00' as author_time from values (1), (2) as t(l)")
    commits = spark.sql("select 'a/f1.cs' as path, cast(null as string) as old_path, 'A' as author, timestamp '2023-10-01 00:00:00' as ts, 1L as added, 0L as removed")
    for name, df in (("_repository", files), ("_blame", blame), ("_commits", commits)):
        monkeypatch.setattr(detectors, name, lambda *_, df=df: df, raising=False)
    monkeypatch.setattr(detectors.cv, "code_files", lambda *_: files)
    got = {r.rule_id: r.n for r in detectors.scan_all_rules(spark, SF).collect()}
    flags = ("hygiene.stale_feature_flag", "hygiene.dead_feature_flag", "hygiene.todo_old", "async.nested_runtime")
    other = ("churn.ownership.orphaned_knowledge_risk", "config.drift.hardcoded_env_value", "deploy.ado.hardcoded.agentpool", "deps.unpinned_version", "portability.hardcoded.region", "team.todo", "team.zone")
    assert got == dict.fromkeys((*flags, *other), 1) | {"magic-string.candidate": 60}


def test_flags_are_found_on_lines_of_each_kind(spark):
    from lodestone.operators import hygiene as hy

    text = "if (IsEnabled('A1')) {\nx = feature_flag[\"A2\"]\n#if FEATURE_A3\n  #define FEATURE_A4 1\nprivate CONST String N = 'A5';\nstatic readonly string M = \"A6\";\n\"A7\" : TRUE,\n'A8':false\nplain '#' \"x\" = string"
    files = spark.createDataFrame([("f", text)], "path string, text string")
    got = sorted((r.flag, r.line, r.is_definition) for r in hy.flag_occurrences(files).collect())
    assert got == [(f"A{i}", i, i > 3) for i in range(1, 9)]
