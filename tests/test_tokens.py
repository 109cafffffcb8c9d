"""Scanners of C# and PowerShell against values worked out by hand."""

from lodestone.operators import portability
from lodestone.sources import code_tokens as ct

FILE = "path string, category string, language string, text string"


def cs(text):
    return [(k, line, col, v, sym, attr, calls) for k, line, col, v, sym, attr, calls, *_ in ct.csharp(text, ("GetEnvironmentVariable(",), "lodestone")]


def test_calls_over_several_lines():
    text = 'client\n  .Connect(\n    "h",\n    Port(\n      5001));\nvar u = new Uri(\n\n  "http://x");\nplain = "y";'
    assert cs(text) == [
        ("string", 3, 5, "h", "client.Connect", None, ["client.Connect"]), ("number", 5, 7, "5001", "Port", None, ["Port", "client.Connect"]), ("new", 6, 13, "Uri", None, None, []), ("string", 8, 3, "http://x", "Uri", None, ["new Uri"]), ("string", 9, 9, "y", None, None, []),
    ]


def test_strings_of_every_kind():
    text = 'a(@"C:\\x ""q"" \n)"); b($"v {f("in}ner")} w"); c("""raw "z" )"""); d(\'"\', "e\\"f(", "g"); // "no"\n/* "no\n" */ h($@"{{lit}} {x}\\");'
    assert [(v, sym) for k, _, _, v, sym, *_ in cs(text)] == [('C:\\x "q" \n)', "a"), ('v {f("in}ner")} w', "b"), ('raw "z" )', "c"), ('e"f(', "d"), ("g", "d"), ("{{lit}} {x}\\", "h")]


def test_attributes_indexers_blocks_and_generics():
    text = '[Route("r1"), Other(Name = "r2")]\nclass A {\n  int x = Configuration["key"];\n  void M() { F(() => { G("in"); }, "out"); List<string> l = new Dictionary<string, List<int>>("d"); }\n  int[] v = { 8081 };\n}'
    got = {v: (sym, attr, calls) for _, _, _, v, sym, attr, calls in cs(text)}
    assert got["r1"] == ("Route", "Route", ["Route"]) and got["r2"] == ("Other", "Other", ["Other"]) and got["key"] == ("Configuration", None, ["Configuration"])
    assert got["in"] == ("G", None, ["G"]) and got["out"] == ("F", None, ["F"]) and got["d"] == ("Dictionary", None, ["new Dictionary"]) and got["8081"] == (None, None, [])


def test_unclosed_text_and_nothing():
    assert cs("") == [] and [v for _, _, _, v, *_ in cs('f("abc')] == ["abc"] and cs("/* x") == [] and [v for _, _, _, v, *_ in cs('))]} g("z")')] == ["z"]


def test_csharp_findings_by_syntax(spark):
    text = '\n'.join([
        'var a = Environment.GetEnvironmentVariable(', '   "http://10.0.0.1");', "", "", "", "", "", "",
        "listener.Bind(", "   address,", "   6001);", "// lodestone: ignore portability.hardcoded.ipv4", 'Send("10.0.0.2");', 'var t = "// lodestone: ignore portability.hardcoded.localhost";', 'Send("localhost");',
        "var c = new Azure.Storage", "   .BlobServiceClient(u);", 'Log($"at {Where("10.0.0.3")}");',
    ])
    f = spark.createDataFrame([("src/a.cs", "Source", "csharp", text)], FILE)
    got = {(r.rule_id.removeprefix("portability."), r.line): (r.severity, r.confidence) for r in portability.csharp_findings(f).collect()}
    assert got == {
        ("hardcoded.port", 11): ("Warning", "High"), ("hardcoded.localhost", 14): ("Warning", "High"), ("hardcoded.localhost", 15): ("Warning", "High"), ("cloud.sdk.no_abstraction", 16): ("Warning", "High"), ("hardcoded.ipv4", 18): ("Warning", "Medium"),
    }


def ps(text):
    return [(line, col, v, c, p) for line, col, v, c, p, *_ in ct.powershell(text, "lodestone")]


def test_powershell_tokens():
    text = 'Invoke-WebRequest `\n  -Uri "http://a/`"x" `\n  -Method:Post\nSet-Content x.txt @"\n10.0.0.1 "q"\n"@\nGet-Item a | Out-File -FilePath \'it\'\'s\' # "no"\n<# "no" #> if ($x) { Invoke-RestMethod (New-Object System.Uri "http://b") }\n$v = New-Object Net.X \'h\''
    assert ps(text) == [
        (2, 8, 'http://a/"x', "Invoke-WebRequest", "Uri"), (3, 11, "Post", "Invoke-WebRequest", "Method"), (4, 13, "x.txt", "Set-Content", None), (4, 19, '10.0.0.1 "q"', "Set-Content", None),
        (7, 10, "a", "Get-Item", None), (7, 33, "it's", "Out-File", "FilePath"), (8, 52, "System.Uri", "New-Object", None), (8, 63, "http://b", "New-Object", None), (9, 17, "Net.X", "New-Object", None), (9, 23, "h", "New-Object", None),
    ]


def test_powershell_findings_by_command(spark):
    text = "Invoke-WebRequest `\n  -Uri http://10.0.0.1/ | Set-Content /etc/x\nWrite-Host '10.0.0.2'; New-Object `\n System.Uri `\n 'localhost'\nNew-Object Net.X '10.0.0.3'\n# lodestone: ignore portability.hardcoded.ipv4\nOut-File \"\\\\srv\\d 10.0.0.4\"\nOut-File @'\n10.0.0.5\n'@"
    f = spark.createDataFrame([("a.ps1", "Source", "powershell", text)], FILE)
    got = sorted((r.rule_id.removeprefix("portability.hardcoded."), r.line) for r in portability.powershell_findings(f).collect())
    assert got == [("filepath.linux", 2), ("filepath.windows", 8), ("ipv4", 2), ("ipv4", 9), ("localhost", 5)]


def test_work_grows_with_length():
    import time

    def took(n):
        text = "f(g(h(\n" * n + '"x"' + ")))" * n + "\n[" * n
        began = time.perf_counter()
        ct.csharp(text, (), "m")
        ct.powershell(text, "m")
        return time.perf_counter() - began

    took(100)
    assert took(8000) < 40 * max(took(1000), 0.005)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_texts_are_read_once_and_repeated_files_kept(spark, tmp_path):
    told = str(tmp_path / "calls")

    def read(text):
        with open(told, "a") as f:
            f.write("x")
        return [("k", i, 1, w, text) for i, w in enumerate(text.split())]

    texts = ["a b", "c", "a b", None, "", "a b"] * 50
    files = spark.createDataFrame([(f"p{i}", None, "go", t) for i, t in enumerate(texts)], "path string, category string, language string, text string").coalesce(1)
    got = sorted((r.path, r.line, r.value, r.content) for r in ct.tokens(files, read, ct.TEXT).collect())
    assert got == sorted((f"p{i}", j, w, t) for i, t in enumerate(texts) for j, w in enumerate((t or "").split()))
    assert len(open(told).read()) == 3


def test_detectors_read_their_files_once(spark):
    from lodestone.operators import magic, portability

    files = spark.createDataFrame([("a.cs", "Source", "csharp", 'x("10.1.2.3");')], "path string, category string, language string, text string")
    assert _plan(portability.csharp_findings(files)).count("MapInArrow") == 1
    assert _plan(portability.line_findings(files)).count("MapInArrow") == 1
    assert "MapInArrow" not in _plan(magic.occurrences(files))


def test_entropy_counts_characters_without_sorting_them(spark):
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    from lodestone.functions import scalars as fn

    texts = ["abab", "ä€𝄞a" * 3, "x" * 70_000 + "y", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn.entropy(F.col("t")).alias("e"))
    brute = lambda t: -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()) if t else 0.0
    assert all(abs(r.e - brute(texts[r.i])) < 1e-9 for r in df.collect()) and "sort" not in _plan(df)


def test_lines_of_whole_files_agree_with_windows_and_shuffle_nothing(spark):
    import random

    from conftest import SF
    from pyspark.sql import functions as F

    from lodestone.operators import lines as lo
    from lodestone.operators import text as to
    from lodestone.plans import catalogue

    r = random.Random(4)
    rows = [(i, "\n".join(r.choice(["{", "}", "{{", "} }", "mark", "", "x"]) for _ in range(r.randrange(1, 40)))) for i in range(60)] + [(90, None), (91, "")]
    files = spark.createDataFrame(rows, "file_id int, text string")
    lines = to.lines(files)
    got = lo.by_file(files, lo.depths, "depth long")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lo.brace_depth(lines).select("file_id", "line", "depth").collect()))
    near = lo.by_file(files, lambda x: lo.within(["mark" in y for y in x]), "near boolean")
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, lo.near(lines, F.contains("content", F.lit("mark"))).select("file_id", "line", "near").collect()))
    for name in ("brace_scope", "nearby_marker", "line_suppressions"):
        assert "Window" not in _plan(catalogue.QUERIES[name](spark, SF))
