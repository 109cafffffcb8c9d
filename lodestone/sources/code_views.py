"""Orders as source files of a repository: a file for each order, its lines chosen from templates by the order's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .driver_tables import table

KINDS = ("csharp", "python", "rust", "cpp", "powershell", "go", "json")
FOLDERS = ("src/net", "tests/unit", "src/core", "lib/test/x", "App.Tests.Core", "tools", "src/legacy")
ENDINGS = (".cs", ".py", ".rs", ".cpp", ".ps1", ".go", ".json")
CATEGORIES = ("Source", "Source", "Source", "Source", "Source", "Source", "Config")
LINES = 8
TEMPLATES = {
    "csharp": (
        'var u = new Uri("http://10.0.{k}.7/api");',
        'var c = Environment.GetEnvironmentVariable("host10.1.{k}.2");',
        'string s = "Server=db{k};Password=x"; // lodestone: ignore portability.hardcoded.connectionstring',
        'client.Connect("localhost", 50{k});',
        'var b = new BlobServiceClient(name);',
        'var p = @"C:\\data\\set{k}";',
        '[Route("management.azure.com/v{k}")]',
        "x = Math.Max({k}, 7); // TODO tidy {k}",
        'log.Write("region eastus2 and {k}");',
        "public async void Load{k}() { }",
        "lock (this) { count++; }",
        "if (flags.IsEnabled(\"NewPanel{k}\")) { }",
    ),
    "python": (
        "r = requests.get('https://store{k}.blob.core.windows.net/x')",
        'path = "/var/log/app{k}"',
        "s.bind(('0.0.0.0', 81{k}))",
        'sock = socket.create_connection(("10.9.{k}.1", 9{k}))',
        "# lodestone: ignore portability.hardcoded.ipv4",
        'host = "10.2.3.{k}"',
        "x = 8{k}0  # FIXME slow",
        "asyncio.run(main())",
        "async def work{k}():",
        "    time.sleep({k})",
    ),
    "rust": ('let u = reqwest::get("http://169.254.169.254/{k}");', 'let key = "HKEY_LOCAL_MACHINE\\Soft{k}";', "let a = std::net::bind(80{k}, 443);", 'let t = "tenant 12345678-1234-4abc-9abc-1234567890ab";', "// HACK {k}"),
    "cpp": ('fopen("/etc/conf{k}", "r");', 'auto s = "accountkey=abc{k}";', "connect(fd, 70{k});", "int n = {k};", 'puts("plain {k}");'),
    "powershell": (
        'Invoke-WebRequest -Uri "http://10.4.{k}.5/"',
        "New-Object System.Uri 'http://localhost/{k}'",
        'New-Object Net.WebClient "10.5.5.{k}"',
        "Set-Content /opt/app{k} done",
        'Write-Host "10.6.6.{k}"',
        "Out-File -FilePath D:\\logs\\run{k}",
    ),
    "go": ('dial("10.7.{k}.1")', 'open("/opt/x{k}")', 'name := "westeurope"', 'if x == "beta{k}" {', 'u := "subscription = 12345678-1234-4abc-8abc-1234567890a{k}"'),
    "json": ('{ "host": "10.8.{k}.1",', '  "zone": "uksouth",', '  "path": "/var/x{k}",', '  "url": "https://login.microsoftonline.com/{k}" }'),
}


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def path_of(k) -> F.Column:
    """The path of an order's file."""
    return F.concat(_pick(FOLDERS, F.floor(k / 7).cast("long")), F.lit("/f"), k.cast("string"), _pick(ENDINGS, k))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, category, language, text)``; a language without a detector of its own is still named."""
    k = F.col("o_orderkey")
    number = (k % 250).cast("string")

    def line(i: int):
        out = F.lit(None).cast("string")
        for j, kind in reversed(list(enumerate(KINDS))):
            out = F.when(k % len(KINDS) == j, F.replace(_pick(TEMPLATES[kind], k + i * 3), F.lit("{k}"), number)).otherwise(out)
        return out

    return table(spark, sf_dir, "orders").select(path_of(k).alias("path"), _pick(CATEGORIES, k).alias("category"), _pick(KINDS, k).alias("language"), F.array_join(F.array(*[line(i) for i in range(LINES)]), "\n").alias("text"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _at(values, index: str) -> str:
    return f"{_list(values)}[({index}) % {len(values)} + 1]"


_LINE = "case o_orderkey % " + str(len(KINDS)) + " " + " ".join(f"when {j} then {_at(TEMPLATES[kind], 'o_orderkey + i * 3')}" for j, kind in enumerate(KINDS)) + " end"
CODE_SQL = f"""code as (
  select {_at(FOLDERS, "o_orderkey // 7")} || '/f' || o_orderkey || {_at(ENDINGS, "o_orderkey")} as path, {_at(CATEGORIES, "o_orderkey")} as category, {_at(KINDS, "o_orderkey")} as language,
    cast(i + 1 as int) as line, replace({_LINE}, '{{k}}', cast(o_orderkey % 250 as varchar)) as content from orders, range(0, {LINES}) t(i)),
tested as (select *, lower(path) like 'tests/%' or lower(path) like '%/tests/%' or lower(path) like '%/test/%' or lower(path) like '%.tests.%' as is_test from code)"""
