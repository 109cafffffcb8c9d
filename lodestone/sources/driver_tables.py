"""Views of the driver's tables in the shape of the analytical store, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, rule_id, file_path, line, severity, confidence, fingerprint)``: line items as findings, a run for each year of orders."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("run_id"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    rows = li.join(runs, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    severity = F.when(F.col("l_returnflag") == "R", "Error").when(F.col("l_returnflag") == "A", "Warning").otherwise("Info")
    return rows.select(
        "run_id", F.col("p_type").alias("rule_id"), F.concat_ws("/", "p_brand", F.col("l_partkey").cast("string")).alias("file_path"), F.col("l_linenumber").alias("line"),
        severity.alias("severity"), F.when(F.col("l_linestatus") == "O", "High").otherwise("Low").alias("confidence"), F.concat_ws(":", "l_partkey", "l_linenumber").alias("fingerprint"),
    )


FINDINGS_SQL = """findings as (
  select year(o_orderdate) as run_id, p_type as rule_id, p_brand || '/' || l_partkey as file_path, l_linenumber as line,
    case l_returnflag when 'R' then 'Error' when 'A' then 'Warning' else 'Info' end as severity,
    case l_linestatus when 'O' then 'High' else 'Low' end as confidence, l_partkey || ':' || l_linenumber as fingerprint
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, author, ts, lines, kind)``: events as a commit log."""
    k = F.get_json_object("props", "$.k")
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "value", "event_type", k.cast("int").alias("k"))
    path = F.concat(F.lit("d"), (F.col("k") % 10).cast("string"), F.lit("/f"), F.col("k").cast("string"))
    return ev.select(path.alias("path"), F.col("user_id").alias("author"), F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("long").alias("lines"), F.col("event_type").alias("kind"))


COMMITS_SQL = """keyed as (select *, cast(json_extract_string(props, '$.k') as int) as k from events),
commits as (
  select 'd' || (k % 10) || '/f' || k as path, user_id as author, ts, cast(floor(value) as bigint) as lines, event_type as kind from keyed)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, size, metric)``: customers as files below region, nation and segment."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by definition
    size = F.greatest(F.lit(1), F.floor("c_acctbal")).cast("long")
    return rows.select(F.concat_ws("/", "r_name", "n_name", "c_mktsegment", F.col("c_custkey").cast("string")).alias("path"), size.alias("size"), (F.col("c_custkey") % 100).cast("double").alias("metric"))


TREE_SQL = """tree as (
  select r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_custkey as path,
    greatest(1, cast(floor(c_acctbal) as bigint)) as size, cast(c_custkey % 100 as double) as metric
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
