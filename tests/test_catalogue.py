import pytest
from conftest import SF

from lodestone.operators import findings as fo
from lodestone.operators import history as ho
from lodestone.operators import text as to
from lodestone.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_agrees_with_sql(spark, same, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) >= {"rule_id", "total"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_gini_of_one_author_is_one_and_even_shares_are_zero(spark):
    rows = spark.sql("select * from values ('a', 1), ('b', 1), ('b', 2) as t(path, author)").selectExpr("*", "timestamp '2024-01-01 00:00:00' as ts", "1L as lines")
    assert {r.path: r.concentration for r in ho.gini(rows).collect()} == {"a": 1.0, "b": 0.0}


def test_scan_of_nulls_and_no_files(spark):
    files = spark.createDataFrame([(1, None), (2, ""), (3, "x\nat 10.0.0.1 and 10.0.0.2")], "file_id int, text string")
    assert [(r.file_id, r.line, r.matches) for r in to.scan(files).collect()] == [(3, 2, 2)]
    assert to.scan(files.limit(0)).count() == 0


def test_page_limits_are_clamped(spark):
    f = spark.createDataFrame([(1, "r", "p", i, "Info", "Low", str(i)) for i in range(3)], "run_id int, rule_id string, file_path string, line int, severity string, confidence string, fingerprint string")
    assert [r.line for r in fo.page(f, -5, 0).collect()] == [0]


def test_bench_names_are_registered():
    import __spark_entry__
    import bench

    assert set(bench.HEADLINE) <= set(__spark_entry__.queries())


def test_positions_are_those_of_addresses(spark):
    rows = catalogue.QUERIES["text_scan_positions"](spark, SF).select("value").distinct().collect()
    parts = [r.value.split(".") for r in rows]
    assert parts and all(len(p) == 4 and all(int(x) <= 255 for x in p) for p in parts)
