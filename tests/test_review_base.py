"""The adapter that builds reviews from the tables: its joins, and how often the queries over it read the tables."""

import datetime as dt

import pytest

from feedstack.plans import catalog
from feedstack.sources import testdata as TD

DAY = dt.datetime(1997, 5, 1)


@pytest.fixture
def tables(spark, tmp_path):
    rows = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
                     [(o, part, 1, n, 3.0, 10.0 * n, 0.05, 0.02, "N", "O", DAY)
                      for o, n, part in [(1, 1, 1), (1, 1, 1), (1, 2, 9), (1, 3, 2), (2, 1, 2), (3, 1, 1), (4, 1, 1), (None, 1, 1)]]),
        "orders": ("o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp_ntz",
                   [(1, 1, "LOW", DAY), (2, 2, "LOW", DAY), (3, 7, "LOW", DAY), (4, None, "LOW", DAY)]),
        "part": ("p_partkey long, p_name string, p_type string, p_brand string",
                 [(1, "a", "T", "B"), (2, "b", "T", "B"), (2, "c", "T", "B"), (None, "d", "T", "B")]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string", [(1, "x", 0, "M"), (2, "y", 0, "M")]),
        "nation": ("n_nationkey int, n_name string", [(0, "N")]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_base_keeps_matched_lines_and_numbers_them(spark, tables):
    # part 9, customer 7 and null keys match nothing; part 2 is there twice and so are its lines
    got = TD.review_base(spark, tables).select("l_orderkey", "line_no", "l_partkey").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 1, 2), (2, 2, 2)]


def test_base_sends_a_line_through_two_exchanges(spark, tables):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = TD.review_base(spark, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # one for each side of three joins, none for the window
    assert plan.count("Exchange hashpartitioning") == 6
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1


@pytest.mark.parametrize("query", [catalog.q_page_deep, catalog.q_potential_duplicates])
def test_repeated_steps_read_a_written_table(spark, tables, query):
    plan = query(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan


def test_parse_dates_filters_a_written_table(spark, tables):
    # a filter over the parse would be pushed below it and parse each line several times
    got = catalog.q_parse_dates(spark, tables)
    assert "parse_json" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.transform_date for r in got.collect()} == {DAY}
