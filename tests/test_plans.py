"""The physical plans are the ones meant: pruned, pushed down, without Python."""

import os
import re

import pytest

from controlweave.operators.joins import latest_per_key
from controlweave.plans.run import exceptions, population, report
from controlweave.workload.common import control, join, keep, match, tables
from controlweave.workload.grouped import limit
from controlweave.workload.registry import registered

from helpers import plan

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def read_schemas(text):
    return re.findall(r"ReadSchema: struct<(.*?)>", text)


def test_reports_read_only_the_columns_they_use(spark):
    spec = control("orders", [keep("o_totalprice", "gt", 100000), ("c", join("customer", "o_custkey", "c_custkey"))],
                   [match("c_mktsegment", "in", ["BUILDING"])])
    text = plan(report([spec], tables(spark, SF_DIR, "orders", "customer")))
    assert sorted(read_schemas(text)) == [
        "c_custkey:bigint,c_mktsegment:string", "o_custkey:bigint,o_totalprice:double"
    ]
    assert "GreaterThan(o_totalprice,100000.0)" in text
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text


def test_timestamp_filters_reach_the_scan(spark):
    from datetime import datetime

    spec = control("orders", [keep("o_orderdate", "gte", datetime(1998, 1, 1))])
    text = plan(population(spec, tables(spark, SF_DIR, "orders")).frame)
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00" in text


def test_a_match_filter_turns_the_left_join_inner(spark):
    spec = control("orders", [("c", join("customer", "o_custkey", "c_custkey")),
                              {"operation": "filter_is_null", "field": "c_c_custkey", "is_null": False}])
    text = plan(population(spec, tables(spark, SF_DIR, "orders", "customer")).frame)
    assert "LeftOuter" not in text and "Inner" in text


def test_group_rules_combine_before_the_shuffle(spark):
    spec = control("lineitem", [], [limit("SUM", ["l_suppkey"], "l_extendedprice", "lte", 1)])
    text = plan(exceptions(spec, tables(spark, SF_DIR, "lineitem"))["g1"], "simple")
    assert "partial_sum(l_extendedprice" in text and text.count("Exchange") == 1


def test_latest_rows_are_limited_before_the_shuffle(spark):
    orders = tables(spark, SF_DIR, "orders").frame("orders")
    text = plan(latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]), "simple")
    assert text.index("row_number(), 1, Final") < text.index("Exchange") < text.index("row_number(), 1, Partial")


@pytest.mark.parametrize("name", [n for n in registered() if not n.startswith(("stream_", "evidence_manifest", "control_error", "batch_summary"))])
def test_no_python_rows_and_no_products(spark, name):
    text = plan(registered()[name].run(spark, SF_DIR), "simple")
    for operator in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text
