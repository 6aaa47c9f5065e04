"""Populations: filters, joins, computed fields."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from controlweave.operators.joins import equi_join, latest_per_key
from controlweave.plans.run import exceptions, population
from controlweave.workload.common import (
    Query,
    computed,
    control,
    covered,
    join,
    keep,
    keep_in,
    keep_null,
    rule,
    table,
    tables,
)

SQL_OPERATORS = {"eq": "=", "neq": "<>", "gt": ">", "lt": "<", "gte": ">=", "lte": "<="}

ORDERS_WITH_CUSTOMER = """
SELECT o.*, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment, c.c_custkey AS cust_c_custkey
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"""

LABELLED = """
SELECT d.*, l.quality, l.toxic, l.doc_id AS lab_doc_id
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def comparison_queries() -> dict[str, Query]:
    cases = {
        "eq": ("o_orderstatus", "F"),
        "neq": ("o_orderpriority", "5-LOW"),
        "gt": ("o_totalprice", 250000),
        "lt": ("o_totalprice", 50000.5),
        "gte": ("o_custkey", 700),
        "lte": ("o_orderpriority", "2-HIGH"),
    }
    out = {}
    for op, (field, value) in cases.items():
        literal = f"'{value}'" if isinstance(value, str) else value
        out[f"filter_comparison_{op}"] = Query(
            covered(("orders",), control("orders", [keep(field, op, value)])),
            f"SELECT * FROM orders WHERE {field} {SQL_OPERATORS[op]} {literal}",
        )
    return out


def role(spark, sf_dir, name):
    return table(spark, sf_dir, "conversations").filter(F.col("role") == name)


def composite(spark, sf_dir):
    """User turns beside the assistant turn that follows in the same conversation."""
    catalog = tables(spark, sf_dir)
    catalog.add("user_turns", role(spark, sf_dir, "user"))
    catalog.add("replies", role(spark, sf_dir, "assistant"))
    spec = control(
        "user_turns",
        [
            computed("next_turn", "turn + 1"),
            ("reply", join("replies", ["conv_id", "next_turn"], ["conv_id", "turn"])),
        ],
    )
    return population(spec, catalog).frame


def small_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_size") <= 10)


def inner(spark, sf_dir):
    catalog = tables(spark, sf_dir, "lineitem").add("small_parts", small_parts(spark, sf_dir))
    step = {
        "operation": "join",
        "join_type": "INNER",
        "right_dataset": "small_parts",
        "join_conditions": [{"left_field": "l_partkey", "right_field": "p_partkey"}],
    }
    return population(control("lineitem", [("part", step)]), catalog).frame


def referential(spark, sf_dir):
    catalog = tables(spark, sf_dir, "lineitem").add("small_parts", small_parts(spark, sf_dir))
    known = rule(
        "referential", "known_part",
        foreign_key_field="l_partkey", reference_dataset="small_parts", reference_key_field="p_partkey",
    )
    return exceptions(control("lineitem", [], [known]), catalog)["rows"]


def latest_orders(spark, sf_dir):
    tables(spark, sf_dir)
    return latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


def split_hot_join(spark, sf_dir):
    """Orders beside their items, those with more than five spread over shares."""
    tables(spark, sf_dir)
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    items = items.select("l_orderkey", "l_partkey", "l_quantity")
    return equi_join(orders, items, [("o_orderkey", "l_orderkey")], "left", rows_per_key=10**9, split_above=5)


LATEST_ORDER = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1"""

QUERIES = {
    **comparison_queries(),
    "filter_in_list": Query(
        covered(("orders",), control("orders", [keep_in("o_orderpriority", "1-URGENT", "2-HIGH")])),
        "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    ),
    "filter_timestamp": Query(
        covered(("orders",), control("orders", [keep("o_orderdate", "gte", datetime(1998, 1, 1))])),
        "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'",
    ),
    "filter_conjunction": Query(
        covered(
            ("orders", "customer"),
            control(
                "orders",
                [
                    keep("c_acctbal", "gt", 0),
                    ("cust", join("customer", "o_custkey", "c_custkey")),
                    keep_in("c_mktsegment", "BUILDING", "MACHINERY"),
                    keep("orders.o_totalprice", "lt", 200000),
                ],
            ),
        ),
        f"""SELECT * FROM ({ORDERS_WITH_CUSTOMER})
WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_totalprice < 200000""",
    ),
    "filter_is_null": Query(
        covered(
            ("documents", "labels"),
            control("documents", [("lab", join("labels", "doc_id", "doc_id")), keep_null("lab_doc_id", True)]),
        ),
        f"SELECT * FROM ({LABELLED}) WHERE lab_doc_id IS NULL",
    ),
    "filter_is_not_null": Query(
        covered(
            ("documents", "labels"),
            control("documents", [("lab", join("labels", "doc_id", "doc_id")), keep_null("labels.doc_id", False)]),
        ),
        f"SELECT * FROM ({LABELLED}) WHERE lab_doc_id IS NOT NULL",
    ),
    "filter_expression": Query(
        covered(
            ("lineitem",),
            control(
                "lineitem",
                [{"operation": "filter", "filter_expression": "l_returnflag == 'R' AND l_quantity > 40"}],
            ),
        ),
        "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40",
    ),
    "expression_qualified_names": Query(
        covered(
            ("lineitem", "orders"),
            control(
                "lineitem",
                [
                    ("ord", join("orders", "l_orderkey", "o_orderkey")),
                    computed("days", "DATEDIFF('day', orders.o_orderdate, lineitem.l_shipdate)"),
                    {"operation": "filter", "filter_expression": "ord.o_totalprice > 1000 AND days < 30 AND orders.o_orderstatus <> 'ord.x'"},
                ],
            ),
        ),
        """
SELECT l.*, o.* EXCLUDE (o_orderkey), o.o_orderkey AS ord_o_orderkey,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS days
FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey
WHERE o_totalprice > 1000 AND date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) < 30 AND o_orderstatus <> 'ord.x'""",
    ),
    "computed_field": Query(
        covered(
            ("lineitem", "orders"),
            control(
                "lineitem",
                [
                    ("ord", join("orders", "l_orderkey", "o_orderkey")),
                    computed("days_to_ship", "datediff(l_shipdate, o_orderdate)"),
                    keep("days_to_ship", "gt", 60),
                    keep("days_to_ship", "lte", 400),
                ],
            ),
        ),
        """
SELECT * FROM (
  SELECT l.*, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
         o.o_orderkey AS ord_o_orderkey,
         CAST(date_diff('day', o.o_orderdate, l.l_shipdate) AS INTEGER) AS days_to_ship
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey)
WHERE days_to_ship > 60 AND days_to_ship <= 400""",
    ),
    "join_left_single": Query(
        covered(
            ("orders", "customer"),
            control("orders", [("cust", join("customer", "o_custkey", "c_custkey"))]),
        ),
        ORDERS_WITH_CUSTOMER,
    ),
    "join_left_composite": Query(
        composite,
        """
SELECT u.*, u.turn + 1 AS next_turn, a.role AS role_1, a.text AS text_1,
       a.conv_id AS reply_conv_id, a.turn AS reply_turn
FROM (SELECT * FROM conversations WHERE role = 'user') u
LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a
  ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn""",
    ),
    "join_left_chained": Query(
        covered(
            ("orders", "customer", "nation", "region"),
            control(
                "orders",
                [
                    ("cust", join("customer", "o_custkey", "c_custkey")),
                    ("nat", join("nation", "c_nationkey", "n_nationkey")),
                    ("reg", join("region", "n_regionkey", "r_regionkey")),
                ],
            ),
        ),
        f"""
SELECT oc.*, n.n_name, n.n_regionkey, n.n_nationkey AS nat_n_nationkey,
       r.r_name, r.r_regionkey AS reg_r_regionkey
FROM ({ORDERS_WITH_CUSTOMER}) oc
LEFT JOIN nation n ON oc.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""",
    ),
    "join_fanout": Query(
        covered(
            ("lineitem", "orders"),
            control("orders", [("item", join("lineitem", "o_orderkey", "l_orderkey")), keep("o_totalprice", "gt", 300000)]),
        ),
        """
SELECT o.*, l.* EXCLUDE (l_orderkey), l.l_orderkey AS item_l_orderkey
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
WHERE o.o_totalprice > 300000""",
    ),
    "join_hot_keys_split": Query(
        split_hot_join,
        """
SELECT o.*, l.l_orderkey, l.l_partkey, l.l_quantity
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey""",
    ),
    "join_collision": Query(
        covered(
            ("documents", "benchmark"),
            control(
                "documents",
                [("item", join("benchmark", "doc_id", "item_id")), keep_null("benchmark.text", False)],
            ),
        ),
        """
SELECT d.*, b.text AS text_1, b.item_id AS item_item_id
FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id WHERE b.text IS NOT NULL""",
    ),
    "join_inner": Query(
        inner,
        """
SELECT l.*, p.p_name, p.p_brand, p.p_type, p.p_size, p.p_retailprice, p.p_partkey AS part_p_partkey
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size <= 10""",
    ),
    "join_latest": Query(
        covered(
            ("customer", "orders"),
            control(
                "customer",
                [("last", join("orders", "c_custkey", "o_custkey", latest_by=["o_orderdate", "o_orderkey"]))],
            ),
        ),
        f"""
SELECT c.*, o.o_orderkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
       o.o_custkey AS last_o_custkey
FROM customer c LEFT JOIN ({LATEST_ORDER}) o ON c.c_custkey = o.o_custkey""",
    ),
    "referential_integrity": Query(
        referential,
        """
SELECT * FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_size <= 10 AND p.p_partkey = l.l_partkey)""",
    ),
    "latest_per_key": Query(latest_orders, LATEST_ORDER),
}
