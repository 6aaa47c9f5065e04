"""Row rules: each query lists the rows that break the rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from controlweave.plans.run import attribution, attribution_counts, exceptions
from controlweave.workload.common import Query, computed, control, join, keep, match, rule, tables
from controlweave.workload.populations import LABELLED, SQL_OPERATORS

ITEM_WITH_ORDER = """
SELECT l.*, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
       o.o_orderkey AS ord_o_orderkey
FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey"""

WITH_ORDER = ("ord", join("orders", "l_orderkey", "o_orderkey"))


def offending(names: tuple[str, ...], spec) -> Query:
    return lambda spark, sf_dir: exceptions(spec, tables(spark, sf_dir, *names), combine="all")["exceptions"]


def one_rule(table: str, condition: str, rule_: dict, source: str | None = None, names=None, steps=()) -> Query:
    """Exceptions of one rule: rows for which the SQL condition is not true."""
    return Query(
        offending(names or (table,), control(table, steps, [rule_])),
        f"SELECT * FROM {source or table} WHERE ({condition}) IS NOT TRUE",
    )


def value_match_queries() -> dict[str, Query]:
    numbers = {"eq": 10, "neq": 10, "gt": 5, "lt": 45, "gte": 25, "lte": 30}
    out = {
        f"value_match_{op}": one_rule("part", f"p_size {SQL_OPERATORS[op]} {n}", match("p_size", op, n))
        for op, n in numbers.items()
    }
    lab = ("lab", join("labels", "doc_id", "doc_id"))
    labelled = dict(source=f"({LABELLED})", names=("documents", "labels"), steps=[lab])
    out["value_match_in"] = one_rule(
        "orders", "o_orderstatus IN ('F', 'O')", match("o_orderstatus", "in", ["F", "O"])
    )
    out["value_match_in_numbers"] = one_rule(
        "part", "p_size IN (1, 2, 3, 5, 8, 13, 21, 34)", match("p_size", "in", [1, 2, 3, 5, 8, 13, 21, 34])
    )
    out["value_match_not_in"] = one_rule(
        "orders",
        "o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')",
        match("o_orderpriority", "not_in", ["5-LOW", "4-NOT SPECIFIED"]),
    )
    # unlabelled documents have a NULL quality and so break both of these
    out["value_match_not_in_null"] = one_rule(
        "documents", "quality NOT IN (0)", match("quality", "not_in", [0]), **labelled
    )
    out["value_match_null"] = one_rule("documents", "quality IS NULL", match("quality", "eq", None), **labelled)
    out["value_match_not_null"] = one_rule(
        "documents", "quality IS NOT NULL", match("quality", "neq", None), **labelled
    )
    out["value_match_case_space"] = one_rule(
        "customer",
        "trim(upper(CAST(c_mktsegment AS VARCHAR))) = trim(upper('  machinery '))",
        match("c_mktsegment", "eq", "  machinery "),
    )
    out["value_match_text_order"] = one_rule(
        "customer",
        "trim(upper(CAST(c_mktsegment AS VARCHAR))) > trim(upper('building'))",
        match("c_mktsegment", "gt", "building"),
    )
    out["value_match_exact_case"] = one_rule(
        "customer",
        "c_mktsegment <> 'machinery'",
        match("c_mktsegment", "neq", "machinery", ignore_case_and_space=False),
    )
    out["value_match_exact_case_eq"] = one_rule(
        "customer",
        "c_mktsegment = 'MACHINERY'",
        match("c_mktsegment", "eq", "MACHINERY", ignore_case_and_space=False),
    )
    out["value_match_bool"] = one_rule(
        "lineitem",
        "heavy = TRUE",
        match("heavy", "eq", True),
        source="(SELECT *, l_quantity > 10 AS heavy FROM lineitem)",
        steps=[computed("heavy", "l_quantity > 10")],
    )
    out["value_match_contains"] = one_rule(
        "part",
        "contains(trim(upper(CAST(p_name AS VARCHAR))), trim(upper('Ring')))",
        match("p_name", "contains", "Ring"),
    )
    out["value_match_not_contains"] = one_rule(
        "part",
        "NOT contains(trim(upper(CAST(p_name AS VARCHAR))), trim(upper(' bolt')))",
        match("p_name", "not_contains", " bolt"),
    )
    return out


def date_queries() -> dict[str, Query]:
    out = {}
    for op, days in {"lte": 30, "lt": -30, "gte": 0, "gt": 365, "eq": 2}.items():
        out[f"temporal_date_math_{op}"] = one_rule(
            "lineitem",
            f"CAST(l_shipdate AS DATE) {SQL_OPERATORS[op]} CAST(o_orderdate AS DATE) + INTERVAL ({days}) DAY",
            rule(
                "temporal_date_math",
                base_date_field="l_shipdate", operator=op, target_date_field="orders.o_orderdate",
                offset_days=days,
            ),
            source=f"({ITEM_WITH_ORDER})",
            names=("lineitem", "orders"),
            steps=[WITH_ORDER],
        )
    out["temporal_sequence"] = one_rule(
        "lineitem",
        "o_orderdate < l_shipdate AND l_shipdate < due",
        rule("temporal_sequence", event_chain=["o_orderdate", "lineitem.l_shipdate", "due"]),
        source=f"(SELECT *, o_orderdate + INTERVAL 90 DAY AS due FROM ({ITEM_WITH_ORDER}))",
        names=("lineitem", "orders"),
        steps=[WITH_ORDER, computed("due", "o_orderdate + INTERVAL 90 DAYS")],
    )
    for op, (left, right) in {
        "eq": ("l_tax", "l_discount"),
        "neq": ("l_partkey", "l_suppkey"),
        "gt": ("o_totalprice", "l_extendedprice"),
        "lt": ("l_orderkey", "l_partkey"),
        "gte": ("l_shipdate", "o_orderdate"),
        "lte": ("l_linenumber", "l_quantity"),
    }.items():
        out[f"column_comparison_{op}"] = one_rule(
            "lineitem",
            f"{left} {SQL_OPERATORS[op]} {right}",
            rule("column_comparison", left_field=left, operator=op, right_field=right),
            source=f"({ITEM_WITH_ORDER})",
            names=("lineitem", "orders"),
            steps=[WITH_ORDER],
        )
    return out


THREE_RULES = control(
    "lineitem",
    [WITH_ORDER, keep("l_quantity", "gt", 20)],
    [
        match("o_orderstatus", "in", ["F", "O"], "status_known"),
        rule("column_comparison", "shipped_after_order", left_field="l_shipdate", operator="gt", right_field="o_orderdate"),
        match("l_discount", "lte", 0.08, "discount_limit"),
    ],
)
THREE_SQL = f"""
SELECT *, (o_orderstatus IN ('F', 'O')) IS NOT TRUE AS x1,
       (l_shipdate > o_orderdate) IS NOT TRUE AS x2, (l_discount <= 0.08) IS NOT TRUE AS x3
FROM ({ITEM_WITH_ORDER}) WHERE l_quantity > 20"""


def attributed(spark, sf_dir):
    found = attribution(THREE_RULES, tables(spark, sf_dir, "lineitem", "orders"))
    return found.withColumn("failed_assertions", F.array_join("failed_assertions", ","))


QUERIES = {
    **value_match_queries(),
    **date_queries(),
    "exceptions_any_rule": Query(
        offending(("lineitem", "orders"), THREE_RULES),
        f"SELECT * EXCLUDE (x1, x2, x3) FROM ({THREE_SQL}) WHERE x1 OR x2 OR x3",
    ),
    "assertion_attribution": Query(
        attributed,
        f"""
SELECT * EXCLUDE (x1, x2, x3),
       concat_ws(',', CASE WHEN x1 THEN 'status_known' END, CASE WHEN x2 THEN 'shipped_after_order' END,
                 CASE WHEN x3 THEN 'discount_limit' END) AS failed_assertions
FROM ({THREE_SQL}) WHERE x1 OR x2 OR x3""",
    ),
    "assertion_attribution_counts": Query(
        lambda spark, sf_dir: attribution_counts(THREE_RULES, tables(spark, sf_dir, "lineitem", "orders")),
        f"""
SELECT 'status_known' AS assertion_id, count(*) FILTER (WHERE x1) AS exception_count FROM ({THREE_SQL})
UNION ALL SELECT 'shipped_after_order', count(*) FILTER (WHERE x2) FROM ({THREE_SQL})
UNION ALL SELECT 'discount_limit', count(*) FILTER (WHERE x3) FROM ({THREE_SQL})""",
    ),
}
