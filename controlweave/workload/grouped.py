"""Group rules: each query lists the groups that break the rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from controlweave.plans.metrics import metrics
from controlweave.plans.run import exceptions
from controlweave.workload.common import Query, control, join, keep, match, rule, tables
from controlweave.workload.populations import SQL_OPERATORS


def limit(function: str, keys: list[str], field: str, operator: str, threshold, assertion_id="g1") -> dict:
    return rule(
        "aggregation", assertion_id,
        group_by_fields=keys, metric_field=field, aggregation_function=function,
        operator=operator, threshold=threshold,
    )


def rounded(frame):
    """Money sums to cents, so the order of addition does not show."""
    for name in ("metric_value", "total_amount"):
        if name in frame.columns and dict(frame.dtypes)[name] == "double":
            frame = frame.withColumn(name, F.round(name, 2))
    return frame


def groups(name: str, spec, combine: str = "each", rule_id: str = "g1"):
    def run(spark, sf_dir):
        found = exceptions(spec, tables(spark, sf_dir, name), combine=combine)
        return rounded(found["exceptions" if combine == "all" else rule_id])

    return run


def single(table: str, function: str, key: str, field: str, operator: str, threshold, numeric: bool = True) -> Query:
    value = f"{function}({field})"
    metric = f"round({value}, 2)" if function in ("SUM", "AVG") else value
    total = f"round(sum({field}), 2)" if numeric else "CAST(NULL AS DOUBLE)"
    return Query(
        groups(table, control(table, [], [limit(function, [key], field, operator, threshold)])),
        f"""
SELECT {key}, count(*) AS exception_count, {metric} AS metric_value, {total} AS total_amount
FROM {table} GROUP BY {key} HAVING ({value} {SQL_OPERATORS[operator]} {threshold}) IS NOT TRUE""",
    )


DEPRECATED = rule(
    "aggregation_sum", "g1",
    group_by_fields=["l_suppkey"], metric_field="lineitem.l_extendedprice", operator="lte", threshold=30000000.0,
)

TWO_LIMITS = control(
    "orders",
    [keep("o_orderstatus", "neq", "P")],
    [
        limit("SUM", ["o_custkey"], "o_totalprice", "lte", 1500000.0, "sum_limit"),
        limit("COUNT", ["o_custkey"], "o_orderkey", "lte", 6, "count_limit"),
    ],
)
MIXED = control(
    "orders",
    [],
    [
        match("o_orderpriority", "neq", "1-URGENT", "not_urgent"),
        limit("SUM", ["o_custkey"], "o_totalprice", "lte", 1000000.0, "sum_limit"),
    ],
)
TWO_GRAINS = control(
    "orders",
    [],
    [
        limit("AVG", ["o_custkey"], "o_totalprice", "lte", 300000.0, "by_customer"),
        limit("MAX", ["o_orderdate"], "o_totalprice", "lte", 495000.0, "by_day"),
    ],
)


def any_of_two(spark, sf_dir):
    """Failing groups of each rule, told apart by the rule's id."""
    found = exceptions(TWO_LIMITS, tables(spark, sf_dir, "orders"))
    parts = [
        rounded(frame.withColumn("metric_value", F.col("metric_value").cast("double"))).select(
            F.lit(name).alias("assertion_id"), "o_custkey", "exception_count", "metric_value"
        )
        for name, frame in found.items()
    ]
    return parts[0].unionByName(parts[1])


def counts_of(spec, *names):
    return lambda spark, sf_dir: metrics([spec], tables(spark, sf_dir, *names))


def population_count(spark, sf_dir):
    spec = control(
        "orders",
        [("cust", join("customer", "o_custkey", "c_custkey")), keep("o_totalprice", "gt", 100000)],
        [match("c_mktsegment", "in", ["BUILDING", "MACHINERY"])],
    )
    counted = metrics([spec], tables(spark, sf_dir, "orders", "customer"))
    return counted.select("total_population", F.col("row_exceptions").alias("exception_count"))


QUERIES = {
    "agg_sum": single("orders", "SUM", "o_custkey", "o_totalprice", "lte", 2500000),
    "agg_count": single("orders", "COUNT", "o_custkey", "o_orderkey", "lt", 12),
    "agg_count_text": single("orders", "COUNT", "o_custkey", "o_orderstatus", "lt", 12, numeric=False),
    "agg_avg": single("lineitem", "AVG", "l_suppkey", "l_quantity", "gte", 25.4),
    "agg_min": single("part", "MIN", "p_brand", "p_retailprice", "gt", 901),
    "agg_max": single("part", "MAX", "p_brand", "p_retailprice", "eq", 999.9),
    "agg_sum_deprecated": Query(
        groups("lineitem", control("lineitem", [], [DEPRECATED])),
        """
SELECT l_suppkey, count(*) AS exception_count, round(sum(l_extendedprice), 2) AS metric_value,
       round(sum(l_extendedprice), 2) AS total_amount
FROM lineitem GROUP BY l_suppkey HAVING (sum(l_extendedprice) <= 30000000.0) IS NOT TRUE""",
    ),
    "agg_multi_any": Query(
        any_of_two,
        """
SELECT 'sum_limit' AS assertion_id, o_custkey, count(*) AS exception_count,
       round(sum(o_totalprice), 2) AS metric_value
FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING (sum(o_totalprice) <= 1500000) IS NOT TRUE
UNION ALL
SELECT 'count_limit', o_custkey, count(*), CAST(count(o_orderkey) AS DOUBLE)
FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING (count(o_orderkey) <= 6) IS NOT TRUE""",
    ),
    "agg_multi_all": Query(
        groups("orders", TWO_LIMITS, "all"),
        """
SELECT o_custkey, count(*) AS exception_count, round(sum(o_totalprice), 2) AS total_amount
FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey
HAVING (sum(o_totalprice) <= 1500000) IS NOT TRUE AND (count(o_orderkey) <= 6) IS NOT TRUE""",
    ),
    "agg_mixed": Query(
        counts_of(MIXED, "orders"),
        """
SELECT 'CTRL' AS control_id, p AS total_population, p AS sampled_population, e AS row_exceptions,
       f AS failing_groups, g AS group_population
FROM (SELECT count(*) AS p, count(*) FILTER (WHERE (o_orderpriority <> '1-URGENT') IS NOT TRUE) AS e FROM orders),
     (SELECT count(*) AS g, count(*) FILTER (WHERE (s <= 1000000) IS NOT TRUE) AS f
      FROM (SELECT sum(o_totalprice) AS s FROM orders GROUP BY o_custkey))""",
    ),
    "agg_mixed_all": Query(
        groups("orders", MIXED, "all"),
        """
SELECT o_custkey, count(*) AS exception_count, round(sum(o_totalprice), 2) AS total_amount
FROM orders WHERE (o_orderpriority <> '1-URGENT') IS NOT TRUE
GROUP BY o_custkey HAVING (sum(o_totalprice) <= 1000000) IS NOT TRUE""",
    ),
    "agg_two_grains": Query(
        counts_of(TWO_GRAINS, "orders"),
        """
SELECT 'CTRL' AS control_id, p AS total_population, p AS sampled_population, CAST(0 AS BIGINT) AS row_exceptions,
       f1 + f2 AS failing_groups, g1 + g2 AS group_population
FROM (SELECT count(*) AS p FROM orders),
     (SELECT count(*) AS g1, count(*) FILTER (WHERE (v <= 300000) IS NOT TRUE) AS f1
      FROM (SELECT avg(o_totalprice) AS v FROM orders GROUP BY o_custkey)),
     (SELECT count(*) AS g2, count(*) FILTER (WHERE (v <= 495000) IS NOT TRUE) AS f2
      FROM (SELECT max(o_totalprice) AS v FROM orders GROUP BY o_orderdate))""",
    ),
    "population_count": Query(
        population_count,
        """
SELECT count(*) AS total_population,
       count(*) FILTER (WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY')) IS NOT TRUE) AS exception_count
FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000""",
    ),
}
