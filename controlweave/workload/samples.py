"""Sampling: which population rows are tested."""

from __future__ import annotations

from pyspark.sql import functions as F

from controlweave.plans.run import population
from controlweave.workload.common import Query, control, covered, keep, match, table, tables, verdicts

SEED = 42
STATISTICAL_SIZE = 384.14588206941227  # Cochran's size for 95 % confidence and 5 % precision


def draw_sql(*columns: str) -> str:
    parts = ", ".join(
        f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns
    )
    return f"md5(concat_ws('#', {parts}, '{SEED}'))"


ORDER_DRAW = draw_sql("o_orderkey")
FLAGS = ("l_returnflag", "l_linestatus", "l_linenumber")


def sampled(method: str, **plan) -> dict:
    return {"enabled": True, "method": method, "random_seed": SEED, **plan}


def of_orders(plan: dict, steps=()):
    return covered(("orders",), control("orders", steps, sampling={**plan, "sample_key": ["o_orderkey"]}))


def whole_rows(spark, sf_dir):
    """Rows without a key: many are exact copies of each other."""
    catalog = tables(spark, sf_dir).add("flags", table(spark, sf_dir, "lineitem").select(*FLAGS))
    return population(control("flags", sampling=sampled("random", sample_size=5000)), catalog).frame


def systematic_rows(spark, sf_dir):
    catalog = tables(spark, sf_dir).add("flags", table(spark, sf_dir, "lineitem").select(*FLAGS))
    return population(control("flags", sampling=sampled("systematic", sample_percentage=0.02)), catalog).frame


def judgmental(spark, sf_dir):
    picks = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 50).select(F.col("l_orderkey").alias("o_orderkey"))
    catalog = tables(spark, sf_dir, "orders").add("picks", picks)
    plan = sampled("judgmental", sample_key=["o_orderkey"], selection_dataset="picks", justification="large items")
    return population(control("orders", sampling=plan), catalog).frame


def stratified_sql(size: int) -> str:
    """Largest remainder by stratum; strata below one row give one."""
    return f"""
WITH sizes AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1),
marked AS (SELECT *, {size} * n < sum(n) OVER () AS small FROM sizes),
parts AS (SELECT *, {size} - count(*) FILTER (WHERE small) OVER () AS rest, sum(n) FILTER (WHERE NOT small) OVER () AS big FROM marked),
based AS (SELECT *, CASE WHEN small THEN 1 ELSE rest * n // big END AS base, CASE WHEN small THEN -1 ELSE rest * n % big END AS over FROM parts),
placed AS (SELECT *, row_number() OVER (ORDER BY over DESC, n DESC, p) AS place, {size} - sum(base) OVER () AS remaining FROM based),
quotas AS (SELECT p, base + CASE WHEN place <= remaining THEN 1 ELSE 0 END AS quota FROM placed)
SELECT * EXCLUDE (rn, p, quota) FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {ORDER_DRAW}) AS rn FROM orders)
JOIN quotas ON o_orderpriority = p WHERE rn <= quota"""


def shared_key_sizes(spark, sf_dir):
    """Rows and keys of samples by a key that several rows share: keys stay whole at every size."""
    catalog = tables(spark, sf_dir, "lineitem")
    sizes = []
    for n in (2000, 2004):
        spec = control("lineitem", sampling=sampled("random", sample_size=n, sample_key=["l_orderkey"]))
        found = population(spec, catalog).frame
        sizes.append(found.agg(F.lit(n).alias("wanted"), F.count("*").alias("n_rows"), F.count_distinct("l_orderkey").alias("n_keys")))
    return sizes[0].union(sizes[1])


def sampled_report(spark, sf_dir):
    spec = control(
        "orders",
        [keep("o_orderstatus", "eq", "F")],
        [match("o_orderpriority", "neq", "5-LOW", threshold=25.0)],
        sampled("random", sample_size=400, sample_key=["o_orderkey"]),
        "CTRL-SAMPLED",
    )
    return verdicts([spec], tables(spark, sf_dir, "orders"))


QUERIES = {
    "sample_random_n": Query(
        of_orders(sampled("random", sample_size=250), [keep("o_totalprice", "gt", 100000)]),
        f"SELECT * FROM orders WHERE o_totalprice > 100000 ORDER BY {ORDER_DRAW} LIMIT 250",
    ),
    "sample_random_large_n": Query(
        of_orders(sampled("random", sample_size=4000)),
        f"SELECT * FROM orders ORDER BY {ORDER_DRAW} LIMIT 4000",
    ),
    "sample_random_whole_rows": Query(
        whole_rows,
        f"SELECT {', '.join(FLAGS)} FROM lineitem ORDER BY {draw_sql(*FLAGS)} LIMIT 5000",
    ),
    "sample_percent": Query(
        of_orders(sampled("random", sample_percentage=0.05)),
        f"""
SELECT * EXCLUDE (rn, n) FROM (
  SELECT *, row_number() OVER (ORDER BY {ORDER_DRAW}) AS rn, count(*) OVER () AS n FROM orders)
WHERE rn <= floor(n * CAST(0.05 AS DOUBLE) + 0.5)""",
    ),
    "sample_stratified": Query(
        of_orders(sampled("stratified", sample_size=300, stratification_field="o_orderpriority")),
        stratified_sql(300),
    ),
    # five strata of about one size: rounding each would miss the total
    "sample_stratified_remainder": Query(
        of_orders(sampled("stratified", sample_size=103, stratification_field="o_orderpriority")),
        stratified_sql(103),
    ),
    "sample_shared_key": Query(
        shared_key_sizes,
        f"""
WITH drawn AS (SELECT l_orderkey, {draw_sql("l_orderkey")} AS d FROM lineitem),
keys AS (SELECT l_orderkey, d, count(*) AS n FROM drawn GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (ORDER BY d) AS total FROM keys)
SELECT wanted, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys
FROM upto, (VALUES (2000), (2004)) AS w(wanted) WHERE total - n < wanted GROUP BY wanted""",
    ),
    "sample_systematic": Query(
        of_orders(sampled("systematic", sample_size=200)),
        f"""
SELECT * EXCLUDE (r, k) FROM (
  SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, greatest(1, count(*) OVER () // 200) AS k FROM orders)
WHERE r % k = {SEED} % k AND r // k < 200""",
    ),
    "sample_systematic_whole_rows": Query(
        systematic_rows,
        f"""
SELECT * EXCLUDE (r) FROM (
  SELECT {', '.join(FLAGS)}, row_number() OVER (ORDER BY {', '.join(FLAGS)}) - 1 AS r FROM lineitem)
WHERE r % 50 = {SEED} % 50""",
    ),
    "sample_judgmental": Query(
        judgmental,
        "SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)",
    ),
    "sample_statistical": Query(
        of_orders(sampled("statistical", confidence_level=0.95, precision=0.05)),
        f"""
SELECT * EXCLUDE (rn, n) FROM (
  SELECT *, row_number() OVER (ORDER BY {ORDER_DRAW}) AS rn, count(*) OVER () AS n FROM orders)
WHERE rn <= ceil(CAST({STATISTICAL_SIZE} AS DOUBLE) / (1 + (CAST({STATISTICAL_SIZE} AS DOUBLE) - 1) / n))""",
    ),
    "sample_report": Query(
        sampled_report,
        f"""
SELECT 'CTRL-SAMPLED' AS control_id,
       CASE WHEN CAST(e AS DOUBLE) / s * 100 <= 25 THEN 'PASS' ELSE 'FAIL' END AS verdict,
       e AS exception_count, p AS total_population, s AS sampled_population,
       round(CAST(e AS DOUBLE) / s * 100, 2) AS exception_rate_percent,
       CAST(25 AS DOUBLE) AS materiality_threshold_percent, CAST(0 AS BIGINT) AS group_population,
       CAST(NULL AS DOUBLE) AS group_exception_rate_percent
FROM (SELECT count(*) AS p FROM orders WHERE o_orderstatus = 'F'),
     (SELECT count(*) AS s, count(*) FILTER (WHERE (o_orderpriority <> '5-LOW') IS NOT TRUE) AS e
      FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY {ORDER_DRAW} LIMIT 400))""",
    ),
}
