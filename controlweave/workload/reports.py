"""Verdicts, pre-flight checks and batches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from controlweave.plans.metrics import exception_rows
from controlweave.plans.run import batch_summary, dry_run, run_controls, schema_drift
from controlweave.session import fresh_folder
from controlweave.sources.evidence import dataset_hash
from controlweave.sources.ledger import Ledger, current_controls
from controlweave.workload.common import (
    REPORT_COLUMNS,
    Query,
    computed,
    control,
    group_counts_sql,
    join,
    keep,
    match,
    report_sql,
    row_counts_sql,
    rule,
    table,
    tables,
    verdicts,
)
from controlweave.workload.grouped import limit

RUN_AT = datetime(2025, 6, 30, 12)
WITH_ORDER = ("ord", join("orders", "l_orderkey", "o_orderkey"))
ITEMS = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"


def one_report(control_id, names, base, steps, rules, source, compliant, threshold=0.0) -> Query:
    spec = control(base, steps, rules, control_id=control_id)
    return Query(
        lambda spark, sf_dir: verdicts([spec], tables(spark, sf_dir, *names)),
        report_sql(control_id, row_counts_sql(source, compliant), threshold),
    )


# Ten controls over the same joined rows; their filters and rules differ.
BATCH = [
    ("CTRL-01", [keep("l_quantity", "gt", 45)], match("l_discount", "lte", 0.09), "l_quantity > 45", "l_discount <= 0.09", 5.0),
    ("CTRL-02", [keep("l_returnflag", "eq", "R")], match("l_linestatus", "eq", "f"), "l_returnflag = 'R'", "l_linestatus = 'F'", 1.0),
    ("CTRL-03", [keep("o_orderstatus", "eq", "O")], match("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), "o_orderstatus = 'O'", "o_orderpriority IN ('1-URGENT', '2-HIGH')", 70.0),
    ("CTRL-04", [], match("l_tax", "neq", 0.08), "TRUE", "l_tax <> 0.08", 15.0),
    ("CTRL-05", [keep("o_totalprice", "gte", 200000)], match("o_orderpriority", "neq", None), "o_totalprice >= 200000", "o_orderpriority IS NOT NULL", 0.0),
    ("CTRL-06", [keep("o_orderdate", "lt", datetime(1999, 1, 1))], rule("column_comparison", left_field="l_shipdate", operator="gt", right_field="o_orderdate"), "o_orderdate < TIMESTAMP '1999-01-01'", "l_shipdate > o_orderdate", 10.0),
    ("CTRL-07", [keep("l_linenumber", "lte", 3)], rule("temporal_date_math", base_date_field="l_shipdate", operator="lte", target_date_field="o_orderdate", offset_days=2000), "l_linenumber <= 3", "CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) + INTERVAL 2000 DAY", 8.0),
    ("CTRL-08", [keep("l_partkey", "lt", 100)], match("l_suppkey", "not_in", [1, 2, 3]), "l_partkey < 100", "l_suppkey NOT IN (1, 2, 3)", 5.0),
    ("CTRL-09", [keep("l_quantity", "gt", 1000)], match("l_quantity", "gt", 0), "l_quantity > 1000", "l_quantity > 0", 0.0),
    ("CTRL-10", [keep("l_returnflag", "neq", "N")], rule("temporal_sequence", event_chain=["o_orderdate", "l_shipdate"]), "l_returnflag <> 'N'", "o_orderdate < l_shipdate", 60.0),
]


def batch_controls():
    out = []
    for control_id, steps, rule_, _, _, threshold in BATCH:
        rule_ = {**rule_, "materiality_threshold_percent": threshold}
        out.append(control("lineitem", [WITH_ORDER, *steps], [rule_], control_id=control_id))
    return out


BATCH_SQL = "\nUNION ALL\n".join(
    report_sql(control_id, row_counts_sql(f"{ITEMS} WHERE {where}", ok), threshold)
    for control_id, _, _, where, ok, threshold in BATCH
)


def shared_scan(spark, sf_dir):
    return verdicts(batch_controls(), tables(spark, sf_dir, "lineitem", "orders"))


def generated_controls(n: int):
    """n controls over items with their orders, all different: filters on two columns, one or two rules."""
    return [
        control(
            "lineitem",
            [WITH_ORDER, keep("l_quantity", "gt", 1 + i % 40), *([keep("l_returnflag", "eq", "RA"[i % 2])] if i % 3 == 0 else [])],
            [
                match("o_totalprice", "gt", 1000.0 + 50 * i, threshold=i % 100),
                *([match("o_orderpriority", "not_in", ["1-URGENT", "5-LOW"], "r2")] if i % 5 == 0 else []),
            ],
            control_id=f"GEN-{i:04d}",
        )
        for i in range(n)
    ]


def generated_report(n: int) -> Query:
    """Verdicts of n generated controls; the base and its join are read once."""
    return Query(
        lambda spark, sf_dir: verdicts(generated_controls(n), tables(spark, sf_dir, "lineitem", "orders")),
        f"""
WITH counted AS (
    SELECT i, count(*) AS p, count(*) FILTER (WHERE (o_totalprice > 1000.0 + 50 * i AND (i % 5 <> 0 OR o_orderpriority NOT IN ('1-URGENT', '5-LOW'))) IS NOT TRUE) AS e
    FROM range({n}) g(i) JOIN ({"SELECT * FROM " + ITEMS}) ON l_quantity > 1 + i % 40 AND (i % 3 <> 0 OR l_returnflag = substr('RA', 1 + CAST(i % 2 AS INT), 1))
    GROUP BY i
)
SELECT 'GEN-' || lpad(CAST(i AS VARCHAR), 4, '0') AS control_id,
       CASE WHEN CAST(e AS DOUBLE) / p * 100 <= i % 100 THEN 'PASS' ELSE 'FAIL' END AS verdict, e AS exception_count,
       p AS total_population, p AS sampled_population, round(CAST(e AS DOUBLE) / p * 100, 2) AS exception_rate_percent,
       CAST(i % 100 AS DOUBLE) AS materiality_threshold_percent, CAST(0 AS BIGINT) AS group_population,
       CAST(NULL AS DOUBLE) AS group_exception_rate_percent
FROM counted""",
    )


def batch_exceptions(spark, sf_dir):
    """All exceptions of the batch from one pass, summed up per control."""
    found = exception_rows(batch_controls(), tables(spark, sf_dir, "lineitem", "orders"))
    return found.groupBy("control_id").agg(
        F.count(F.lit(1)).alias("exception_count"),
        F.sum("l_orderkey").alias("key_sum"),
        F.max(F.array_join("failed_assertions", ",")).alias("failed_assertions"),
    )


BATCH_EXCEPTIONS_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{control_id}' AS control_id, count(*) AS exception_count, CAST(sum(l_orderkey) AS BIGINT) AS key_sum,
       'r1' AS failed_assertions
FROM {ITEMS} WHERE {where} AND ({ok}) IS NOT TRUE HAVING count(*) > 0"""
    for control_id, _, _, where, ok, _ in BATCH
)


def recorded_batch(spark, sf_dir):
    """Run the batch with its sinks and read back what the ledger holds."""
    catalog = tables(spark, sf_dir)
    for name in ("lineitem", "orders"):
        digest = dataset_hash(spark, f"{sf_dir}/{name}.parquet").first()["sha256_hash"]
        catalog.add(name, table(spark, sf_dir, name), sha256_hash=digest)
    ledger = Ledger(spark, fresh_folder(spark, "ledger"))
    ledger.append_controls(batch_controls(), "auditor", RUN_AT)
    run_controls(spark, batch_controls(), catalog, ledger, fresh_folder(spark, "exceptions"), executed_at=RUN_AT)
    current = current_controls(ledger.controls()).select("control_id", "version", "approved_by")
    return ledger.executions().join(current, "control_id").select(
        "control_id",
        "verdict",
        "exception_count",
        "total_population",
        "executed_at",
        "version",
        "approved_by",
        F.size("evidence_hashes").cast("long").alias("evidence_count"),
        F.coalesce(F.json_array_length("exceptions_sample"), F.lit(0)).cast("long").alias("sampled_exceptions"),
    )


def mixed_batch():
    """A batch in which single controls cannot run: they must not stop the others."""
    good = batch_controls()
    unreadable = control(
        "orders", [], [match("o_orderpriority", "eq", 5, ignore_case_and_space=False)], control_id="CTRL-UNREADABLE"
    )
    unbound = control("orders", [], [match("no_such_column", "eq", "x")], control_id="CTRL-UNBOUND")
    unfed = control("payroll", [], [match("salary", "gt", 0)], control_id="CTRL-UNFED")
    return good + [unreadable, unbound, unfed]


def control_error(spark, sf_dir):
    found = run_controls(spark, mixed_batch(), tables(spark, sf_dir, "lineitem", "orders"))
    return found.select(*REPORT_COLUMNS)


def failed_sql(control_id: str, verdict: str) -> str:
    nulls = ", ".join(
        f"CAST(NULL AS {t}) AS {c}"
        for c, t in (
            ("exception_count", "BIGINT"),
            ("total_population", "BIGINT"),
            ("sampled_population", "BIGINT"),
            ("exception_rate_percent", "DOUBLE"),
        )
    )
    return f"""SELECT '{control_id}' AS control_id, '{verdict}' AS verdict, {nulls},
  CAST(0 AS DOUBLE) AS materiality_threshold_percent, CAST(NULL AS BIGINT) AS group_population,
  CAST(NULL AS DOUBLE) AS group_exception_rate_percent"""


MIXED_SQL = "\nUNION ALL\n".join(
    [
        BATCH_SQL,
        failed_sql("CTRL-UNREADABLE", "ERROR"),
        failed_sql("CTRL-UNBOUND", "ERROR"),
        failed_sql("CTRL-UNFED", "SKIPPED"),
    ]
)


def summary(spark, sf_dir):
    results = control_error(spark, sf_dir)
    return batch_summary(results, F.col("control_id").isin("CTRL-01", "CTRL-02", "CTRL-UNFED"))


def preflight(spark, sf_dir):
    """Do the controls bind, does the evidence have the declared columns, how many rows has it."""
    bound = [
        ("orders", "o_orderkey", "numeric"),
        ("orders", "o_orderdate", "timestamp"),
        ("lineitem", "l_shipdate", "numeric"),
        ("customer", "c_mktsegment", "string"),
        ("customer", "c_riskrating", "string"),
    ]
    bindings = [
        {"business_term": f, "dataset_alias": a, "technical_field": f, "data_type": t} for a, f, t in bound
    ]
    catalog = tables(spark, sf_dir, "orders", "lineitem", "customer")
    drift = schema_drift(spark, control("orders", bindings=bindings), catalog)
    binds = {
        "orders": match("o_orderstatus", "eq", "F"),
        "lineitem": match("l_returnflag", "gt", 3),
        "customer": match("c_riskrating", "eq", "LOW"),
    }
    lines = []
    for alias, rule_ in binds.items():
        valid, _ = dry_run(control(alias, [], [rule_]), catalog)
        lines.append(catalog.frame(alias).agg(F.count(F.lit(1)).alias("row_count"))
                     .select(F.lit(alias).alias("dataset_alias"), F.lit(valid).alias("binds"), "row_count"))
    counted = lines[0].unionByName(lines[1]).unionByName(lines[2])
    return drift.join(counted, "dataset_alias").select(
        "dataset_alias",
        "status",
        F.array_join("missing_columns", ",").alias("missing_columns"),
        F.array_join("mistyped_columns", ",").alias("mistyped_columns"),
        "binds",
        "row_count",
    )


QUERIES = {
    "control_report_pass": one_report(
        "CTRL-PASS", ("lineitem", "orders"), "lineitem", [WITH_ORDER, keep("l_quantity", "gte", 10)],
        [match("l_discount", "lte", 0.09, threshold=12.5)],
        f"{ITEMS} WHERE l_quantity >= 10", "l_discount <= 0.09", 12.5,
    ),
    "control_report_fail": one_report(
        "CTRL-FAIL", ("orders", "customer"), "orders",
        [("cust", join("customer", "o_custkey", "c_custkey")), keep("o_totalprice", "gt", 100000)],
        [match("c_mktsegment", "in", ["BUILDING", "MACHINERY"]), match("c_acctbal", "gt", 0, "r2", threshold=1.0)],
        "orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000",
        "coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), FALSE) AND coalesce(c_acctbal > 0, FALSE)", 1.0,
    ),
    "control_report_zero_population": one_report(
        "CTRL-ZERO", ("orders",), "orders", [keep("o_totalprice", "lt", 0)],
        [match("o_orderstatus", "eq", "F")], "orders WHERE o_totalprice < 0", "o_orderstatus = 'F'",
    ),
    "control_report_groups": Query(
        lambda spark, sf_dir: verdicts(
            [
                control(
                    "lineitem",
                    [keep("l_returnflag", "eq", "R"), computed("ship_day", "to_date(l_shipdate)")],
                    [limit("SUM", ["l_suppkey", "ship_day"], "l_extendedprice", "lte", 150000.0)],
                    control_id="CTRL-GROUPS",
                )
            ],
            tables(spark, sf_dir, "lineitem"),
        ),
        report_sql(
            "CTRL-GROUPS",
            group_counts_sql(
                "lineitem WHERE l_returnflag = 'R'",
                "l_suppkey, CAST(l_shipdate AS DATE)",
                "sum(l_extendedprice) <= 150000.0",
            ),
        ),
    ),
    "batch_shared_scan": Query(shared_scan, BATCH_SQL),
    "batch_100_controls": generated_report(100),
    "batch_1000_controls": generated_report(1000),
    "batch_exceptions": Query(batch_exceptions, BATCH_EXCEPTIONS_SQL),
    "batch_recorded": Query(
        recorded_batch,
        f"""
SELECT control_id, verdict, exception_count, total_population, TIMESTAMP '{RUN_AT}' AS executed_at,
       '1.0' AS version, 'auditor' AS approved_by,
       CAST(2 AS BIGINT) AS evidence_count, CAST(least(100, exception_count) AS BIGINT) AS sampled_exceptions
FROM ({BATCH_SQL})""",
    ),
    "control_error": Query(control_error, MIXED_SQL),
    "batch_summary": Query(
        summary,
        f"""
SELECT count(*) AS total_projects, count(*) FILTER (WHERE verdict = 'PASS') AS pass_count,
       count(*) FILTER (WHERE verdict = 'FAIL') AS fail_count,
       count(*) FILTER (WHERE verdict = 'ERROR') AS error_count,
       count(*) FILTER (WHERE verdict = 'SKIPPED') AS skipped_count,
       count(*) FILTER (WHERE control_id IN ('CTRL-01', 'CTRL-02') AND verdict IN ('PASS', 'FAIL')) AS cached_dsl_count,
       count(*) - count(*) FILTER (WHERE control_id IN ('CTRL-01', 'CTRL-02') AND verdict IN ('PASS', 'FAIL'))
         - count(*) FILTER (WHERE verdict IN ('ERROR', 'SKIPPED')) AS generated_dsl_count
FROM ({MIXED_SQL})""",
    ),
    "preflight": Query(
        preflight,
        """
SELECT 'orders' AS dataset_alias, 'VALID' AS status, '' AS missing_columns, '' AS mistyped_columns,
       TRUE AS binds, count(*) AS row_count FROM orders
UNION ALL SELECT 'lineitem', 'TYPE_DRIFT_DETECTED', '', 'l_shipdate', FALSE, count(*) FROM lineitem
UNION ALL SELECT 'customer', 'SCHEMA_DRIFT_DETECTED', 'c_riskrating', '', FALSE, count(*) FROM customer""",
    ),
}
