"""Ten business controls as whole runs, on tables that play the parts of their evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from controlweave.workload.common import (
    Query,
    control,
    group_counts_sql,
    join,
    keep,
    keep_in,
    keep_null,
    match,
    report_sql,
    row_counts_sql,
    rule,
    table,
    tables,
    verdicts,
)
from controlweave.workload.grouped import limit

ORDER_OF_ITEM = ("ord", join("orders", "l_orderkey", "o_orderkey"))
ITEMS = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"


def day_limit(base: str, op: str, target: str, days: int, assertion_id: str = "deadline") -> dict:
    return rule(
        "temporal_date_math", assertion_id,
        base_date_field=base, operator=op, target_date_field=target, offset_days=days,
    )


def business(control_id, names, base, steps, rules, counts, derived=None) -> Query:
    spec = control(base, steps, rules, control_id=control_id)
    threshold = spec.threshold

    def run(spark, sf_dir):
        catalog = tables(spark, sf_dir, *names)
        for alias, build in (derived or {}).items():
            catalog.add(alias, build(spark, sf_dir), unique=UNIQUE.get(alias, ()))
        return verdicts([spec], catalog)

    return Query(run, report_sql(control_id, counts, threshold))


def watch_list(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") < 500).select("s_suppkey", "s_name")


def wall_register(spark, sf_dir):
    """Part and supplier pairs under restriction, with the day they were cleared."""
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_discount") >= 0.08)
        .groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
        .agg(F.max("l_linestatus").alias("restriction_status"), F.min("l_shipdate").alias("clearance_date"))
    )


WALL = """(SELECT l_partkey AS part, l_suppkey AS supplier, max(l_linestatus) AS restriction_status,
  min(l_shipdate) AS clearance_date FROM lineitem WHERE l_discount >= 0.08 GROUP BY ALL)"""


def roster(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0).select("c_custkey", "c_mktsegment")


def reviews(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.filter(F.col("l_returnflag") != "A").select(
        "l_suppkey", "l_linestatus", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"
    )


UNIQUE = {"register": ("part", "supplier"), "watch_list": ("s_suppkey",), "roster": ("c_custkey",)}

LATEST_ORDER = """(SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus,
  max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey)"""

LATEST_REVIEW = """(SELECT * FROM (SELECT l_suppkey, l_linestatus, l_shipdate, row_number() OVER (
    PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn
  FROM lineitem WHERE l_returnflag <> 'A') WHERE rn = 1)"""

QUERIES = {
    # screening against a watch list, and due diligence in time
    "business_due_diligence": business(
        "CTRL-AML", ("lineitem", "orders"), "lineitem",
        [keep("l_returnflag", "eq", "R"), ORDER_OF_ITEM, ("watch", join("watch_list", "l_suppkey", "s_suppkey"))],
        [match("watch_s_suppkey", "eq", None, "not_listed"),
         match("ord_o_orderkey", "neq", None, "reviewed"),
         day_limit("l_shipdate", "lte", "o_orderdate", 14)],
        row_counts_sql(
            f"{ITEMS} LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal < 500) s ON l_suppkey = s_suppkey "
            "WHERE l_returnflag = 'R'",
            "s_suppkey IS NULL AND o_orderkey IS NOT NULL "
            "AND coalesce(CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) + INTERVAL 14 DAY, FALSE)",
        ),
        {"watch_list": watch_list},
    ),
    # trades in restricted names only after clearance
    "business_restricted_trading": business(
        "CTRL-MNPI", ("lineitem",), "lineitem",
        [("wall", join("register", ["l_partkey", "l_suppkey"], ["part", "supplier"])),
         keep_null("wall_part", False)],
        [match("register.restriction_status", "eq", "f", "cleared"),
         rule("column_comparison", "cool_off", left_field="l_shipdate", operator="gt", right_field="clearance_date")],
        row_counts_sql(
            f"lineitem LEFT JOIN {WALL} w ON l_partkey = w.part AND l_suppkey = w.supplier WHERE w.part IS NOT NULL",
            "restriction_status = 'F' AND l_shipdate > clearance_date",
        ),
        {"register": wall_register},
    ),
    # no active account of a leaver or of an unknown person
    "business_ghost_accounts": business(
        "CTRL-ITGC", ("orders",), "orders",
        [("hr", join("roster", "o_custkey", "c_custkey")), keep("o_orderstatus", "eq", "O")],
        [match("c_mktsegment", "neq", "BUILDING", "not_terminated"), match("c_mktsegment", "neq", None, "known")],
        row_counts_sql(
            "orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey "
            "WHERE o_orderstatus = 'O'",
            "c_mktsegment <> 'BUILDING' AND c_mktsegment IS NOT NULL",
        ),
        {"roster": roster},
    ),
    # settled within two days
    "business_settlement": business(
        "CTRL-OPS-T2", ("lineitem", "orders"), "lineitem",
        [ORDER_OF_ITEM, keep("l_linestatus", "eq", "F")],
        [{**day_limit("l_shipdate", "lte", "o_orderdate", 2), "materiality_threshold_percent": 60.0}],
        row_counts_sql(
            f"{ITEMS} WHERE l_linestatus = 'F'",
            "CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) + INTERVAL 2 DAY",
        ),
    ),
    # large invoices approved by those allowed to
    "business_invoice_authority": business(
        "CTRL-SOX-AP", ("orders", "customer"), "orders",
        [keep("o_totalprice", "gt", 100000), ("title", join("customer", "o_custkey", "c_custkey"))],
        [match("c_mktsegment", "in", ["BUILDING", "MACHINERY", "FURNITURE"], threshold=30.0)],
        row_counts_sql(
            "orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000",
            "c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')",
        ),
    ),
    # buyer and seller differ
    "business_wash_trades": business(
        "CTRL-WASH", ("lineitem",), "lineitem",
        [keep("l_linestatus", "eq", "F")],
        [rule("column_comparison", left_field="l_partkey", operator="neq", right_field="l_suppkey")],
        row_counts_sql("lineitem WHERE l_linestatus = 'F'", "l_partkey <> l_suppkey"),
    ),
    # enough client money every day
    "business_client_money": business(
        "CTRL-CASS", ("orders",), "orders",
        [keep("o_orderstatus", "eq", "F")],
        [limit("SUM", ["o_orderdate"], "o_totalprice", "gte", 300000.0)],
        group_counts_sql("orders WHERE o_orderstatus = 'F'", "o_orderdate", "sum(o_totalprice) >= 300000.0"),
    ),
    # leavers: ticket closed in time and account gone
    "business_leaver_access": business(
        "CTRL-IAM", ("customer", "orders", "supplier"), "customer",
        [keep_in("c_mktsegment", "BUILDING", "MACHINERY"),
         ("ticket", join("orders", "c_custkey", "o_custkey", latest_by=["o_orderdate", "o_orderkey"])),
         ("account", join("supplier", "c_custkey", "s_suppkey"))],
        [match("o_orderstatus", "eq", "F", "closed"),
         match("o_orderdate", "gte", "2001-01-01", "recent", ignore_case_and_space=False),
         match("account_s_suppkey", "eq", None, "account_gone")],
        row_counts_sql(
            f"customer LEFT JOIN {LATEST_ORDER} o ON c_custkey = o_custkey LEFT JOIN supplier ON c_custkey = s_suppkey "
            "WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
            "coalesce(o_orderstatus = 'F', FALSE) AND coalesce(o_orderdate >= TIMESTAMP '2001-01-01', FALSE) "
            "AND s_suppkey IS NULL",
        ),
    ),
    # vendors: newest review passed and outlasting the contract
    "business_vendor_reviews": business(
        "CTRL-VRM", ("supplier", "nation"), "supplier",
        [keep("s_acctbal", "gt", 0), ("nat", join("nation", "s_nationkey", "n_nationkey")),
         keep_in("n_regionkey", 0, 1, 2),
         ("review", join("reviews", "s_suppkey", "l_suppkey",
                         latest_by=["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]))],
        [match("l_linestatus", "eq", "F", "passed", threshold=40.0),
         match("l_shipdate", "gt", "2001-06-01", "not_expired", ignore_case_and_space=False)],
        row_counts_sql(
            f"supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN {LATEST_REVIEW} r ON s_suppkey = r.l_suppkey "
            "WHERE s_acctbal > 0 AND n_regionkey IN (0, 1, 2)",
            "coalesce(l_linestatus = 'F', FALSE) AND coalesce(l_shipdate > TIMESTAMP '2001-06-01', FALSE)",
        ),
        {"reviews": reviews},
    ),
    # mismatches raised and resolved in time; nothing recorded is an exception too
    "business_letter_mismatch": business(
        "CTRL-ECOA", ("documents", "labels"), "documents",
        [keep("lang", "eq", "en"), ("lab", join("labels", "doc_id", "doc_id"))],
        [match("toxic", "eq", 0, "raised"), match("quality", "gte", 1, "resolved", threshold=50.0)],
        row_counts_sql(
            "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'en'",
            "coalesce(toxic = 0, FALSE) AND coalesce(quality >= 1, FALSE)",
        ),
    ),
}
