"""Ledger analytics over a run history derived from the event stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from controlweave.sources.ledger import current_controls, dashboard_stats, evidence_lineage, execution_history
from controlweave.workload.common import Query, table, tables

AS_OF = datetime(2024, 2, 5)


def executions(spark, sf_dir):
    """Every event as the run of a control."""
    tables(spark, sf_dir)
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("EX-"), F.col("event_id").cast("string")).alias("execution_id"),
        F.concat(F.lit("CTRL-"), (F.col("user_id") % 20).cast("string")).alias("control_id"),
        F.when(kind == "error", "ERROR").when(kind == "purchase", "FAIL").otherwise("PASS").alias("verdict"),
        F.floor("value").alias("exception_count"),
        (F.col("user_id") + 1000).alias("total_population"),
        F.col("value").alias("exception_rate_percent"),
        F.col("ts").alias("executed_at"),
        F.create_map(
            F.concat(F.lit("feed_"), (F.col("user_id") % 4).cast("string")),
            F.md5((F.col("user_id") % 3).cast("string")),
            F.lit("feed_shared"),
            F.md5(kind),
        ).alias("evidence_hashes"),
    )


EXECUTIONS_SQL = """
SELECT 'EX-' || event_id AS execution_id, 'CTRL-' || (user_id % 20) AS control_id,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'FAIL' ELSE 'PASS' END AS verdict,
       CAST(floor(value) AS BIGINT) AS exception_count, user_id + 1000 AS total_population,
       value AS exception_rate_percent, ts AS executed_at, user_id, event_type
FROM events"""


def manifests(spark, sf_dir):
    """Every document as one landing of a feed; feeds land many times."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.when(n % 5 == 4, "feed_shared").otherwise(F.concat(F.lit("feed_"), (n % 5).cast("string"))).alias("dataset_alias"),
        F.when(n % 5 == 4, F.md5(F.lit("click"))).otherwise(F.md5((n % 3).cast("string"))).alias("sha256_hash"),
        F.timestamp_add("SECOND", n, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ingested_at"),
    )


MANIFESTS_SQL = """
SELECT CASE WHEN doc_id % 5 = 4 THEN 'feed_shared' ELSE 'feed_' || (doc_id % 5) END AS dataset_alias,
       CASE WHEN doc_id % 5 = 4 THEN md5('click') ELSE md5(CAST(doc_id % 3 AS VARCHAR)) END AS stored_hash,
       doc_id AS landed
FROM documents"""

LINES_SQL = f"""
SELECT execution_id, control_id, verdict, executed_at, 'feed_' || (user_id % 4) AS dataset_alias,
       md5(CAST(user_id % 3 AS VARCHAR)) AS execution_hash FROM ({EXECUTIONS_SQL})
UNION ALL
SELECT execution_id, control_id, verdict, executed_at, 'feed_shared', md5(event_type) FROM ({EXECUTIONS_SQL})"""

STATUS = "CASE WHEN stored_hash = execution_hash THEN 'VALID' ELSE 'TAMPERED' END AS integrity_status"


def control_versions(spark, sf_dir):
    """Every event as an approval of a control version."""
    tables(spark, sf_dir)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("CTRL-"), (F.col("user_id") % 40).cast("string")).alias("control_id"),
        F.col("props").alias("control_json"),
        F.col("event_id").cast("string").alias("version"),
        F.col("event_type").alias("approved_by"),
        F.col("ts").alias("approved_at"),
    )


def lineage(**options):
    return lambda spark, sf_dir: evidence_lineage(executions(spark, sf_dir), manifests(spark, sf_dir), **options)


QUERIES = {
    "execution_history": Query(
        lambda spark, sf_dir: execution_history(executions(spark, sf_dir), "CTRL-7"),
        f"""
SELECT execution_id, control_id, verdict, exception_count, total_population, exception_rate_percent, executed_at
FROM ({EXECUTIONS_SQL}) WHERE control_id = 'CTRL-7' ORDER BY executed_at DESC, execution_id LIMIT 100""",
    ),
    "evidence_lineage": Query(
        lineage(limit=100),  # the report of the newest lines; evidence_lineage_latest lists every run
        f"""
SELECT execution_id, control_id, verdict, executed_at, dataset_alias, stored_hash, execution_hash, {STATUS}
FROM ({LINES_SQL}) JOIN ({MANIFESTS_SQL}) USING (dataset_alias)
ORDER BY executed_at DESC, execution_id, dataset_alias, landed, stored_hash LIMIT 100""",
    ),
    "evidence_lineage_one": Query(
        lineage(execution_id="EX-77"),
        f"""
SELECT execution_id, control_id, verdict, executed_at, dataset_alias, stored_hash, execution_hash, {STATUS}
FROM ({LINES_SQL}) JOIN ({MANIFESTS_SQL}) USING (dataset_alias) WHERE execution_id = 'EX-77'""",
    ),
    "evidence_lineage_latest": Query(
        lineage(latest_only=True),
        f"""
SELECT execution_id, control_id, verdict, executed_at, dataset_alias, stored_hash, execution_hash, {STATUS}
FROM ({LINES_SQL}) JOIN (
  SELECT dataset_alias, arg_max(stored_hash, landed) AS stored_hash FROM ({MANIFESTS_SQL}) GROUP BY dataset_alias)
USING (dataset_alias)""",
    ),
    "dashboard_stats": Query(
        lambda spark, sf_dir: dashboard_stats(executions(spark, sf_dir), control_versions(spark, sf_dir), AS_OF),
        f"""
SELECT (SELECT count(DISTINCT user_id % 40) FROM events) AS total_controls,
       count(*) FILTER (WHERE verdict = 'PASS') AS pass_count, count(*) FILTER (WHERE verdict = 'FAIL') AS fail_count,
       count(*) FILTER (WHERE verdict = 'ERROR') AS error_count,
       coalesce(round(avg(exception_rate_percent) FILTER (WHERE verdict IN ('PASS', 'FAIL')), 2), 0) AS avg_exception_rate
FROM ({EXECUTIONS_SQL}) WHERE executed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""",
    ),
    "current_control": Query(
        lambda spark, sf_dir: current_controls(control_versions(spark, sf_dir)),
        """
SELECT * EXCLUDE (rn) FROM (
  SELECT 'CTRL-' || (user_id % 40) AS control_id, props AS control_json, CAST(event_id AS VARCHAR) AS version,
         event_type AS approved_by, ts AS approved_at,
         row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS rn
  FROM events) WHERE rn = 1""",
    ),
}
