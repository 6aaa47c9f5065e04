"""Continuous controls over the event table, read as a file stream until it is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from controlweave.session import fresh_folder
from controlweave.sources.ledger import Ledger
from controlweave.streaming.continuous import (
    GroupStates,
    file_stream,
    missed_follow_ups,
    row_exception_stream,
    start_group_verdicts,
    start_sink,
    start_verdicts,
    windowed_failing_groups,
)
from controlweave.workload.common import Query, control, join, keep, match, table, tables
from controlweave.workload.grouped import limit

ROW_CONTROL = control(
    "events",
    [("cust", join("customer", "user_id", "c_custkey")), keep("event_type", "neq", "view")],
    [match("value", "lte", 150, "value_limit"), match("c_mktsegment", "neq", "BUILDING", "segment")],
)
GROUP_CONTROL = control(
    "events", [keep("event_type", "neq", "signup")], [limit("SUM", ["event_type"], "value", "lte", 3200.0)]
)


def streamed(spark, sf_dir, *static):
    catalog = tables(spark, sf_dir, *static)
    return catalog.add("events", file_stream(spark, f"{sf_dir}/events.parquet"))


def drained(spark, stream):
    """Run the stream over what there is and return what it wrote."""
    out, checkpoint = fresh_folder(spark, "stream-out"), fresh_folder(spark, "stream-state")
    start_sink(stream, out, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def row_control(spark, sf_dir):
    return drained(spark, row_exception_stream(ROW_CONTROL, streamed(spark, sf_dir, "customer")))


def window_control(spark, sf_dir):
    rule = GROUP_CONTROL.group_assertions[0]
    stream = windowed_failing_groups(GROUP_CONTROL, rule, streamed(spark, sf_dir), "ts", "1 day", "2 hours")
    found = drained(spark, stream)
    return found.selectExpr(
        "window_start", "window_end", "event_type", "exception_count", "round(metric_value, 2) AS metric_value"
    )


VERDICT_CONTROL = control(
    "events", [keep("event_type", "eq", "purchase")], [match("value", "lte", 150, threshold=2.0)], control_id="CTRL-LIVE"
)


def micro_batch_verdicts(spark, sf_dir):
    """Every micro-batch judged as it arrives; the verdicts as the ledger holds them.

    The events arrive in four files, one per micro-batch.
    """
    catalog = tables(spark, sf_dir)
    arrived = fresh_folder(spark, "arrived")
    table(spark, sf_dir, "events").repartition(4, "event_id").write.parquet(arrived)
    catalog.add("events", file_stream(spark, arrived, files_per_trigger=1))
    ledger = Ledger(spark, fresh_folder(spark, "ledger"))
    start_verdicts(VERDICT_CONTROL, catalog, ledger, fresh_folder(spark, "stream-state")).awaitTermination()
    return ledger.executions().groupBy("control_id").agg(
        F.sum("exception_count").alias("exception_count"),
        F.sum("total_population").alias("total_population"),
        F.count("*").alias("micro_batches"),
    )


LIVE_GROUPS = control(
    "events",
    [keep("event_type", "neq", "signup")],
    [limit("SUM", ["user_id", "event_type"], "value", "lte", 60.0), match("value", "lte", 150, "value_limit", threshold=5.0),
     limit("COUNT", ["event_type", "user_id"], "event_id", "lt", 3, "g2")],
    control_id="CTRL-GROUPS-LIVE",
)


def arrived_in_order(spark, sf_dir, parts=4):
    """The events as files of consecutive time spans, one written after the other."""
    events = table(spark, sf_dir, "events")
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(moment), F.max(moment)).first()
    arrived = fresh_folder(spark, "arrived")
    span = F.least(F.floor((moment - first) * parts / (last - first + 1)), F.lit(parts - 1))
    for k in range(parts):
        events.filter(span == k).coalesce(1).write.mode("append").parquet(arrived)
    return arrived


def live_groups(spark, sf_dir):
    """Group rules over four micro-batches, the last of them replayed."""
    catalog = tables(spark, sf_dir)
    arrived = arrived_in_order(spark, sf_dir)
    ledger = Ledger(spark, fresh_folder(spark, "ledger"))
    states, checkpoint = GroupStates(spark, fresh_folder(spark, "group-states"), compact_every=2), fresh_folder(spark, "stream-state")
    catalog.add("events", file_stream(spark, arrived, files_per_trigger=1))
    start_group_verdicts(LIVE_GROUPS, catalog, ledger, states, checkpoint).awaitTermination()
    return ledger, states


def group_verdict(spark, sf_dir):
    """The verdict after the last micro-batch, and how many there were."""
    ledger, _ = live_groups(spark, sf_dir)
    found = ledger.executions()
    newest = F.max_by(F.struct("verdict", "exception_count", "total_population", "exception_rate_percent"), F.col("total_population")).alias("v")
    return found.groupBy("control_id").agg(F.count("*").alias("micro_batches"), newest).select("control_id", "micro_batches", "v.*")


def live_failing_groups(spark, sf_dir):
    """The groups that fail when all rows have arrived, from the states."""
    _, states = live_groups(spark, sf_dir)
    now = states.current(3)
    return now.filter(F.array_contains("failing", True)).select(
        F.col("key_user_id").alias("user_id"), F.col("key_event_type").alias("event_type"), "rows", F.round("metric_0", 2).alias("total"),
        F.col("failing")[0].alias("total_fails"), F.col("failing")[1].alias("count_fails"),
    )


FOLLOW_UP = control("events", [keep("event_type", "eq", "signup"), ("buy", join("purchases", "user_id", "user_id"))])


def late_deadlines(spark, sf_dir):
    """Signups without a purchase by the same user within three days; both arrive as streams."""
    catalog = tables(spark, sf_dir)
    arrived = arrived_in_order(spark, sf_dir)
    catalog.add("events", file_stream(spark, arrived, files_per_trigger=1))
    catalog.add("purchases", file_stream(spark, arrived, files_per_trigger=1).filter("event_type = 'purchase'"))
    return drained(spark, missed_follow_ups(FOLLOW_UP, catalog, "ts", "ts", "3 DAYS", "2 hours"))


QUERIES = {
    "stream_group_verdict": Query(
        group_verdict,
        """
WITH groups AS (
    SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE (value <= 150) IS NOT TRUE) AS e,
           (sum(value) <= 60) IS NOT TRUE AS f, (count(event_id) < 3) IS NOT TRUE AS g
    FROM events WHERE event_type <> 'signup' GROUP BY user_id, event_type
), counted AS (SELECT sum(n) AS p, sum(e) + count(*) FILTER (WHERE f) + count(*) FILTER (WHERE g) AS e FROM groups)
SELECT 'CTRL-GROUPS-LIVE' AS control_id, CAST(4 AS BIGINT) AS micro_batches,
       CASE WHEN CAST(e AS DOUBLE) / p * 100 <= 5 THEN 'PASS' ELSE 'FAIL' END AS verdict, CAST(e AS BIGINT) AS exception_count,
       CAST(p AS BIGINT) AS total_population, round(CAST(e AS DOUBLE) / p * 100, 2) AS exception_rate_percent
FROM counted""",
    ),
    "stream_group_states": Query(
        live_failing_groups,
        """
SELECT user_id, event_type, count(*) AS rows, round(sum(value), 2) AS total, (sum(value) <= 60) IS NOT TRUE AS total_fails,
       (count(event_id) < 3) IS NOT TRUE AS count_fails
FROM events WHERE event_type <> 'signup' GROUP BY user_id, event_type
HAVING (sum(value) <= 60) IS NOT TRUE OR (count(event_id) < 3) IS NOT TRUE""",
    ),
    # only deadlines that both watermarks have passed are certain
    "stream_deadlines": Query(
        late_deadlines,
        """
SELECT * FROM events s WHERE event_type = 'signup'
  AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = s.user_id AND b.ts >= s.ts AND b.ts <= s.ts + INTERVAL 3 DAY)
  AND ts + INTERVAL 3 DAY < (SELECT least(max(ts) FILTER (WHERE event_type = 'signup'), max(ts) FILTER (WHERE event_type = 'purchase')) FROM events) - INTERVAL 2 HOUR""",
    ),
    "stream_row_control": Query(
        row_control,
        """
SELECT e.*, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment, c.c_custkey AS cust_c_custkey
FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
WHERE e.event_type <> 'view'
  AND ((e.value <= 150) IS NOT TRUE OR (trim(upper(c.c_mktsegment)) <> 'BUILDING') IS NOT TRUE)""",
    ),
    "stream_verdicts": Query(
        micro_batch_verdicts,
        """
SELECT 'CTRL-LIVE' AS control_id, count(*) FILTER (WHERE (value <= 150) IS NOT TRUE) AS exception_count,
       count(*) AS total_population, CAST(4 AS BIGINT) AS micro_batches FROM events WHERE event_type = 'purchase'""",
    ),
    # only windows the watermark has closed are final
    "stream_window_control": Query(
        window_control,
        """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end,
       event_type, count(*) AS exception_count, round(sum(value), 2) AS metric_value
FROM events WHERE event_type <> 'signup'
GROUP BY ALL
HAVING (sum(value) <= 3200) IS NOT TRUE
   AND date_trunc('day', min(ts))::TIMESTAMP + INTERVAL 1 DAY
       <= (SELECT max(ts) FROM events WHERE event_type <> 'signup') - INTERVAL 2 HOUR""",
    ),
}
