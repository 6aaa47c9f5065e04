"""Continuous controls: the batch rules on Structured Streaming.

A catalog whose base dataset is a stream gives a streaming population; joined
datasets stay static. Row rules emit exceptions as rows arrive. Group rules are
judged per event-time window once the watermark has passed its end, or over
everything so far, with the state of each group kept across micro-batches. A
follow-up that arrives on a stream of its own is awaited until its deadline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from controlweave.functions.conditions import all_of, any_of, is_exception, quoted
from controlweave.operators.groups import fails, grain, metric, total
from controlweave.operators.names import Lineage
from controlweave.operators.population import build_population, population_filters
from controlweave.operators.rules import compliant, row_exceptions, with_references
from controlweave.plans.metrics import METRICS
from controlweave.plans.run import joined_samples, judged, run_controls
from controlweave.plans.spec import FILTERS, Control, GroupLimit, JoinLeft, SpecError
from controlweave.sources.catalog import Catalog
from controlweave.sources.ledger import execution_id, now


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder or a single file as a stream, with the schema it has now.

    A file source takes its path for a folder unless it is a pattern, hence the
    pattern that matches exactly this name.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{{{name}}}")


def row_exception_stream(control: Control, catalog: Catalog, lenient: bool = False) -> DataFrame:
    """Arriving population rows that break a row rule."""
    return row_exceptions(build_population(control, catalog, lenient), control.row_assertions, catalog, lenient)


def windowed_failing_groups(
    control: Control,
    rule: GroupLimit,
    catalog: Catalog,
    event_time: str,
    window: str,
    delay: str,
    slide: str | None = None,
    lenient: bool = False,
) -> DataFrame:
    """Groups per event-time window that break ``rule``, one row when a window closes."""
    joined = build_population(control, catalog, lenient)
    lineage = joined.lineage
    timed = joined.frame.withColumn("_event_time", lineage.column(event_time).cast("timestamp"))
    keys = [lineage.column(k).alias(k) for k in grain(rule, lineage)]
    return (
        timed.withWatermark("_event_time", delay)
        .groupBy(F.window("_event_time", window, slide).alias("_window"), *keys)
        .agg(
            F.count(F.lit(1)).alias("exception_count"),
            metric(rule, lineage).alias("metric_value"),
            total(rule, lineage).alias("total_amount"),
        )
        .filter(fails(rule, F.col("metric_value")))
        .select(
            F.col("_window.start").cast("timestamp_ntz").alias("window_start"),
            F.col("_window.end").cast("timestamp_ntz").alias("window_end"),
            *[F.col(k) for k in grain(rule, lineage)],
            "exception_count",
            "metric_value",
            "total_amount",
        )
    )


def start_sink(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, every: str = "1 minute"
) -> StreamingQuery:
    """Append a stream of exceptions to Parquet, exactly once per micro-batch."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()


def start_verdicts(
    control: Control, catalog: Catalog, ledger, checkpoint: str, available_now: bool = True, every: str = "1 minute"
) -> StreamingQuery:
    """Judge every micro-batch as a population of its own and record the verdict.

    A group may span micro-batches, so group rules are refused here; use
    :func:`windowed_failing_groups` or :func:`start_group_verdicts`. A micro-batch that is replayed is recorded once.
    """
    if control.group_assertions:
        raise SpecError("a group rule cannot be judged by micro-batches alone; use windowed_failing_groups or start_group_verdicts")
    stream = catalog.frame(control.base_dataset)

    def judge(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{checkpoint}#{batch_id}"
        known = F.col("execution_id") == execution_id(run_id, control.control_id)
        if ledger.executions().filter(known).isEmpty():
            datasets = catalog.with_frame(control.base_dataset, batch)
            run_controls(batch.sparkSession, [control], datasets, ledger=ledger, run_id=run_id)

    writer = stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()


# --- group rules over everything so far -----------------------------------------------

#: After so many micro-batches the groups' states are written anew as one table.
COMPACT_EVERY = 20


class GroupStates:
    """What a stream of group rules knows of each group, under one folder.

    ``kind=change`` holds, per micro-batch, the groups it touched with their values up to then;
    ``kind=state`` all groups, every ``compact_every`` micro-batches. Each is written whole under the
    number of its micro-batch, so a replay writes the same again.
    """

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every

    def record(self, changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{self.folder}/kind=change/micro_batch={number}")
        if number and number % self.compact_every == 0:
            self.current(number, compacted=False).write.mode("overwrite").parquet(f"{self.folder}/kind=state/micro_batch={number}")

    def current(self, number: int, compacted: bool = True) -> DataFrame:
        """The newest values of every group after a micro-batch, one narrow row per group."""
        last = (number if compacted else number - 1) // self.compact_every * self.compact_every
        parts = [f"{self.folder}/kind=change/micro_batch={n}" for n in range(last + 1 if last else 0, number + 1)]
        if last:
            parts.insert(0, f"{self.folder}/kind=state/micro_batch={last}")
        frames = self.spark.read.option("basePath", self.folder).parquet(*parts)
        keys = [c for c in frames.columns if c.startswith("key_")]
        rest = [c for c in frames.columns if c not in keys and c not in ("kind", "micro_batch")]
        newest = F.max_by(F.struct(*rest), F.col("micro_batch")).alias("newest")
        return frames.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def start_group_verdicts(
    control: Control,
    catalog: Catalog,
    ledger,
    states: GroupStates,
    checkpoint: str,
    available_now: bool = True,
    every: str = "1 minute",
    lenient: bool = False,
) -> StreamingQuery:
    """Judge a control with group rules over all rows that have arrived, after every micro-batch.

    Spark keeps the partial aggregates of each group as state, combined per task before the shuffle,
    and gives the groups a micro-batch has changed; their verdicts are recorded in
    ``states`` and the control's in ``ledger``, once per micro-batch also if it is replayed. Row rules count
    too, as every row is in one group. All group rules must share their keys.
    """
    rules = control.group_assertions
    if not rules or control.is_sampled:
        raise SpecError("this needs group rules and no sampling")
    joined = build_population(control, catalog, lenient)
    lineage = joined.lineage
    if len({tuple(sorted(grain(r, lineage))) for r in rules}) > 1:
        raise SpecError("group rules judged on a stream must have the same keys")
    marked = with_references(joined, control.row_assertions, catalog)
    broken = any_of(is_exception(compliant(r, marked.lineage, lenient)) for r in control.row_assertions)
    keys = [lineage.column(k).alias(f"key_{k}") for k in grain(rules[0], lineage)]
    grouped = marked.frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(broken).alias("row_exceptions"),
        *[metric(r, lineage).alias(f"metric_{i}") for i, r in enumerate(rules)],
    )
    failing = F.array(*[fails(r, F.col(f"metric_{i}")) for i, r in enumerate(rules)])
    changes = grouped.withColumn("failing", failing)

    def judge(batch: DataFrame, number: int) -> None:
        run_id = f"{checkpoint}#{number}"
        states.record(batch, number)
        known = F.col("execution_id") == execution_id(run_id, control.control_id)
        if not ledger.executions().filter(known).isEmpty():
            return
        size = F.coalesce(F.sum("rows"), F.lit(0))
        values = {
            "total_population": size,
            "sampled_population": size,
            "row_exceptions": F.coalesce(F.sum("row_exceptions"), F.lit(0)),
            "failing_groups": F.coalesce(F.sum(F.size(F.filter("failing", lambda x: x))), F.lit(0)),
            "group_population": F.count(F.lit(1)) * len(rules),
        }
        counts = states.current(number).agg(*[values[m].cast("bigint").alias(m) for m in METRICS])
        report = judged(counts.withColumn("control_id", F.lit(control.control_id)), [control])
        ledger.append_executions(report, {control.control_id: control}, catalog, joined_samples(batch.sparkSession, []), now(), run_id)

    writer = changes.writeStream.outputMode("update").foreachBatch(judge).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()


# --- follow-ups with a deadline --------------------------------------------------------


def missed_follow_ups(
    control: Control, catalog: Catalog, event_time: str, follow_time: str, within: str, delay: str, lenient: bool = False
) -> DataFrame:
    """Population rows that no follow-up joined within ``within`` of their event, once that is certain.

    The control has one left join, whose right dataset is a stream of follow-ups, and filters on its base. A row
    is held in the join's state until a follow-up with its keys comes, at most until both streams' watermarks
    (``delay`` behind their newest event) have passed its deadline; then it is an exception. The state holds one
    ``within`` and ``delay`` of either stream. Rows and follow-ups without a time have no deadline and are left out.
    After a restart Spark knows a stream's watermark again when the next of its rows arrives; until then nothing is judged.
    """
    joins = [s.action for s in control.steps if isinstance(s.action, JoinLeft)]
    if len(joins) != 1 or any(not isinstance(s.action, (JoinLeft, *FILTERS)) for s in control.steps):
        raise SpecError("a deadline needs one left join and otherwise filters only")
    step = joins[0]
    base, follow_ups = catalog.frame(control.base_dataset), catalog.frame(step.right_dataset)
    lineage, right_lineage = Lineage.of(base, control.base_dataset), Lineage.of(follow_ups, step.right_dataset)
    covered = base.filter(all_of(population_filters(control, lineage, lenient))).withColumn("_event", lineage.column(event_time).cast("timestamp"))
    rows = covered.filter("_event IS NOT NULL").withWatermark("_event", delay)
    names = [f"_key_{i}" for i in range(len(step.right_keys))]
    keys = [right_lineage.column(k).alias(n) for k, n in zip(step.right_keys, names)]
    follow = follow_ups.select(*keys, right_lineage.column(follow_time).cast("timestamp").alias("_follow"))
    follow = follow.filter("_follow IS NOT NULL").withWatermark("_follow", delay)
    same = all_of(lineage.column(left) == F.col(n) for left, n in zip(step.left_keys, names))
    in_time = (F.col("_follow") >= F.col("_event")) & (F.col("_follow") <= F.col("_event") + F.expr(f"INTERVAL {within}"))
    return rows.join(follow, same & in_time, "left_outer").filter("_follow IS NULL").select(*[quoted(c) for c in base.columns])
