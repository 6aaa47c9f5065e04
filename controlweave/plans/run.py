"""Running controls: exceptions, verdicts, pre-flight checks and batches."""

from __future__ import annotations

import hashlib
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from controlweave.functions.conditions import quoted, sql_text
from controlweave.operators.groups import failing_groups, groups_failing_all
from controlweave.operators.population import Joined, build_population
from controlweave.operators.rules import broken_rules, compliant, row_exceptions, with_references
from controlweave.operators.sampling import sample, settled
from controlweave.plans.metrics import exception_rows, metrics, sharing_key
from controlweave.plans.spec import Control, SpecError

EMPTY_POPULATION = "The population holds no rows after its filters, so nothing can be attested."
SAMPLE_ROWS = 100  # exceptions shown in a report; all of them go to the exceptions sink
PARALLEL_JOBS = 4

REPORT = T.StructType(
    [
        T.StructField("control_id", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("exception_count", T.LongType()),
        T.StructField("total_population", T.LongType()),
        T.StructField("sampled_population", T.LongType()),
        T.StructField("exception_rate_percent", T.DoubleType()),
        T.StructField("materiality_threshold_percent", T.DoubleType()),
        T.StructField("group_population", T.LongType()),
        T.StructField("group_exception_rate_percent", T.DoubleType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)


# --- the rows a control covers and the rows that break it ------------------------


def population(control: Control, catalog, lenient: bool = False) -> Joined:
    """The rows under test: joined, filtered and, if asked for, sampled."""
    return sample(build_population(control, catalog, lenient), control.sampling, catalog)


def exceptions(
    control: Control, catalog, combine: str = "each", lenient: bool = False
) -> dict[str, DataFrame]:
    """What breaks the control, as frames to write or count, never collected here.

    ``combine="each"`` judges every group rule at its own grain and apart from the
    row rules: the key ``rows`` holds offending rows, the id of each group rule its
    offending groups. ``combine="all"`` gives one frame named ``exceptions``: with
    group rules present, the groups (at the grain of all their keys) that break
    every group rule, formed from rows that break a row rule.
    """
    rows, groups = control.row_assertions, control.group_assertions
    if combine == "all":
        if not groups:
            tested = population(control, catalog, lenient)
            if not rows:  # no rule at all: the query lists the population
                return {"exceptions": tested.frame}
            return {"exceptions": row_exceptions(tested, rows, catalog, lenient)}
        covered = build_population(control, catalog, lenient)
        if rows:
            covered = Joined(row_exceptions(covered, rows, catalog, lenient), covered.lineage)
        return {"exceptions": groups_failing_all(covered, groups)}
    if combine != "each":
        raise SpecError("combine is 'each' or 'all'")
    found = {}
    if rows:
        found["rows"] = row_exceptions(population(control, catalog, lenient), rows, catalog, lenient)
    if groups:
        covered = build_population(control, catalog, lenient)
        for rule in groups:
            found[rule.assertion_id] = failing_groups(covered, rule)
    return found


def attribution(control: Control, catalog, lenient: bool = False) -> DataFrame:
    """Row exceptions with the array of rule ids each of them breaks."""
    return broken_rules(population(control, catalog, lenient), control.row_assertions, catalog, lenient)


def attribution_counts(control: Control, catalog, lenient: bool = False) -> DataFrame:
    """Exceptions per row rule, all rules counted in one pass."""
    tested = population(control, catalog, lenient)
    rules = control.row_assertions
    marked = with_references(tested, rules, catalog)
    counts = [
        F.count_if(~F.coalesce(compliant(r, marked.lineage, lenient), F.lit(False))).alias(f"c{i}")
        for i, r in enumerate(rules)
    ]
    lines = [
        F.struct(F.lit(r.assertion_id).alias("assertion_id"), F.col(f"c{i}").alias("exception_count"))
        for i, r in enumerate(rules)
    ]
    return marked.frame.agg(*counts).select(F.inline(F.array(*lines)))


def as_json(frame: DataFrame, names: list[str]) -> Column:
    """A row as JSON: absent values and NaN are null, timestamps ISO text."""
    types = {f.name: f.dataType for f in frame.schema.fields}

    def finite(name: str) -> Column:
        column = quoted(name)
        if isinstance(types[name], (T.DoubleType, T.FloatType)):
            column = F.when(~F.isnan(column), column)
        return column.alias(name)

    return F.to_json(F.struct(*[finite(n) for n in names]), {"ignoreNullFields": "false"}).alias("exception_json")


def exceptions_sample(frame: DataFrame, order: list[str] | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first exceptions in a fixed order, each as JSON (a distributed top-n)."""
    top = frame.orderBy(*[quoted(k) for k in order or frame.columns]).limit(rows)
    return top.select(as_json(top, frame.columns))


# --- verdicts ---------------------------------------------------------------------


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100)


def judged(counts: DataFrame, controls: list[Control]) -> DataFrame:
    """Verdict columns from counts: at most the threshold passes, no rows is an error."""
    pairs = dict.fromkeys((c.control_id, c.threshold) for c in controls)
    thresholds = F.expr("map(" + ", ".join(f"{sql_text(i)}, {t!r}D" for i, t in pairs) + ")")
    found = F.col("row_exceptions") + F.col("failing_groups")
    rate = percent(found, F.col("sampled_population"))
    limit = F.element_at(thresholds, F.col("control_id"))
    empty = F.col("total_population") == 0
    verdict = F.when(empty, "ERROR").when(F.coalesce(rate, F.lit(0.0)) <= limit, "PASS").otherwise("FAIL")
    columns = {
        "control_id": F.col("control_id"),
        "verdict": verdict,
        "exception_count": found,
        "total_population": F.col("total_population"),
        "sampled_population": F.col("sampled_population"),
        "exception_rate_percent": F.round(rate, 2),
        "materiality_threshold_percent": limit,
        "group_population": F.col("group_population"),
        "group_exception_rate_percent": F.round(percent(F.col("failing_groups"), F.col("group_population")), 2),
        "error_type": F.when(empty, "ZeroPopulation"),
        "error_message": F.when(empty, EMPTY_POPULATION),
    }
    return counts.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in REPORT.fields])


def report(controls: list[Control], catalog, lenient: bool = False) -> DataFrame:
    """Report rows of valid controls as one lazy frame."""
    return judged(metrics(controls, catalog, lenient), controls)


def run_control(control: Control, catalog, lenient: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One control: its report row and its exceptions, both lazy."""
    control = replace(control, sampling=settled(control.sampling))
    return report([control], catalog, lenient), exceptions(control, catalog, lenient=lenient)


# --- pre-flight checks --------------------------------------------------------------


def dry_run(control: Control, catalog, lenient: bool = False) -> tuple[bool, str]:
    """Bind the whole control against the schemas without starting a job."""
    try:
        missing = [d for d in control.datasets if d not in catalog]
        if missing:
            raise SpecError(f"no dataset for alias(es) {', '.join(missing)}")
        view = catalog.for_analysis()
        joined = build_population(control, view, lenient)
        if control.is_sampled:
            plan = control.sampling
            names = [*plan.sample_key, *filter(None, [plan.stratification_field])]
            joined.frame.select(*[joined.lineage.column(n) for n in names]).schema
        if control.row_assertions:
            row_exceptions(joined, control.row_assertions, view, lenient).schema
        for rule in control.group_assertions:
            failing_groups(joined, rule).schema
        joined.frame.schema
    except (SpecError, PySparkException) as error:
        return False, f"{type(error).__name__}: {error}"
    return True, "Valid"


# Types a declared business type may have in the evidence (fixed values).
ACCEPTED_TYPES = {
    "string": ("string",),
    "numeric": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"),
    "timestamp": ("timestamp", "timestamp_ntz"),
    "date": ("date", "timestamp", "timestamp_ntz"),
    "boolean": ("boolean",),
}


def schema_drift(spark: SparkSession, control: Control, catalog) -> DataFrame:
    """Declared fields against actual columns, one row per bound dataset.

    Works on schemas only, so its size is the number of declared fields.
    """
    lines = []
    for alias in dict.fromkeys(b.dataset_alias for b in control.bindings):
        declared = [b for b in control.bindings if b.dataset_alias == alias]
        actual = {}
        if alias in catalog:
            actual = {f.name.lower(): f.dataType.typeName() for f in catalog.frame(alias).schema.fields}
        missing = sorted(b.technical_field for b in declared if b.technical_field.lower() not in actual)
        mistyped = sorted(
            b.technical_field
            for b in declared
            if b.technical_field.lower() in actual
            and simple_type(actual[b.technical_field.lower()]) not in ACCEPTED_TYPES[b.data_type]
        )
        status = "SCHEMA_DRIFT_DETECTED" if missing else "TYPE_DRIFT_DETECTED" if mistyped else "VALID"
        lines.append((alias, status, missing, mistyped, sorted(actual)))
    return spark.createDataFrame(
        lines,
        "dataset_alias string, status string, missing_columns array<string>, "
        "mistyped_columns array<string>, available_columns array<string>",
    )


def simple_type(name: str) -> str:
    names = {"byte": "tinyint", "short": "smallint", "integer": "int", "long": "bigint"}
    return names.get(name, name)


# --- batches ------------------------------------------------------------------------


def failure(control: Control, verdict: str, error_type: str, message: str) -> dict:
    return {
        "control_id": control.control_id,
        "verdict": verdict,
        "materiality_threshold_percent": control.threshold,
        "error_type": error_type,
        "error_message": message,
    }


def collect_reports(controls: list[Control], catalog, lenient: bool) -> list[dict]:
    """Report rows of controls that share a scan. If the scan fails, for whatever
    reason, either half is tried: a bad control among n costs about 2 log n scans
    and does not take the others with it."""
    try:
        return [row.asDict() for row in report(controls, catalog, lenient).collect()]
    except Exception as error:  # noqa: BLE001 - a batch outlives its controls
        if len(controls) == 1:
            return [failure(controls[0], "ERROR", error_kind(error), str(error))]
    half = len(controls) // 2
    return [line for part in (controls[:half], controls[half:]) for line in collect_reports(part, catalog, lenient)]


def error_kind(error: Exception) -> str:
    """Spark's error condition where there is one, else the exception's class."""
    found = re.search(r"\[([A-Z][A-Z0-9_.]{5,})\]", str(error)) if not isinstance(error, (SpecError, PySparkException)) else None
    return found[1] if found else type(error).__name__


def run_controls(
    spark: SparkSession,
    controls: list[Control],
    catalog,
    ledger=None,
    exceptions_to: str | None = None,
    lenient: bool = False,
    executed_at: datetime | None = None,
    sample_rows: int = SAMPLE_ROWS,
    run_id: str | None = None,
) -> DataFrame:
    """Run many controls and return their report rows, in the order given.

    Missing evidence gives SKIPPED, a control that does not bind or fails while
    running gives ERROR. With ``exceptions_to`` every exception is written there,
    partitioned by control; with ``ledger`` the reports are appended to it. An exception
    table that cannot be stored leaves the verdicts standing; the report names the failure.
    Samples without a seed get one for the run, which report, exceptions and ledger share.
    """
    ids = [c.control_id for c in controls]
    if len(set(ids)) < len(ids):
        raise SpecError(f"control id(s) used twice: {', '.join(sorted({i for i in ids if ids.count(i) > 1}))}")
    controls = [replace(c, sampling=settled(c.sampling)) for c in controls]
    executed_at = executed_at or datetime.now(timezone.utc).replace(tzinfo=None)
    lines: dict[str, dict] = {}
    fed = []
    for control in controls:
        missing = [d for d in control.datasets if d not in catalog]
        if missing:
            message = f"no evidence for {', '.join(missing)}"
            lines[control.control_id] = failure(control, "SKIPPED", "MissingEvidence", message)
        else:
            fed.append(control)

    runnable: dict[tuple, list[Control]] = {}
    with ThreadPoolExecutor(PARALLEL_JOBS) as pool:
        for control, (valid, message) in zip(fed, pool.map(lambda c: dry_run(c, catalog, lenient), fed)):
            if valid:
                key = (control.control_id,) if control.is_sampled else sharing_key(control)
                runnable.setdefault(key, []).append(control)
            else:
                lines[control.control_id] = failure(control, "ERROR", message.split(":")[0], message)
        for found in pool.map(lambda group: collect_reports(group, catalog, lenient), runnable.values()):
            lines.update({line["control_id"]: line for line in found})

    by_id = {c.control_id: c for c in controls}
    failing = [by_id[i] for i, line in lines.items() if line["verdict"] != "ERROR" and line.get("exception_count")]
    samples: list[DataFrame] = []
    unstored: list[str] = []
    if exceptions_to or ledger is not None:
        for name, frame in exception_tables(failing, catalog, lenient).items():
            try:
                if exceptions_to:
                    path = f"{exceptions_to}/{name}/run={executed_at:%Y%m%dT%H%M%S%f}"
                    # one shuffle of the exceptions: few files per control, a large control split
                    balanced = frame.hint("rebalance", "control_id")
                    balanced.write.mode("overwrite").partitionBy("control_id").parquet(path)
                    frame = spark.read.schema(frame.schema).parquet(path)
                samples.append(samples_per_control(frame, sample_rows))
            except Exception as error:  # noqa: BLE001 - the verdicts stand
                unstored.append(f"{name}: {error_kind(error)}: {error}")

    for line in lines.values() if unstored else ():
        if line["verdict"] == "FAIL":
            line.update(error_type="ExceptionsNotStored", error_message="; ".join(unstored)[:2000])
    def reported() -> DataFrame:
        rows = [tuple(lines[c.control_id].get(f.name) for f in REPORT.fields) for c in controls]
        return spark.createDataFrame(rows, REPORT)

    if ledger is not None:
        record = lambda found: ledger.append_executions(reported(), by_id, catalog, joined_samples(spark, found, sample_rows), executed_at, run_id)
        try:
            record(samples)
        except Exception as error:  # noqa: BLE001 - a sample that fails must not lose the verdicts
            if not samples:
                raise
            for line in lines.values():
                if line["verdict"] == "FAIL":
                    told = [line.get("error_message"), f"samples: {error_kind(error)}: {error}"]
                    line.update(error_type=line.get("error_type") or "SampleNotStored", error_message="; ".join(filter(None, told))[:2000])
            record([])
    return reported()


def exception_tables(controls: list[Control], catalog, lenient: bool) -> dict[str, DataFrame]:
    """Everything that breaks these controls, as few frames as possible.

    Row exceptions of controls on the same joined rows come from one pass and form
    one frame; each group rule has a frame of its own. All carry ``control_id``.
    """
    tables: dict[str, DataFrame] = {}
    shared: dict[tuple, list[Control]] = {}
    for control in controls:
        if control.row_assertions and control.is_sampled:
            found = attribution(control, catalog, lenient)
            tables[f"{control.base_dataset}-sample-{control.control_id}"] = found.withColumn(
                "control_id", F.lit(control.control_id)
            )
        elif control.row_assertions:
            shared.setdefault(sharing_key(control), []).append(control)
        for rule in control.group_assertions:
            found = failing_groups(build_population(control, catalog, lenient), rule)
            tables[f"{control.base_dataset}-groups-{control.control_id}-{rule.assertion_id}"] = found.withColumn(
                "control_id", F.lit(control.control_id)
            )
    for key, together in shared.items():
        digest = hashlib.md5(repr(key).encode()).hexdigest()[:8]
        tables[f"{together[0].base_dataset}-rows-{digest}"] = exception_rows(together, catalog, lenient)
    return tables


def samples_per_control(frame: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Some exceptions of each control as JSON lines, the same on every run: those
    whose JSON has the lowest hashes. The hashes alone are ranked first, at most ``rows`` of a
    control leave a task, so no other JSON is sorted or shuffled."""
    names = [c for c in frame.columns if c != "control_id"]
    lines = frame.select("control_id", as_json(frame, names)).withColumn("_hash", F.xxhash64("exception_json"))
    ranked = lambda some, *order: some.withColumn("_rank", F.row_number().over(Window.partitionBy("control_id").orderBy(*order))).filter(F.col("_rank") <= rows)
    cuts = ranked(lines.select("control_id", "_hash"), "_hash").groupBy(F.col("control_id").alias("_control")).agg(F.max("_hash").alias("_cut"))
    low = lines.join(F.broadcast(cuts), F.col("control_id").eqNullSafe(F.col("_control")) & (F.col("_hash") <= F.col("_cut")))
    return ranked(low.select(*lines.columns), "_hash", "exception_json").select("control_id", "_rank", "exception_json")


def joined_samples(spark: SparkSession, parts: list[DataFrame], rows: int = SAMPLE_ROWS) -> DataFrame:
    """One JSON list per control, of at most ``rows`` exceptions."""
    if not parts:
        return spark.createDataFrame([], "control_id string, exceptions_sample string")
    lines = reduce(DataFrame.unionByName, parts)
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "exception_json")))["exception_json"]
    few = F.slice(ordered, 1, rows)
    return lines.groupBy("control_id").agg(
        F.concat(F.lit("["), F.array_join(few, ","), F.lit("]")).alias("exceptions_sample")
    )


def batch_summary(results: DataFrame, cached: Column | None = None) -> DataFrame:
    """Totals by verdict over the result rows of a batch."""
    cached = F.lit(False) if cached is None else cached
    verdict = F.col("verdict")
    counts = results.agg(
        F.count(F.lit(1)).alias("total_projects"),
        *[
            F.count_if(verdict == name).alias(f"{label}_count")
            for name, label in (("PASS", "pass"), ("FAIL", "fail"), ("ERROR", "error"), ("SKIPPED", "skipped"))
        ],
        F.count_if(cached & verdict.isin("PASS", "FAIL")).alias("cached_dsl_count"),
    )
    generated = F.expr("total_projects - cached_dsl_count - error_count - skipped_count")
    return counts.withColumn("generated_dsl_count", generated)
