"""The audit ledger: append-only tables of controls, evidence and executions."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from controlweave.operators.joins import latest_per_key
from controlweave.plans.spec import Control
from controlweave.sources.evidence import changed_ranges

CONTROLS = (
    "control_id string, control_json string, version string, owner_role string, "
    "approved_by string, approved_at timestamp_ntz"
)
MANIFESTS = (
    "dataset_alias string, parquet_path string, sha256_hash string, row_count bigint, "
    "column_count int, source_system string, extraction_timestamp string, "
    "schema_version string, ingested_at timestamp_ntz, columns array<string>"
)
EXECUTIONS = (
    "execution_id string, verdict string, exception_count bigint, "
    "total_population bigint, sampled_population bigint, exception_rate_percent double, "
    "materiality_threshold_percent double, control_json string, "
    "evidence_hashes map<string,string>, exceptions_sample string, error_type string, "
    "error_message string, executed_at timestamp_ntz, control_id string"
)
#: The folder of a run: its day.
DAY = "executed_on"
RANGES = (
    "dataset_alias string, path string, length bigint, range bigint, offset bigint, bytes bigint, "
    "sha256_hash string, recorded_at timestamp_ntz"
)
RECORDED_VERDICTS = ("PASS", "FAIL", "ERROR")


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def execution_id(run_id: str, control_id: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_OID, f"{run_id}/{control_id}"))


class Ledger:
    """Tables under one folder. Rows are only ever added."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, table: str, frame: DataFrame, *partitions: str, order: list[str] | None = None) -> None:
        one = frame.coalesce(1)
        if order:
            one = one.sortWithinPartitions(*partitions, *order)
        one.write.mode("append").partitionBy(*partitions).parquet(f"{self.folder}/{table}")

    def controls(self) -> DataFrame:
        return self._read("controls", CONTROLS)

    def manifests(self) -> DataFrame:
        return self._read("evidence_manifests", MANIFESTS)

    def executions(self, since: date | None = None) -> DataFrame:
        """Recorded runs; with ``since`` only the folders of that day and later are read."""
        rows = self._read("executions", f"{EXECUTIONS}, {DAY} date")
        if since is not None:
            rows = rows.filter(F.col(DAY) >= F.lit(since))
        return rows.drop(DAY)

    def compact(self, day: date) -> None:
        """Put the runs of one day into one file, ordered by control.

        For a day that is over: who reads it meanwhile may see rows twice.
        """
        path = f"{self.folder}/executions/{DAY}={day.isoformat()}"
        fresh = f"{self.folder}/_compacted-{uuid.uuid4().hex}"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        store = hadoop(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files = lambda folder: [f.getPath() for f in store.listStatus(hadoop(folder)) if f.getPath().getName().endswith(".parquet")]
        before = files(path)
        rows = self.spark.read.schema(EXECUTIONS).parquet(path)
        rows.coalesce(1).sortWithinPartitions("control_id", "executed_at").write.parquet(fresh)
        for new in files(fresh):
            store.rename(new, hadoop(f"{path}/{new.getName()}"))
        for old in before:
            store.delete(old, False)
        store.delete(hadoop(fresh), True)

    def append_controls(
        self, controls: list[Control], approved_by: str, approved_at: datetime | None = None
    ) -> None:
        """Add approved versions; earlier versions stay."""
        when = approved_at or now()
        rows = [
            (c.control_id, c.to_json(), c.governance.version, c.governance.owner_role, approved_by, when)
            for c in controls
        ]
        self._append("controls", self.spark.createDataFrame(rows, CONTROLS))

    def append_manifests(self, manifests: list[dict]) -> None:
        frame = self.spark.createDataFrame(manifests, MANIFESTS)
        self._append("evidence_manifests", frame)

    def ranges(self) -> DataFrame:
        return self._read("evidence_ranges", RANGES)

    def append_ranges(self, alias: str, ranges: DataFrame, recorded_at: datetime | None = None) -> None:
        """Store the leaves of a landing's hash trees, one row per 64 MB of evidence."""
        moment = F.lit((recorded_at or now()).isoformat(sep=" ")).cast("timestamp_ntz")
        rows = ranges.withColumns({"dataset_alias": F.lit(alias), "recorded_at": moment})
        # hashed by all tasks, then few files
        few = rows.select(*[p.split()[0] for p in RANGES.split(", ")]).hint("rebalance")
        few.write.mode("append").partitionBy("dataset_alias").parquet(f"{self.folder}/evidence_ranges")

    def tampered_ranges(self, alias: str, current: DataFrame) -> DataFrame:
        """Which byte ranges of a dataset's landed files are no longer those recorded."""
        files = current.select("path").distinct()
        recorded = latest_per_key(self.ranges().filter(F.col("dataset_alias") == alias), ["path", "range"], ["recorded_at"])
        return changed_ranges(recorded.join(files, "path", "left_semi"), current)

    def append_executions(
        self, reports: DataFrame, controls: dict[str, Control], catalog, samples: DataFrame, executed_at: datetime,
        run_id: str | None = None,
    ) -> None:
        """Add report rows with the control, the evidence hashes and a sample of exceptions.

        With a ``run_id`` the execution ids follow from it, so a run that is repeated can be told.
        """
        facts = [
            (
                c.control_id,
                execution_id(run_id, c.control_id) if run_id else str(uuid.uuid4()),
                c.to_json(),
                {d: catalog.sha256_hash(d) for d in c.datasets if d in catalog},
            )
            for c in controls.values()
        ]
        details = self.spark.createDataFrame(
            facts,
            "control_id string, execution_id string, control_json string, "
            "evidence_hashes map<string,string>",
        )
        names = [part.split()[0] for part in EXECUTIONS.split(", ")]
        rows = (
            reports.filter(F.col("verdict").isin(*RECORDED_VERDICTS))
            .join(details, "control_id")
            .join(samples, "control_id", "left")
            .withColumn("executed_at", F.lit(executed_at.isoformat(sep=" ")).cast("timestamp_ntz"))
            .select(*names)
        )
        # one file per run and day, however many controls: its row groups are ordered by control
        dated = rows.withColumn(DAY, F.col("executed_at").cast("date"))
        self._append("executions", dated, DAY, order=["control_id"])

    def current_control(self, control_id: str) -> Control | None:
        row = current_controls(self.controls().filter(F.col("control_id") == control_id)).first()
        return Control.from_json(row["control_json"]) if row else None


# --- analytics over ledger frames -----------------------------------------------------


def current_controls(controls: DataFrame) -> DataFrame:
    """The newest approved version of every control."""
    return latest_per_key(controls, ["control_id"], ["approved_at", "version"])


def execution_history(executions: DataFrame, control_id: str, limit: int | None = 100) -> DataFrame:
    """The newest runs of one control, a distributed top-n, or without a limit all of them."""
    found = (
        executions.filter(F.col("control_id") == control_id)
        .select(
            "execution_id",
            "control_id",
            "verdict",
            "exception_count",
            "total_population",
            "exception_rate_percent",
            "executed_at",
        )
    )
    return found if limit is None else found.orderBy(F.desc("executed_at"), "execution_id").limit(limit)


def evidence_lineage(
    executions: DataFrame,
    manifests: DataFrame,
    execution_id: str | None = None,
    limit: int | None = None,
    latest_only: bool = False,
) -> DataFrame:
    """Each run's evidence hash beside the recorded hashes of that dataset.

    One run is compared with every recorded landing of its datasets, and so are all
    runs. With a ``limit`` only the newest lines are listed, and the runs are
    narrowed first, so that the other pairs never arise. ``latest_only`` compares every run with the newest landing of
    each dataset and lists everything.
    """
    used = executions
    if execution_id is not None:
        used = used.filter(F.col("execution_id") == execution_id)
    used = used.select(
        "execution_id",
        "control_id",
        "verdict",
        "executed_at",
        F.explode("evidence_hashes").alias("dataset_alias", "execution_hash"),
    ).filter(F.col("execution_hash").isNotNull())
    recorded = manifests.select("dataset_alias", F.col("sha256_hash").alias("stored_hash"), "ingested_at")
    newest_first = [F.desc("executed_at"), F.col("execution_id"), F.col("dataset_alias")]
    if latest_only:
        recorded = latest_per_key(recorded, ["dataset_alias"], ["ingested_at", "stored_hash"])
    elif execution_id is None and limit is not None:
        known = recorded.select("dataset_alias").distinct()
        used = used.join(known, "dataset_alias", "left_semi").orderBy(*newest_first).limit(limit)
    lines = used.join(recorded, "dataset_alias").select(
        "execution_id",
        "control_id",
        "verdict",
        "executed_at",
        "dataset_alias",
        "stored_hash",
        "execution_hash",
        F.when(F.col("stored_hash") == F.col("execution_hash"), "VALID")
        .otherwise("TAMPERED")
        .alias("integrity_status"),
        "ingested_at",
    )
    if execution_id is None and not latest_only and limit is not None:
        lines = lines.orderBy(*newest_first, "ingested_at", "stored_hash").limit(limit)
    return lines.drop("ingested_at")


def dashboard_stats(executions: DataFrame, controls: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Controls in force, and verdicts and mean exception rate of the last 30 days."""
    moment = F.lit((as_of or now()).isoformat(sep=" ")).cast("timestamp_ntz")
    recent = executions.filter(F.col("executed_at") >= moment - F.expr("INTERVAL 30 DAYS"))
    verdict = F.col("verdict")
    rate = F.avg(F.when(verdict.isin("PASS", "FAIL"), F.col("exception_rate_percent")))
    total = controls.agg(F.count_distinct("control_id")).scalar()
    return recent.agg(
        F.count_if(verdict == "PASS").alias("pass_count"),
        F.count_if(verdict == "FAIL").alias("fail_count"),
        F.count_if(verdict == "ERROR").alias("error_count"),
        F.coalesce(F.round(rate, 2), F.lit(0.0)).alias("avg_exception_rate"),
    ).select(total.alias("total_controls"), "*")
