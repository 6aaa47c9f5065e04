"""Evidence landing: clean incoming tables, write them, and describe what was written."""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from controlweave.functions.conditions import quoted
from controlweave.operators.sampling import draw
from controlweave.plans.spec import SpecError

# Fixed values of the cleaning rules.
ID_KEYWORDS = ("id", "code", "number")
DATE_KEYWORD = "date"
NUMBER_TEXT = r"^[\s$€£¥]*[\d,\.]+$"
NOT_NUMBER = r"[^\d.-]"
# Spellings of "no value" that don't count against a column of numbers or dates (fixed values).
NO_VALUE = ("", "-", "n/a", "na", "nan", "none", "null")
# Shares of the other values that must be readable before a text column is converted by itself.
NUMBER_SHARE, DATE_SHARE = 1.0, 0.5

# Date spellings tried in turn after ISO dates and timestamps.
DATE_FORMATS = ("MM/dd/yyyy", "dd/MM/yyyy", "dd-MMM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy")

RECORDS_PER_FILE = 1_000_000
#: Bytes of a file that are hashed as one, and hashes that are joined into one.
RANGE_BYTES, FAN_OUT = 64 << 20, 1024


# --- cleaning -----------------------------------------------------------------------


def clean_name(name: str) -> str:
    return name.strip().replace(" ", "_").lower()


def with_clean_names(frame: DataFrame) -> DataFrame:
    names = [clean_name(c) for c in frame.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise SpecError(f"columns share the name(s) {', '.join(twice)} after cleaning")
    return frame.toDF(*names)


def is_identifier(name: str) -> bool:
    return any(word in name for word in ID_KEYWORDS)


def as_number(column: Column, decimal_comma: bool = False) -> Column:
    """Currency and number text as a double; anything else is NULL."""
    text = column.cast("string")
    if decimal_comma:
        text = F.translate(F.regexp_replace(text, r"\.", ""), ",", ".")
    return F.regexp_replace(text, NOT_NUMBER, "").try_cast("double")


def as_timestamp(column: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Date text as a zone-less timestamp; anything unreadable is NULL."""
    tries = [column.try_cast("timestamp_ntz")]
    tries += [F.try_to_date(column, fmt).cast("timestamp_ntz") for fmt in formats]
    return F.coalesce(*tries)


def shape(date_format: str) -> str:
    """Formats of one shape read the same texts otherwise: ``MM/dd/yyyy`` and ``dd/MM/yyyy``."""
    return re.sub(r"[A-Za-z]+", lambda letters: str(len(letters[0])), date_format)


@dataclass(frozen=True)
class Profile:
    """What one column's values can be read as, counted over all of them. Spellings of "no value" don't count."""

    present: int
    numbers: int
    dates: int
    by_format: dict[str, int]

    def is_number(self, min_share: float) -> bool:
        return self.numbers > 0 and self.numbers >= min_share * self.present

    def is_date(self) -> bool:
        return self.dates > 0 and self.dates >= DATE_SHARE * self.present

    def elected(self) -> tuple[str, ...]:
        """One format of each shape, the one that reads most of the column; between equals the first."""
        best: dict[str, str] = {}
        for found in self.by_format:
            held = best.setdefault(shape(found), found)
            if self.by_format[found] > self.by_format[held]:
                best[shape(found)] = found
        return tuple(best.values())


def profiles(frame: DataFrame, dated: list[str], sniffed: list[str], decimal_comma: bool, date_formats: tuple[str, ...]) -> dict[str, Profile]:
    """The profiles of these columns, from one aggregate over one pass."""
    counts, names = [], list(dict.fromkeys([*dated, *sniffed]))
    if not names:
        return {}
    for i, name in enumerate(names):
        column = quoted(name)
        present = column.isNotNull() & ~F.lower(F.trim(column.cast("string"))).isin(*NO_VALUE)
        reads = lambda test, present=present: F.count_if(present & F.coalesce(test, F.lit(False)))
        counts.append(F.count_if(present).alias(f"n{i}"))
        if name in sniffed:
            counts.append(reads(column.rlike(NUMBER_TEXT) & as_number(column, decimal_comma).isNotNull()).alias(f"m{i}"))
        if name in dated:
            text = column.cast("string")
            counts.append(reads(as_timestamp(text, date_formats).isNotNull()).alias(f"d{i}"))
            counts += [reads(F.try_to_date(text, fmt).isNotNull()).alias(f"f{i}_{k}") for k, fmt in enumerate(date_formats)]
    found = frame.agg(*counts).first().asDict()
    return {
        name: Profile(found[f"n{i}"], found.get(f"m{i}", 0), found.get(f"d{i}", 0), {fmt: found.get(f"f{i}_{k}", 0) for k, fmt in enumerate(date_formats)})
        for i, name in enumerate(names)
    }


@dataclass(frozen=True)
class Cleaned:
    """One column after cleaning: the rule applied and the expression for it."""

    name: str
    rule: str  # keep, string, numeric, timestamp
    column: Column


def cleaning(
    frame: DataFrame,
    overrides: dict[str, str] | None = None,
    min_share: float = NUMBER_SHARE,
    decimal_comma: bool = False,
    date_formats: tuple[str, ...] = DATE_FORMATS,
) -> list[Cleaned]:
    """Decide each column's rule from its name, type and content.

    Columns with a date name become timestamps if half of their values are dates; of formats that read the same
    texts otherwise, a column is read by the one that fits most of it. Of the
    others, identifier-like names become text, and text columns become numbers if
    every value (or ``min_share`` of them) is number text. ``overrides`` fixes the rule of
    single columns.
    """
    overrides = overrides or {}
    types = {f.name: f.dataType for f in frame.schema.fields}
    texts = [n for n, t in types.items() if isinstance(t, T.StringType)]
    open_to = [n for n in types if n not in overrides]
    dated = [n for n in open_to if DATE_KEYWORD in n and (n in texts or is_identifier(n))]
    is_date = lambda column: as_timestamp(column.cast("string"), date_formats).isNotNull()
    sniffed = [n for n in texts if n in open_to and not is_identifier(n)]
    timed = [n for n, rule in overrides.items() if rule == "timestamp" and n in types]
    read = profiles(frame, [*dated, *timed], sniffed, decimal_comma, date_formats)
    dates = {n for n in dated if read[n].is_date()}
    numbers = {n for n in sniffed if n not in dates and read[n].is_number(min_share)}

    def rule_for(name: str) -> str:
        if name in overrides:
            return overrides[name]
        if name in dates:
            return "timestamp"
        if name in numbers:
            return "numeric"
        return "string" if is_identifier(name) else "keep"

    plan = []
    for name in types:
        column, rule = quoted(name), rule_for(name)
        if rule == "numeric":
            column = as_number(column, decimal_comma)
        elif rule == "timestamp":
            column = as_timestamp(column.cast("string"), read[name].elected())
        elif rule == "string":
            column = column.cast("string")
        elif rule != "keep":
            raise SpecError(f"cleaning rule of '{name}': {rule!r} is not known")
        plan.append(Cleaned(name, rule, column.alias(name)))
    return plan


def clean(frame: DataFrame, **options) -> DataFrame:
    named = with_clean_names(frame)
    return named.select(*[c.column for c in cleaning(named, **options)])


def cleaning_report(frame: DataFrame, **options) -> DataFrame:
    """The rule applied to each column and how many values it turned into NULL."""
    named = with_clean_names(frame)
    plan = cleaning(named, **options)
    lost = [F.count_if(quoted(c.name).isNotNull() & c.column.isNull()).alias(f"x{i}") for i, c in enumerate(plan)]
    lines = [
        F.struct(
            F.lit(c.name).alias("column_name"), F.lit(c.rule).alias("rule"), F.col(f"x{i}").alias("nulls_introduced")
        )
        for i, c in enumerate(plan)
    ]
    return named.agg(*lost).select(F.inline(F.array(*lines)))


# --- fingerprints ---------------------------------------------------------------------


def schema_version(frame: DataFrame) -> str:
    """Sixteen hex digits that change when a column's name, type or place does."""
    text = ",".join(f"{name}:{kind}" for name, kind in frame.dtypes)
    return hashlib.md5(text.encode()).hexdigest()[:16]


def byte_ranges(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """Every data file under ``path`` in ranges of ``size`` bytes: ``path``, ``length``, ``range``, ``offset``, ``bytes``.

    Only the listing is read. Spark lists no empty files.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )
    last = F.ceil(F.col("length") / size) - 1
    ranges = files.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("range"))
    return ranges.withColumn("offset", F.col("range") * size).withColumn("bytes", F.least(F.lit(size), F.col("length") - F.col("offset")))


def range_hashes(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """SHA-256 of every byte range under ``path``: the leaves of the files' hash trees.

    Ranges are spread over all tasks, and a task holds a few MB of one at a time, so files may have any size.
    """

    def digest(batches):
        import hashlib

        import pyarrow as pa
        import pyarrow.fs as pafs

        for part in batches:
            found = []
            for row in part.to_pylist():
                store, name = pafs.FileSystem.from_uri(row["path"])
                value, left = hashlib.sha256(), row["bytes"]
                with store.open_input_file(name) as file:
                    file.seek(row["offset"])
                    while left and (data := file.read(min(left, 1 << 22))):
                        value.update(data)
                        left -= len(data)
                if left:
                    raise OSError(f"{row['path']} ends before byte {row['offset'] + row['bytes']}")
                found.append(value.hexdigest())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, "sha256_hash"])

    ranges = byte_ranges(spark, path, size)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = ranges.repartition(tasks, "path", "range")
    return spread.mapInArrow(digest, "path string, length bigint, range bigint, offset bigint, bytes bigint, sha256_hash string")


def folded_hashes(leaves: DataFrame, keys: list[str], place: str, fan_out: int = FAN_OUT) -> DataFrame:
    """The roots of hash trees: ``keys`` and ``sha256_hash``.

    ``place`` numbers the leaves of a tree from 0. Up to ``fan_out`` neighbours are joined into the hash of their
    hashes, level by level, so no task sees more than that of a tree; a tree of one leaf has the leaf's hash.
    """
    levels, span = 0, (leaves.agg(F.max(place)).first()[0] or 0) + 1
    while span > 1:
        levels, span = levels + 1, -(-span // fan_out)
    nodes = leaves.select(*keys, F.col(place).alias("_place"), "sha256_hash")
    for _ in range(levels):
        children = F.array_sort(F.collect_list(F.struct("_place", "sha256_hash")))["sha256_hash"]
        grouped = nodes.groupBy(*keys, F.floor(F.col("_place") / fan_out).alias("_place")).agg(children.alias("_children"))
        joined = F.when(F.size("_children") == 1, F.col("_children")[0]).otherwise(F.sha2(F.array_join("_children", ""), 256))
        nodes = grouped.select(*keys, "_place", joined.alias("sha256_hash"))
    return nodes.drop("_place")


def changed_ranges(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Where two listings of range hashes differ: ``path``, ``range``, ``offset``, ``bytes`` and ``change``."""
    old = stored.select("path", "range", *[F.col(c).alias(f"_{c}") for c in ("offset", "bytes", "sha256_hash")])
    both = current.join(old, ["path", "range"], "full_outer")
    change = F.when(F.col("_sha256_hash").isNull(), "ADDED").when(F.col("sha256_hash").isNull(), "MISSING").otherwise("CHANGED")
    differs = ~F.col("sha256_hash").eqNullSafe(F.col("_sha256_hash"))
    return both.filter(differs).select("path", "range", F.coalesce("offset", "_offset").alias("offset"), F.coalesce("bytes", "_bytes").alias("bytes"), change.alias("change"))


def file_hashes(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """One hash for every data file under ``path``: its SHA-256 if it is one range, else the root of its hash tree."""
    ranges = range_hashes(spark, path, size)
    return folded_hashes(ranges, ["path", "length"], "range")


def dataset_hash(spark: SparkSession, path: str) -> DataFrame:
    """One hash for all files of a dataset, whatever their order."""
    return combined_hash(file_hashes(spark, path))


def combined_hash(files: DataFrame) -> DataFrame:
    """``file_count`` and one ``sha256_hash`` of the files' hashes.

    File hashes are combined by their first three digits (at most 4096 buckets)
    and the buckets once more, so no task gathers all files. A dataset of one
    file has that file's own hash.
    """
    hashes = files.groupBy("sha256_hash").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat_ws("*", "sha256_hash", F.col("n").cast("string"))
    buckets = hashes.groupBy(F.substring("sha256_hash", 1, 3).alias("bucket")).agg(
        F.sum("n").alias("files"),
        F.max("sha256_hash").alias("only"),
        F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ","), 256).alias("digest"),
    )
    combined = F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "bucket", "digest"))), ","), 256)
    count = F.sum("files")
    return buckets.agg(
        count.alias("file_count"),
        F.when(count == 1, F.max("only")).otherwise(combined).alias("sha256_hash"),
    )


def content_fingerprint(frame: DataFrame) -> DataFrame:
    """Row count and a sum over row hashes: equal for equal contents in any order."""
    digits = F.substring(draw(frame.columns, 0), 1, 15)
    value = F.conv(digits, 16, 10).cast("decimal(38,0)")
    return frame.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(value).cast("string"), F.lit("0")).alias("content_sum"),
    )


# --- landing ----------------------------------------------------------------------------


def read_source(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """Incoming evidence. CSV is read as text so the cleaning rules decide types."""
    if kind == "csv":
        return spark.read.options(**{"header": "true", **options}).csv(path)
    if kind == "json":
        return spark.read.options(**options).json(path)
    if kind == "parquet":
        return spark.read.options(**options).parquet(path)
    if kind == "orc":
        return spark.read.options(**options).orc(path)
    raise SpecError(f"evidence comes as csv, json, parquet or orc, not {kind!r}")


def land(
    spark: SparkSession,
    frame: DataFrame,
    alias: str,
    folder: str,
    source_system: str = "UNKNOWN",
    extraction_timestamp: datetime | None = None,
    records_per_file: int = RECORDS_PER_FILE,
    **cleaning_options,
) -> dict:
    """Clean ``frame``, write it to a path of its own and return its manifest.

    Earlier landings of the dataset stay as they are, so their manifests can be checked later.
    """
    moment = datetime.now(timezone.utc)
    path = f"{folder}/{alias}/{moment:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}.parquet"
    cleaned = clean(frame, **cleaning_options)
    cleaned.write.option("maxRecordsPerFile", records_per_file).parquet(path)
    return manifest(spark, alias, path, source_system, extraction_timestamp)


def land_all(
    spark: SparkSession,
    sources: dict[str, DataFrame],
    prefix: str,
    folder: str,
    source_system: str = "UNKNOWN",
    extraction_timestamp: datetime | None = None,
    **cleaning_options,
) -> dict[str, dict]:
    """Land several tables of one delivery as ``{prefix}_{table}``; manifests by alias."""
    manifests = {}
    for table, frame in sources.items():
        alias = f"{prefix}_{clean_name(table)}"
        manifests[alias] = land(
            spark, frame, alias, folder, source_system, extraction_timestamp, **cleaning_options
        )
    return manifests


def manifest(
    spark: SparkSession,
    alias: str,
    path: str,
    source_system: str = "UNKNOWN",
    extraction_timestamp: datetime | None = None,
) -> dict:
    """What is on disk: size, columns, schema version and file hash."""
    landed = spark.read.parquet(path)
    return {
        "dataset_alias": alias,
        "parquet_path": path,
        "sha256_hash": dataset_hash(spark, path).first()["sha256_hash"],
        "row_count": landed.count(),
        "column_count": len(landed.columns),
        "source_system": source_system,
        "extraction_timestamp": extraction_timestamp.isoformat() if extraction_timestamp else None,
        "schema_version": schema_version(landed),
        "ingested_at": datetime.now(timezone.utc).replace(tzinfo=None),
        "columns": landed.columns,
    }


def file_prefix(path: str) -> str:
    """Dataset prefix of a source file: its name without folder and extension."""
    return clean_name(re.sub(r"\.[^.]+$", "", path.rstrip("/").rsplit("/", 1)[-1]))
