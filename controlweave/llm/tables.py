"""Written tables, Arrow batches and files that all executors reach."""

from __future__ import annotations

import gc
import io
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from controlweave.session import fresh_folder

#: Rows of one Arrow batch sent to Python: bounds what a worker holds when texts are long.
ROWS_PER_BATCH = 128
#: Bytes of text that one numpy pass works on.
CHUNK_BYTES = 1 << 20
#: Bits of a table that tells which keys are certainly not in a set; 1 MB whatever the set.
TABLE_BITS = 23


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, through the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(top.rglob("*.py")):
            archive.write(source, source.relative_to(top.parent))
    uri = f"{fresh_folder(spark, 'code')}/{top.name}.zip"
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(packed.getvalue())
    context.addPyFile(uri)
    _shipped.add(context.applicationId)


def prepared(spark: SparkSession) -> SparkSession:
    """What the Python stages rely on: the package on executors, small batches, adaptive execution."""
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written while someone collects them, to be removed when what was made from them is stored.
_collected: list[list[str]] = []


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The folders that operators write meanwhile."""
    folders: list[str] = []
    _collected.append(folders)
    try:
        yield folders
    finally:
        _collected.remove(folders)


def remove(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders of the shared store that no frame is read from any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in folders:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the cluster delete the shuffle files of frames that are no longer used.

    It does so when the driver collects its garbage, which a driver with little to do otherwise does too late. The
    driver still refers to its latest job, so there is a small one first.
    """
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame, stored once in the shared folder and read back: it survives lost executors."""
    path = fresh_folder(frame.sparkSession, purpose)
    for folders in _collected:
        folders.append(path)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def with_maybe(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Add ``maybe``: false only for rows whose ``key`` is not among those of ``keys``.

    Rows that certainly aren't concerned then need no shuffle.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << TABLE_BITS)) + 1
    found = keys.select(place.alias("_p")).groupBy(F.expr("bitmap_bucket_number(_p)").alias("_bucket"))
    bits = found.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_p))").alias("_bits"))
    # at most 256 rows of 4 kB
    joined = rows.withColumn("_p", place).withColumn("_bucket", F.expr("bitmap_bucket_number(_p)")).join(F.broadcast(bits), "_bucket", "left")
    byte = "cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_p) div 8 AS int) + 1, 1)), 16, 10) AS int)"
    maybe = F.expr(f"coalesce(getbit({byte}, cast(bitmap_bit_position(_p) % 8 AS int)) = 1, false)")
    return joined.withColumn("maybe", maybe).drop("_p", "_bucket", "_bits")


def without(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is not among those of ``keys``; rows without a key stay.

    Only rows that may be concerned are shuffled.
    """
    held = rows.select(F.col(key).alias("_key"), F.struct("*").alias("_row"))
    flagged = with_maybe(held, "_key", keys.select(F.col(key).alias("_key")))
    checked = flagged.where("maybe").join(keys.select(F.col(key).alias("_key")).distinct(), "_key", "left_anti")
    return checked.select("_row.*").union(flagged.where("NOT maybe").select("_row.*"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def payloads(column: pa.Array) -> list[bytes | None]:
    """The bytes of a text or binary column."""
    return column.cast(pa.binary()).to_pylist()


def decoded(data: bytes | None) -> str:
    """Text of UTF-8 bytes; null is empty, a broken sequence becomes U+FFFD."""
    return data.decode("utf-8", "replace") if data else ""


def chunks(texts: Sequence[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``limit`` bytes together, with the index of the first."""
    first, size, group = 0, 0, []
    for i, text in enumerate(texts):
        if group and size + len(text) > limit:
            yield first, group
            first, size, group = i, 0, []
        group.append(text)
        size += len(text)
    if group:
        yield first, group


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )
