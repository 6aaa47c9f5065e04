"""Session settings the plans rely on, and the shared folder they write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_FOLDER = "controlweave.local.folder"

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where the next operator then needs a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # unreadable text in a rule is an error, not a NULL
    "spark.sql.ansi.enabled": "true",
}


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; sizes (memory, partitions) stay the cluster's own."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the one that
    ``setCheckpointDir`` named.

    Only a local session without either gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(LOCAL_FOLDER, None)
    if folder:
        return folder.rstrip("/")
    chosen = spark.sparkContext.getCheckpointDir()
    if chosen:
        return chosen.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="controlweave-")
    spark.sparkContext.setCheckpointDir(folder)
    spark.conf.set(LOCAL_FOLDER, folder)
    return folder


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
