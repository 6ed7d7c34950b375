"""Session settings and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Results depend on the first one; the others are about speed and memory.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # Spark checks the size of the materialized tables against this before it broadcasts one.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


_SCOPE: ContextVar[str | None] = ContextVar("vespera_scratch_scope", default=None)


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the library's settings to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by all executors for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    A machine-local folder is used only when Spark itself runs on one machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vespera-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_SCOPE.get() or scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all it holds, wherever Spark's file systems reach; False if there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Free the intermediate tables that a job writes, once its result has been consumed.

    Everything that ``materialize`` and ``scratch_path`` give inside the block lies in one folder, which is deleted when
    the block is left, also by an error. Jobs return lazy results that still read these tables: write or collect them
    inside. Blocks may be nested; an inner one frees only its own. Outside of any block tables stay until the cluster
    clears its folder.
    """
    path = f"{_SCOPE.get() or scratch_dir(spark)}/job-{uuid.uuid4().hex}"
    outer = _SCOPE.set(path)
    try:
        yield path
    finally:
        _SCOPE.reset(outer)
        delete_folder(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back.

    Cuts the lineage, survives the loss of executors, and gives later joins the real size, so that Spark broadcasts
    the table only when it is under ``spark.sql.autoBroadcastJoinThreshold``. ``scratch_scope`` frees it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
