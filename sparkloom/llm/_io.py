"""Shared plumbing: whole-table reads, stashed tables in the shared folder."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that shuffle files go when the query that wrote them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_stashed: dict[str, SparkSession] = {}


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold a few MB of text, where the session has Spark's own bounds, which are of 64 MB."""
    for key, own, few in (("maxBytesPerBatch", "67108864b", "4194304b"), ("maxRecordsPerBatch", "10000", "2000")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == own:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", few)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, in local mode only, one below the warehouse."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stash"


def write(df: DataFrame, path: str) -> None:
    """Write df as Parquet; the shuffle files of its plan go with the end of the write."""
    small_batches(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: the lineage ends there and lost executors
    cost only a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    _stashed[path] = spark
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that no plan reads any more."""
    for t in tables:
        delete(t.sparkSession, t.stash_path)


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)
    _stashed.pop(path, None)


@atexit.register
def _clean() -> None:
    for path, spark in list(_stashed.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  that session may be gone already, others may not
            continue
