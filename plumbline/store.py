"""Cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds a table has to take to be written before the files that its exchanges leave behind are asked for.
LONG = 2.0
_made: dict[str, SparkSession] = {}
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a temporary one, which a local master alone can share with its executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return _local[sc.applicationId]


def stored(df: DataFrame, *by: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: it survives lost executors and is computed once. by: columns by whose values its files are parted.

    Spark deletes the files of finished exchanges when the driver collects what
    refers to them, by itself only every half hour or when its heap is full;
    after long writes it is asked to.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/plumbline/{uuid.uuid4().hex}"
    began = time.monotonic()
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    _made[path] = spark
    if time.monotonic() - began > LONG:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        spark = _made.pop(path, None)
        if spark is not None:
            _delete(spark, path)


def release_part(table: DataFrame, part: str) -> None:
    """Deletes the files of one part (`column=value`) of a stored table, which nothing reads any more."""
    path = getattr(table, "_stored_at", None)
    if path in _made:
        _delete(_made[path], f"{path}/{part}")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        try:
            _delete(spark, path)
        except Exception:  # the session is over: the files go with the checkpoint folder
            return
