"""Tables that cut lineage, kept in the folder the cluster shares.

``spark.checkpoint.dir`` names that folder. It is read from the session; only a
local session without the setting gets a folder of its own, because there the
driver and the executors are one process.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_created: list[str] = []
#: Tables after which the driver lets go of plans, broadcasts and shuffles that nothing reads any more.
TABLES_TO_TIDY = 8


def shared_root(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    global _local_root
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="quire-")
    return _local_root


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root, removed when the application ends."""
    path = f"{shared_root(spark)}/quire/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    _created.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result survives lost executors, is computed once however often it is
    used, and has a known size, so the planner can choose joins from figures.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if len(_created) % TABLES_TO_TIDY == 0:
        let_go(spark)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._folder = path
    return stored


def let_go(spark: SparkSession) -> None:
    """Let go of plans, broadcasts and shuffle files that nothing reads any more, which else stay until the driver's memory is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and all below it; a folder that isn't there is no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing reads any more."""
    delete(df.sparkSession, df._folder)


def created() -> int:
    """How many folders this process has asked for so far."""
    return len(_created)


def drop_since(start: int, keep: DataFrame) -> None:
    """Delete the folders asked for since ``start``, but for that of a materialized table that is still read."""
    for path in _created[start:]:
        if path != keep._folder:
            delete(keep.sparkSession, path)
