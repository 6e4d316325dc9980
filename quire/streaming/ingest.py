"""Documents as they arrive: an extension, since the batch semantics have no streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.options import Options
from quire.plans import pipeline

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_documents(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """New files below ``path`` as rows, a bounded number each time."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", per_trigger).load(path)


def once_per_content(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """Files whose content did not come within ``delay``; older state is dropped."""
    keyed = files.withColumn("content_sha256", F.sha2("content", 256))
    return keyed.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["content_sha256"])


def run_batches(files: DataFrame, batch: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch plan to what arrives and append its rows as Parquet.

    Each batch goes to a folder named by its number, so a batch that runs again
    after a failure replaces its own rows.
    """

    def write(rows: DataFrame, number: int) -> None:
        batch(rows).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_reports(files: DataFrame, analyse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], options: Options, output: str, checkpoint: str) -> StreamingQuery:
    """The whole batch plan over files as they come: a report row for every document (S3).

    ``analyse`` makes the tables of documents and pages that ``pipeline.run`` reads of a batch of
    files; it is where the native parser plugs in. A batch is read whole, processed and written once.
    """
    return run_batches(files, lambda rows: pipeline.run(*analyse(rows), options), output, checkpoint)
