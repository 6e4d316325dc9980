"""Sessions, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

from quire.plans.limits import with_worker_settings

_shipped: set[str] = set()


#: Bytes of an Arrow batch on its way to Python: rows hold whole texts, so rows alone bound nothing.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, for its Arrow functions, and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="quire-ship-"), "quire.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("quire", os.path.relpath(path, root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", worker_memory: int = 0) -> SparkSession:
    """A local session with the settings the tests and the benchmark use; Python workers may hold ``worker_memory`` bytes, if given."""
    spark = (
        with_worker_settings(SparkSession.builder, worker_memory)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
