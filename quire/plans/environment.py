"""What the engine runs on."""

from __future__ import annotations

import platform
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import meets_floor

#: Least versions of what results depend on.
FLOORS = {"python": "3.10", "spark": "4.0", "pyarrow": "15.0", "numpy": "1.26"}


def environment_report(spark: SparkSession) -> DataFrame:
    """(component, version, floor, ok) of the driver's parts."""
    import numpy
    import pyarrow

    found = {"python": platform.python_version(), "spark": spark.version, "pyarrow": pyarrow.__version__, "numpy": numpy.__version__}
    rows = spark.createDataFrame([(k, v, FLOORS[k]) for k, v in found.items()], "component string, version string, floor string")
    return rows.withColumn("ok", meets_floor(F.col("version"), F.col("floor")))


def main() -> int:
    spark = SparkSession.builder.getOrCreate()
    rows = environment_report(spark)
    rows.show(truncate=False)
    return 0 if rows.filter("NOT ok").isEmpty() else 17


if __name__ == "__main__":
    sys.exit(main())
