"""Readers of files, manifests and build records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import known_or
from quire.options import MEBIBYTE, Options
from quire.sources.schemas import BUILD_INFO, MANIFEST


def read_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of whole files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def within_size(files: DataFrame, options: Options) -> DataFrame:
    """Files up to the size limit; the filter on ``length`` is pushed to the reader, which opens no others."""
    return files.filter(F.col("length") <= int(options.max_input_mb * MEBIBYTE))


def oversize(files: DataFrame, options: Options) -> DataFrame:
    """Path and size of files over the limit; contents are not read."""
    return files.filter(F.col("length") > int(options.max_input_mb * MEBIBYTE)).select("path", "length")


def read_manifest(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """(name, url, sha256, tags) of a corpus manifest, those with ``tag`` if given."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").json(path).select(F.inline("fixtures"))
    return rows if tag is None else rows.filter(F.array_contains("tags", tag))


def checked(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows with ``state``: ok, missing, or changed where a file's SHA-256 differs."""
    sums = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.lower("sha256"), "ok").otherwise("changed")
    return manifest.join(sums, "name", "left").withColumn("state", state)


def build_info(record: Column) -> Column:
    """A build record's fields, '?' where it is unreadable, empty or 'unknown' (X10)."""
    parsed = F.from_json(record, BUILD_INFO)
    names = [x.split()[0] for x in BUILD_INFO.split(", ")]
    return F.struct(*[known_or(parsed[n], F.lit("?")).alias(n) for n in names])
