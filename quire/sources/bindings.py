"""Test tables in the shape of the operators' schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a document, an order with items a page, an item a stream."""
    length = F.col("l_extendedprice").cast("long")
    kind = F.when(F.col("l_returnflag") == "R", "Image").when(F.col("l_linenumber") == 1, "Content").otherwise("Form")
    streams = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_key"), kind.alias("kind"), length.alias("length"))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("length"))), F.lit(0))
    sums = streams.groupBy("page_key").agg(of("Content").alias("content_bytes"), of("Image").alias("image_bytes"), of("Form").alias("other_bytes"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_key"), F.col("o_custkey").alias("doc_id"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_key")) - 1
    return orders.join(sums, "page_key").select("doc_id", index.alias("page_index"), "page_key", "content_bytes", "image_bytes", "other_bytes")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, a hundred ids of a source making one, with an output text that some pages change."""
    text, key = F.col("text"), F.col("doc_id")
    changed = (
        F.when(key % 7 == 0, F.translate(text, "6", "8"))
        .when(key % 11 == 0, F.regexp_replace(text, r"(\d)\.(\d)", "$1$2"))
        .when(key % 13 == 0, F.substr(text, F.lit(1), F.floor(F.length(text) * 0.9).cast("int")))
        .otherwise(text)
    )
    doc = F.concat(F.col("source"), F.lit("-"), F.floor(key / 100).cast("string"))
    index = F.row_number().over(Window.partitionBy("doc").orderBy("doc_id")) - 1
    rows = table(spark, sf_dir, "documents").select(doc.alias("doc"), "doc_id", text.alias("input_text"), changed.alias("output_text"))
    return rows.select("doc", index.alias("page_index"), "doc_id", "input_text", "output_text")


def rasters(spark: SparkSession, sf_dir: str, profiled: bool = True) -> DataFrame:
    """Embeddings as 8 x 8 grey rasters, lightened by profile."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    low, high = F.array_min("v"), F.array_max("v")
    grey = rows.withColumns({"low": low, "high": high}).select(
        "vec_id", F.transform("v", lambda x: F.floor(255 * (x - F.col("low")) / (F.col("high") - F.col("low"))).cast("int")).alias("px")
    )
    if profiled:
        kind = F.col("vec_id") % 4
        light = lambda floor: F.transform("px", lambda x: F.when(x >= floor, 255).otherwise(x))
        grey = grey.withColumn("px", F.when(kind == 1, light(64)).when(kind == 2, light(0)).when(kind == 3, light(32)).otherwise(F.col("px")))
    return grey.select("vec_id", F.lit(8).alias("w"), F.lit(8).alias("h"), "px")


def color_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three embeddings in a row as the channels of one raster; the first stands for missing ones."""
    grey = rasters(spark, sf_dir)
    channel = lambda k, name: grey.filter(F.col("vec_id") % 3 == k).select((F.col("vec_id") - k).alias("vec_id"), F.col("px").alias(name))
    rows = channel(0, "r").join(channel(1, "g"), "vec_id", "left").join(channel(2, "b"), "vec_id", "left")
    return rows.select("vec_id", F.lit(8).alias("w"), F.lit(8).alias("h"), "r", F.coalesce("g", "r").alias("g"), F.coalesce("b", "r").alias("b"))


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in time as glyphs: an hour is a unit of width, so a pause is a gap."""
    place = Window.partitionBy("user_id").orderBy("ts", "event_id")
    left = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("page_id"), (F.row_number().over(place) - 1).alias("i"), F.col("event_type").alias("ch"),
        left.alias("left"), F.lit(0.0).alias("bottom"), left.alias("right"), F.lit(10.0).alias("top"), F.col("value"),
    )


def object_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a heap: node n hangs below n div 2."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), n.alias("child"), F.col("event_type").alias("key"))
    return rows.select("doc_id", F.floor(F.col("child") / 2).alias("parent"), F.col("child").cast("long").alias("child"), "key", F.lit(True).alias("is_indirect"))


def triage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as triaged inputs; residues of the key set the flags so that every gate is met."""
    key = F.col("c_custkey")
    certified = key % 19 == 0
    return table(spark, sf_dir, "customer").select(
        key.alias("doc_id"),
        F.col("c_mktsegment").alias("profile"),
        (key % 17 == 0).alias("is_encrypted"),
        ((key % 7 == 0) | certified).alias("is_signed"),
        certified.alias("is_certified"),
        F.pmod(key * 37, F.lit(12_000)).alias("pages"),
        (F.pmod(key * 7919, F.lit(400)) * (1 << 20)).alias("bytes"),
        F.when(key % 23 == 0, 15_000.0).otherwise(792.0).alias("axis_pt"),
    )
