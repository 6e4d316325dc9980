"""Token ids in Parquet list columns, read back selectively.

Ids go to a list column whose pages are delta-encoded (values of the 2.0 writer)
without a dictionary, doc_id and counts beside it; row groups and pages have set
sizes, and the writer adds page indexes. Reading the metadata columns, or the ids
of a range of documents, touches those column chunks and pages only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.tokens import byte_batches, encode_words, shared_encoder, tokenizer_path
from quire.plans.limits import tidy

#: Bytes of a partition's input, and of a row group and a page of a file.
PARTITION_BYTES = 64 << 20
#: More than any table holds: the planner's word for not knowing.
UNKNOWN_BYTES = 1 << 60
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids list<int>) in the order of ``docs``; a null text has only the end id."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        encoder = shared_encoder(path)
        for batch in batches:
            for some in byte_batches(batch, 1):
                offsets, ids = encode_words(some.column(1), encoder)
                if end_id is not None:
                    ids = np.insert(ids, offsets[1:], end_id)
                    offsets = offsets + np.arange(len(offsets))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), lists], ["doc_id", "ids"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidy(encode), f"doc_id {id_type}, ids array<int>")


def partition_count(docs: DataFrame, id_col: str, text_col: str) -> int:
    """Partitions of about ``PARTITION_BYTES``, and as many as shuffles have at least.

    The planner knows the bytes of files; where it doesn't know its input's, the texts' are summed.
    """
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > UNKNOWN_BYTES:
        size = docs.select(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES), 1)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents' ids to ``path`` in ascending order of their ids.

    File k holds smaller ids than file k + 1, and each file is sorted. Texts are
    dealt by range of id before they are encoded, so every text is encoded
    once. Rows that share an id stand by text and repeated rows all stay; a null id comes first, and a
    null or empty text has only the end id. An empty table gives a table without rows. Texts of
    any length are cut at safe boundaries; a row is one list, so it must fit in memory.
    """
    n = partitions or partition_count(docs, id_col, text_col)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = named.repartitionByRange(n, *by).sortWithinPartitions(*by, "text")
    encoded = encode_documents(ordered, tokenizer, end_id)
    (
        encoded.select("doc_id", F.spark_partition_id().alias("file"), F.monotonically_increasing_id().alias("place"), F.size("ids").cast("long").alias("n_tokens"), "ids")
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", 2000)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.columnindex.truncate.length", 64)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, place, n_tokens, ids_crc32): CRC-32 of the ids as little-endian uint32."""

    def digest(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            rest = [batch.column(c) for c in ("doc_id", "file", "place")]
            counts = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*rest, counts, pa.array(crcs, pa.int64())], ["doc_id", "file", "place", "n_tokens", "ids_crc32"])

    stored = spark.read.parquet(path).select("doc_id", "file", "place", "ids")
    id_type = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(digest, f"doc_id {id_type}, file int, place long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (with file, place, n_tokens) with ``start``, the ids of all documents before.

    Sums of whole files come from the metadata columns alone; the running sum
    over files handles one row per file, the one inside a file only its rows.
    """
    meta = rows.sparkSession.read.parquet(path).select("file", "n_tokens")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = meta.groupBy("file").agg(F.sum("n_tokens").alias("__n")).select("file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(files, "file").withColumn("start", F.col("__base") + F.col("__local")).drop("__base", "__local")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, ids) of the documents with low <= doc_id <= high, by page index.

    Null ids are read only without bounds. Rows repeat as they were written, in no order.
    """
    rows = spark.read.parquet(path).select("doc_id", "ids")
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    return rows if high is None else rows.filter(F.col("doc_id") <= high)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at ``path``, repeated rows and null ids too."""
    return with_starts(read_digests(spark, path), path).select("doc_id", "start", "n_tokens", "ids_crc32")
