"""Pages dealt to chunks of a bounded size, and the chunks' files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import naming
from quire.storage import delete, materialize

#: The names of written chunks, beside their files; Spark's readers pass it over.
_NAMES = "_chunks"
#: Rows of chunks' files that are handed on at once.
_ROWS = 10_000


def assign_chunks(pages: DataFrame, max_bytes: int) -> DataFrame:
    """``pages`` (doc_id, page_index, cost) with chunk_no from 1.

    Pages are taken in order and a new chunk begins when the next one would pass
    the cap, so a document within the cap or of one page is one chunk, and a page
    over the cap stands alone. An unknown cost counts as 0. Each step depends on
    the one before, so a document is one fold, over its rows as they come sorted
    from one shuffle, with a few numbers of state a task.
    """
    if max_bytes <= 0:
        raise ValueError("max_bytes must be above 0")

    def fold(batches):
        import pyarrow as pa

        doc, size, chunk, empty, begun = None, 0, 0, True, False
        for batch in batches:
            out = []
            for key, cost in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or key != doc:
                    doc, size, chunk, empty, begun = key, 0, 1, True, True
                if not empty and size + cost > max_bytes:
                    chunk, size = chunk + 1, 0
                size, empty = size + cost, False
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], ["doc_id", "page_index", "cost", "chunk_no"])

    own = pages.select("doc_id", F.col("page_index").cast("int").alias("page_index"), F.coalesce(F.col("cost").cast("long"), F.lit(0)).alias("cost"))
    ordered = own.repartition("doc_id").sortWithinPartitions("doc_id", "page_index")
    id_type = own.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(fold, f"doc_id {id_type}, page_index int, cost bigint, chunk_no int")


def chunk_table(assigned: DataFrame, max_bytes: int, prefix: str = "doc", ext: str = ".pdf") -> DataFrame:
    """A row for each chunk: pages, bytes, file name, and whether it passes the cap (K3, K5)."""
    chunks = assigned.groupBy("doc_id", "chunk_no").agg(F.count(F.lit(1)).alias("pages"), F.sum("cost").alias("bytes"), F.min("page_index").alias("first_page"))
    count = F.max("chunk_no").over(Window.partitionBy("doc_id"))
    base = F.concat(F.lit(prefix), F.col("doc_id").cast("string"))
    return chunks.withColumn("chunks", count).withColumn("name", naming.chunk_name(base, F.col("chunk_no"), F.col("chunks"), F.lit(ext))).withColumn("oversize", F.col("bytes") > max_bytes)


def stale_chunks(existing: DataFrame, counts: DataFrame) -> DataFrame:
    """Names in ``existing`` (doc_id, base, ext, name) numbered past the document's chunks in ``counts`` (K4)."""
    numbered = existing.withColumn("index", naming.stale_index(F.col("name"), F.col("base"), F.col("ext")))
    return numbered.join(counts, "doc_id").filter(F.col("index") > F.col("chunks")).select("doc_id", "name")


def write_chunks(assigned: DataFrame, path: str, max_bytes: int, prefix: str = "doc", ext: str = ".pdf") -> DataFrame:
    """One Parquet file for each chunk of one document, that bears the chunk's name (K2); returns the chunk table.

    Rows come with their chunk's name; a chunk is one task's, so it is one file, its pages in order. Below a path of
    the file system the tasks write ``_partial`` files and rename them, so no chunk is ever partial (K1) and a
    task that runs twice leaves the same chunks; the names are kept in ``_chunks``, written last. In another store Spark
    writes the file into a folder of the chunk's name; its committer moves finished files into place one by one on the
    driver, which takes long for many chunks.
    """
    pages = materialize(assigned, "chunk-pages")
    chunks = materialize(chunk_table(pages, max_bytes, prefix, ext), "chunks")
    named = pages.join(chunks.select("doc_id", "chunk_no", "name"), ["doc_id", "chunk_no"])
    ordered = named.repartition("doc_id", "chunk_no").sortWithinPartitions("name", "page_index")
    folder = _file_folder(pages.sparkSession, path)
    if folder is None:
        ordered.write.mode("overwrite").partitionBy("name").parquet(path)
        return chunks
    delete(pages.sparkSession, path)
    os.makedirs(folder)
    written = ordered.select("name", "doc_id", "chunk_no", "page_index", "cost").mapInArrow(_file_writer(folder), "name string")
    written.write.parquet(f"{path}/{_NAMES}")
    return chunks


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(name, doc_id, chunk_no, page_index, cost, file) of the chunks' pages; a chunk whose file is missing is an error."""
    folder = _file_folder(spark, path)
    if folder is None:
        return spark.read.parquet(path).select("name", "doc_id", "chunk_no", "page_index", "cost", F.input_file_name().alias("file"))
    names = spark.read.schema("name string").parquet(f"{path}/{_NAMES}")
    # the first file tells the type of the ids
    first = names.head()
    ids = spark.read.parquet(f"{path}/{first['name']}").schema["doc_id"].dataType.simpleString() if first else "bigint"
    return names.mapInArrow(_file_reader(folder), f"name string, doc_id {ids}, chunk_no int, page_index int, cost bigint, file string")


def _file_folder(spark: SparkSession, path: str) -> str | None:
    """The folder that ``path`` names in the file system; None in another store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(where).toUri().getPath() if store.getUri().getScheme() == "file" else None


def _file_writer(folder: str):
    """An Arrow function over rows that come chunk by chunk (name first): writes the files, gives their names."""

    def write(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        name, out, partial = None, None, f"{folder}/_partial-{uuid.uuid4().hex}"

        def close():
            out.close()
            os.replace(partial, f"{folder}/{name}")

        for batch in batches:
            names, rows, done = batch.column(0), pa.table(batch.columns[1:], names=batch.schema.names[1:]), []
            starts = [0, *(pc.indices_nonzero(pc.not_equal(names[1:], names[:-1])).to_numpy() + 1).tolist(), len(names)] if len(names) else []
            for start, stop in zip(starts, starts[1:], strict=False):
                if names[start].as_py() != name:
                    if out is not None:
                        close()
                        done.append(name)
                    name = names[start].as_py()
                    out = pq.ParquetWriter(partial, rows.schema, use_dictionary=False, write_statistics=False, store_schema=False)
                out.write_table(rows.slice(start, stop - start))
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["name"])
        if out is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], ["name"])

    return write


def _file_reader(folder: str):
    """An Arrow function over names: the rows of their files, each file's row groups one by one."""

    def read(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        held, rows = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with pq.ParquetFile(f"{folder}/{name}") as file:
                    for k in range(file.num_row_groups):
                        part = file.read_row_group(k, use_threads=False)
                        same = lambda value, n=part.num_rows: pa.repeat(pa.scalar(value), n)
                        held.append(pa.table([same(name), *part.columns, same(f"file://{folder}/{name}")], ["name", *part.column_names, "file"]))
                        rows += part.num_rows
                        if rows >= _ROWS:
                            yield from pa.concat_tables(held).combine_chunks().to_batches()
                            held, rows = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return read
