"""Documents split to pages, and pages put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.gate import number_ranges


def is_chosen(page_no: Column, chosen: set[int] | None) -> Column:
    """Whether a page number (from 1) is chosen; all are without a choice."""
    if chosen is None:
        return F.lit(True)
    ranges = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for low, high in number_ranges(chosen)]).cast("array<struct<low:int,high:int>>")
    return F.exists(ranges, lambda r: page_no.between(r["low"], r["high"]))


def split_pages(docs: DataFrame, chosen: set[int] | None = None) -> DataFrame:
    """(doc_id, page_index, body, input_bytes): a row for each chosen page of ``docs`` (doc_id, pages).

    ``pages`` is an array of a page's text or bytes each, in order; null and
    empty arrays have no pages. Nothing is shuffled.
    """
    rows = docs.select("doc_id", F.posexplode("pages").alias("page_index", "body")).filter(is_chosen(F.col("page_index") + 1, chosen))
    return rows.withColumn("input_bytes", F.coalesce(F.octet_length("body"), F.lit(0)).cast("long"))


def merge_pages(pages: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(doc_id, pages, page_count, error_code): pages (doc_id, page_index, body) put together in order.

    ``expected`` (doc_id, page_index) lists the pages that were chosen: a document
    that has others, fewer, or one twice has an error code and no pages. A
    document is one row by definition, so its pages meet in one task.
    """
    listed = F.array_sort(F.collect_list(F.struct("page_index", "body")))
    made = pages.groupBy("doc_id").agg(listed.alias("list"))
    if expected is None:
        joined = made.withColumn("error_code", F.lit(None).cast("string"))
    else:
        wanted = expected.groupBy("doc_id").agg(F.array_sort(F.collect_list("page_index")).alias("wanted"))
        same = F.coalesce(F.col("wanted") == F.transform("list", lambda x: x["page_index"]), F.lit(False))
        joined = made.join(wanted, "doc_id", "full").withColumn("error_code", F.when(~same, "E-ENGINE-ERROR"))
    bodies = F.when(F.col("error_code").isNull(), F.transform("list", lambda x: x["body"]))
    return joined.select("doc_id", bodies.alias("pages"), F.coalesce(F.size("list"), F.lit(0)).cast("long").alias("page_count"), "error_code")
