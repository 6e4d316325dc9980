"""Which pages are worth processing, and which documents pass through whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.options import Options


def image_fraction(content: Column, image: Column, other: Column) -> Column:
    """Image bytes over a page's bytes."""
    return image / F.greatest(F.lit(1), content + image + other)


def page_bytes(xobjects: DataFrame) -> DataFrame:
    """Pages from their streams: an unreadable length counts as 0."""
    n = F.coalesce(F.col("length").try_cast("long"), F.lit(0))
    of = lambda k: F.sum(F.when(F.col("kind") == k, n).otherwise(0))
    return xobjects.groupBy("doc_id", "page_index").agg(of("Content").alias("content_bytes"), of("Image").alias("image_bytes"), of("Form").alias("other_bytes"))


def score_pages(pages: DataFrame, options: Options) -> DataFrame:
    """``pages`` with fraction and worthy; a page without a fraction is worthy (F16)."""
    fraction = image_fraction(F.col("content_bytes"), F.col("image_bytes"), F.col("other_bytes"))
    worthy = F.coalesce(F.col("fraction") >= options.min_image_byte_fraction, F.lit(True))
    return pages.withColumn("fraction", fraction).withColumn("worthy", F.lit(True) if options.forces_all_pages else worthy)


def gate_pages(scored: DataFrame) -> DataFrame:
    """``scored`` with whole_doc (no page is worthy) and the page's route.

    A window by document keeps the rows in one shuffle, which later steps by
    document reuse.
    """
    passes = ~F.bool_or("worthy").over(Window.partitionBy("doc_id"))
    route = F.when(F.col("whole_doc"), "passthrough").when(F.col("worthy"), "process").otherwise("verbatim")
    return scored.withColumn("whole_doc", passes).withColumn("route", route)


def complete_flags(spine: DataFrame, flags: DataFrame) -> DataFrame:
    """Flags for exactly the pages of ``spine``: missing ones are worthy, others are dropped."""
    return spine.join(flags.select("doc_id", "page_index", "worthy"), ["doc_id", "page_index"], "left").withColumn("worthy", F.coalesce("worthy", F.lit(True)))


def doc_gate(gated: DataFrame) -> DataFrame:
    """A row for each document: its route counts, verbatim pages in order, and warning."""
    verbatim = F.count_if(F.col("route") == "verbatim")
    rows = gated.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("route") == "process").alias("processed"),
        verbatim.alias("verbatim"),
        F.bool_and("whole_doc").alias("whole_doc"),
        F.array_sort(F.collect_list(F.when(F.col("route") == "verbatim", F.col("page_index")))).alias("verbatim_pages"),
    )
    some = (F.col("verbatim") > 0) & (F.col("verbatim") < F.col("pages"))
    warning = F.when(F.col("whole_doc"), "passthrough-no-image-content").when(some, F.format_string("pages-skipped-verbatim-%d", F.col("verbatim")))
    status = F.when(F.col("whole_doc"), "passthrough").when(F.col("verbatim") > 0, "partial").otherwise("full")
    return rows.withColumn("warning", warning).withColumn("status", status)


def select_pages(pages: DataFrame, chosen: set[int]) -> DataFrame:
    """Pages whose number (from 1) is chosen, in the table's own order."""
    wanted = _numbers(pages, chosen)
    return pages.join(F.broadcast(wanted), pages["page_index"] + 1 == wanted["page_no"], "left_semi")


def missing_pages(pages: DataFrame, chosen: set[int]) -> DataFrame:
    """(doc_id, page_no) of chosen numbers beyond a document's pages."""
    sizes = pages.groupBy("doc_id").agg((F.max("page_index") + 1).alias("pages"))
    ranges = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for low, high in number_ranges(chosen)]).cast("array<struct<low:int,high:int>>")
    beyond = sizes.select("doc_id", "pages", F.inline(F.filter(ranges, lambda r: r["high"] > F.col("pages"))))
    return beyond.select("doc_id", F.explode(F.sequence(F.greatest("low", F.col("pages") + 1), "high")).alias("page_no"))


def number_ranges(chosen: set[int]) -> list[tuple[int, int]]:
    """Numbers as ranges without gaps."""
    out: list[tuple[int, int]] = []
    for n in sorted(chosen):
        if out and out[-1][1] == n - 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def _numbers(df: DataFrame, chosen: set[int]) -> DataFrame:
    """At most a million numbers: the bound of a page spec."""
    return df.sparkSession.createDataFrame([(n,) for n in sorted(chosen)], "page_no int")
