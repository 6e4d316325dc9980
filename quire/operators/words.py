"""Words from glyphs, and geometry of their boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.schemas import GLYPH_PROBES, conforming

#: A baseline jump or a gap beyond these shares of the height breaks a word.
LINE_FACTOR = 0.5
GAP_FACTOR = 0.6


def words(glyphs: DataFrame, line: float = LINE_FACTOR, gap: float = GAP_FACTOR, carry: list[str] | None = None) -> DataFrame:
    """Words of ``glyphs`` (page_id, i, ch, left, bottom, right, top) with their boxes.

    Glyphs stand in the order of ``i``. A word ends at white space, where the
    baseline moves by more than ``line`` of the larger height, or where the gap is
    more than ``gap`` of it. Breaks are flags from the glyph before, their running
    sum numbers the words, and a word's columns in ``carry`` are its first glyph's.
    """
    order = Window.partitionBy("page_id").orderBy("i")
    seen = F.lag(F.struct("bottom", "right", (F.col("top") - F.col("bottom")).alias("height"), "space"), 1).over(order)
    rows = glyphs.withColumn("space", F.coalesce(F.col("ch").rlike(r"(?U)^\s*$"), F.lit(True))).withColumn("__p", seen)
    height = F.greatest(F.col("__p.height"), F.col("top") - F.col("bottom"))
    jump = (F.col("__p.bottom") >= 0) & (F.abs(F.col("bottom") - F.col("__p.bottom")) > line * height)
    wide = (F.col("__p.right") >= 0) & (F.col("left") - F.col("__p.right") > gap * height)
    breaks = F.when(F.col("__p").isNull() | F.col("__p.space") | F.col("space") | jump | wide, 1).otherwise(0)
    numbered = rows.withColumn("__island", F.sum(breaks).over(order)).filter(~F.col("space"))
    first = [F.min_by(c, "i").alias(c) for c in carry or []]
    made = numbered.groupBy("page_id", "__island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "ch"))), lambda x: x["ch"]), "").alias("text"),
        F.count(F.lit(1)).alias("glyphs"), F.min("i").alias("first_i"),
        F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"), *first,
    )
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("first_i")) - 1
    return made.withColumn("word_no", number).drop("__island")


def glyph_styles(probes: DataFrame, page_height: Column, sy: Column) -> DataFrame:
    """(page_id, i, style): what is known of each glyph's look, field by field.

    ``probes`` has ``GLYPH_PROBES``, what a native text layer says of a glyph, unread. Fields don't depend on one
    another: an empty name, a number that isn't one or isn't above 0, fewer than three colours or a matrix without its six
    numbers make that field null and no other. The baseline is counted in pixels from the top.
    """
    above = lambda c, kind: F.when(F.col(c).try_cast(kind) > 0, F.col(c).try_cast(kind))
    known = ~F.exists(F.slice("fill", 1, 3), lambda x: x.isNull()) & (F.size("fill") >= 3)
    style = F.struct(
        F.nullif(F.col("font"), F.lit("")).alias("font_name"), F.nullif(F.col("flags").try_cast("int"), F.lit(0)).alias("font_flags"), above("size", "double").alias("font_size_pt"), above("weight", "int").alias("font_weight"),
        F.when(known, F.slice("fill", 1, 3)).alias("color"), ((page_height - F.when(F.size("matrix") >= 6, F.get("matrix", F.lit(5)))) * sy).alias("baseline_y"),
    )
    return conforming(probes, GLYPH_PROBES).select("page_id", "i", style.alias("style"))


def recognized(boxes: DataFrame) -> DataFrame:
    """OCR boxes without blank ones, confidence -1 where unreadable, else within 0 to 100."""
    confidence = F.col("confidence").try_cast("double")
    bounded = F.when(confidence.isNull() | F.isnan(confidence), -1.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), confidence)))
    return boxes.filter(F.regexp_replace("text", r"(?U)\s+", "") != "").withColumn("confidence", bounded)


def page_text(boxes: DataFrame) -> DataFrame:
    """(page_id, text): a page's words in order, joined by one blank."""
    ordered = F.array_sort(F.collect_list(F.struct("word_no", "text")))
    return boxes.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))
