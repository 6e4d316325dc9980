"""What is done with a page, and the thresholds its result must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.geometry import target_dimension
from quire.options import ANOMALY_RATIO, LEVENSHTEIN_CEILING, SSIM_FLOOR, TILE_FLOOR, Options

#: Fixed values of the page classes.
MASK_FLOOR = 0.05
LIGHT_VALUE = 230
LIGHT_FRACTION = 0.80
STRATEGIES = ("text_only", "photo_only", "mixed", "already_optimized")


def fraction_where(px: Column, test) -> Column:
    """Share of pixels that pass ``test``; 0 of none."""
    return F.size(F.filter(px, test)) / F.greatest(F.lit(1), F.size(px))


def light_fraction(px: Column) -> Column:
    return fraction_where(px, lambda x: x >= LIGHT_VALUE)


def classify_page(coverage: Column, light: Column) -> Column:
    """photo_only with next to no ink, text_only on mostly light paper, else mixed."""
    return F.when(coverage <= MASK_FLOOR, "photo_only").when(light >= LIGHT_FRACTION, "text_only").otherwise("mixed")


def demote_color(strategy: Column, monochrome: Column, force: bool) -> Column:
    """(strategy, demoted): text pages with colour keep it by becoming mixed."""
    demoted = (strategy == "text_only") & ~monochrome & ~F.lit(force)
    return F.struct(F.when(demoted, "mixed").otherwise(strategy).alias("strategy"), demoted.alias("demoted"))


def text_source(has_native: Column, decent: Column, options: Options) -> Column:
    """Where a page's text layer comes from: none, ocr or native."""
    if options.strip_text_layer:
        return F.lit("none")
    if options.re_ocr:
        return F.lit("ocr")
    return F.when(has_native & decent, "native").otherwise("ocr" if options.ocr else "none")


def ground_truth(native: Column, recognized: Column) -> Column:
    """The native text unless blank, else the recognized one."""
    return F.coalesce(F.when(F.regexp_replace(native, r"(?U)\s+", "") != "", native), recognized)


def is_anomalous(width: Column, height: Column, output_bytes: Column, strategy: Column) -> Column:
    """Whether an output is suspiciously small for its raster."""
    return (pixel_ratio(width, height, output_bytes) > ANOMALY_RATIO) & (strategy != "text_only")


def pixel_ratio(width: Column, height: Column, output_bytes: Column) -> Column:
    """Raw bytes of a page's raster over its output's bytes."""
    return width * height * 3 / F.greatest(F.lit(1), output_bytes)


def compose_plan(strategy: Column, monochrome: Column, flags: Column, width_pt: Column, height_pt: Column, options: Options) -> Column:
    """(background, color_mode, codec, mask, width_px, height_px): what a page is composed of.

    Mixed pages have a background and a mask, photos a background alone, text pages a mask alone. A background is grey where
    the page has no colour or none is wanted, and its sides are at least a pixel; a photo has its own resolution. ``flags``
    says whether the mask's own codec is at hand; without it a mask is deflated.
    """
    has_background, has_mask = strategy.isin("mixed", "photo_only"), strategy.isin("mixed", "text_only")
    dpi = F.when(strategy == "photo_only", options.photo_target_dpi).otherwise(options.target_bg_dpi)
    grey = F.when(F.lit(options.force_monochrome) | monochrome, "grayscale").otherwise("rgb")
    return F.struct(
        has_background.alias("background"), F.when(has_background, grey).alias("color_mode"), F.when(has_background, options.effective_codec[0]).alias("codec"),
        F.when(has_mask, F.when(flags, "jbig2").otherwise("flate")).alias("mask"),
        F.when(has_background, target_dimension(width_pt, dpi)).alias("width_px"), F.when(has_background, target_dimension(height_pt, dpi)).alias("height_px"),
    )


def threshold_table(spark: SparkSession) -> DataFrame:
    """(strategy, mode, anomalous) -> lev_ceiling, ssim_floor, tile_floor (F27): a constant table."""
    rows = []
    for strategy in ("mixed", "photo_only", "text_only"):
        for mode, ceiling in LEVENSHTEIN_CEILING.items():
            for anomalous in (False, True):
                if strategy == "photo_only":
                    limits = (1.0, 0.5, -1.0)
                elif strategy == "text_only":
                    limits = (ceiling, SSIM_FLOOR, -1.0)
                else:
                    limits = (ceiling, SSIM_FLOOR, TILE_FLOOR["safe" if anomalous else mode])
                rows.append((strategy, mode, anomalous, *limits))
    return spark.createDataFrame(rows, "strategy string, mode string, anomalous boolean, lev_ceiling double, ssim_floor double, tile_floor double")


def with_thresholds(pages: DataFrame) -> DataFrame:
    """``pages`` (strategy, mode, anomalous) with their thresholds."""
    return pages.join(F.broadcast(threshold_table(pages.sparkSession)), ["strategy", "mode", "anomalous"])


def strategy_counts(pages: DataFrame, by: str) -> DataFrame:
    """A count for each of the fixed strategies, 0 included."""
    return pages.groupBy(by).agg(*[F.count_if(F.col("strategy") == s).alias(s) for s in STRATEGIES])
