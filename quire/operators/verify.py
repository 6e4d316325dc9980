"""Whether outputs still hold what the inputs held, by page and by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.options import LEVENSHTEIN_CEILING, SSIM_FLOOR, TILE_FLOOR, Options


def pair_pages(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pages of both sides by key; a page of one side only has an error code."""
    both = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), keys, "full")
    lone = F.col("__l").isNull() | F.col("__r").isNull()
    return both.withColumn("error_code", F.when(lone, "E-PAGE-COUNT")).drop("__l", "__r")


def verify_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with the five gates and ``passed``.

    Needs input_text, output_text, ssim_global, ssim_tile_min, input_color,
    output_color (null: not checked), lev_ceiling, ssim_floor and tile_floor.
    """
    lost = F.coalesce(F.col("input_color") & ~F.col("output_color"), F.lit(False))
    measured = pages.withColumns(
        {
            "lev": T.levenshtein_ratio(F.col("input_text"), F.col("output_text")),
            "digits_match": T.same_numbers(F.col("input_text"), F.col("output_text")),
            "color_preserved": ~lost,
        }
    )
    gates = [
        F.col("lev") <= F.col("lev_ceiling"),
        F.col("digits_match"),
        F.col("ssim_global") >= F.col("ssim_floor"),
        F.col("ssim_tile_min") >= F.col("tile_floor"),
        F.col("color_preserved"),
    ]
    passed = gates[0]
    for gate in gates[1:]:
        passed = passed & gate
    # a measure that is missing fails its page
    return measured.withColumn("passed", F.coalesce(passed, F.lit(False)))


def verify_documents(verdicts: DataFrame, by: str = "doc_id") -> DataFrame:
    """A verdict for each document: worst measures, counts, failing pages in order (G1).

    All measures are partial aggregates but the list of failing pages, which is
    as long as the document fails.
    """
    worst = F.greatest(F.lit(0.0), F.coalesce(F.max("lev"), F.lit(1.0)))
    least = lambda c: F.least(F.lit(1.0), F.coalesce(F.min(c), F.lit(0.0)))
    return (
        verdicts.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("pages"),
            worst.alias("ocr_levenshtein"),
            least("ssim_global").alias("ssim_global"),
            least("ssim_tile_min").alias("ssim_min_tile"),
            F.count_if(~F.coalesce(F.col("digits_match"), F.lit(False))).alias("digit_mismatches"),
            F.count_if(~F.coalesce(F.col("color_preserved"), F.lit(False))).alias("color_losses"),
            F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("page_index")))).alias("failing_pages"),
        )
        .withColumn("digit_multiset_match", F.col("digit_mismatches") == 0)
        .withColumn("color_preserved", F.col("color_losses") == 0)
        .withColumn("structural_match", F.lit(True))
        .withColumn("status", F.when(F.size("failing_pages") == 0, "pass").otherwise("fail"))
    )


def skipped_verdicts(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """Documents whose check was skipped: measures that no threshold accepts."""
    return docs.select(by).distinct().select(
        by, F.lit("skipped").alias("status"), F.lit(1.0).alias("ocr_levenshtein"), F.lit(0.0).alias("ssim_global"), F.lit(0.0).alias("ssim_min_tile"),
        F.lit(False).alias("digit_multiset_match"), F.lit(False).alias("structural_match"), F.lit(False).alias("color_preserved"), F.array().cast("array<int>").alias("failing_pages"),
    )


def failure_summary() -> Column:
    """Which gates failed, a line each; empty for a clean document."""
    failing = F.size("failing_pages")
    lines = F.concat_ws(
        "\n",
        F.format_string("%d/%d pages failed the verifier:", failing, F.col("pages")),
        F.when(F.col("digit_mismatches") > 0, F.format_string("  - %d pages: numbers changed", F.col("digit_mismatches"))),
        F.when(F.col("ocr_levenshtein") > LEVENSHTEIN_CEILING["standard"], F.concat(F.lit("  - text edit distance up to "), T.fixed(F.col("ocr_levenshtein") * 100, 2), F.lit("%"))),
        F.when(F.col("ssim_global") < SSIM_FLOOR, F.concat(F.lit("  - least global similarity "), T.fixed(F.col("ssim_global"), 4))),
        F.when((F.col("ssim_min_tile") < TILE_FLOOR["standard"]) & (F.col("ssim_min_tile") > -1), F.concat(F.lit("  - least tile similarity "), T.fixed(F.col("ssim_min_tile"), 4))),
        F.when(F.col("color_losses") > 0, F.format_string("  - %d pages: colour lost", F.col("color_losses"))),
    )
    return F.when(failing == 0, "").otherwise(lines)


def drift_decision(options: Options) -> Column:
    """What a failing document leads to: an abort, or a warning with its pages."""
    if options.mode == "fast" or options.accept_drift:
        tag = "accept-drift" if options.accept_drift else "fast-mode"
        done = F.concat(F.lit(f"verifier-fail-{tag}-pages-"), T.failing_pages_tag(F.col("failing_pages")))
    else:
        done = F.concat(F.lit("E-VERIFIER-FAIL: content drift on "), T.failing_pages_display(F.col("failing_pages")))
    return F.when(F.col("status") == "fail", done)
