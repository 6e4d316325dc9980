"""The whole batch: triage to report, as one plan over tables of documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import gate, report, strategy, triage, verify
from quire.options import Options


def run(docs: DataFrame, pages: DataFrame, options: Options) -> DataFrame:
    """A report row for every document; refusals are rows with an error code.

    ``docs`` has triage columns, ``profile`` apart; ``pages`` has doc_id,
    page_index, the byte columns, coverage, light, monochrome, output_bytes, the
    texts and similarities of ``verify_pages`` and its colour flags; has_native,
    decent and flate_fallback may be there too. Pages are
    dealt by document once; the gate, the counts and the verdicts reuse that.
    """
    decided = triage.apply_policy(docs.withColumn("profile", F.lit("all")), {"all": options})
    live = decided.filter("decision = 'PROCEED'").select("doc_id")
    routed = gate.gate_pages(gate.score_pages(pages.join(live, "doc_id", "left_semi"), options))

    processed = F.col("route") == "process"
    kind = strategy.demote_color(strategy.classify_page(F.col("coverage"), F.col("light")), F.col("monochrome"), options.force_monochrome)
    shaped = routed.withColumn("__k", kind).withColumns(
        {
            "strategy": F.when(processed, F.col("__k.strategy")).otherwise("already_optimized"),
            "demoted": processed & F.col("__k.demoted"),
            "page_in": F.col("content_bytes") + F.col("image_bytes") + F.col("other_bytes"),
        }
    )
    shaped = shaped.withColumn("page_out", F.when(processed, F.col("output_bytes")).otherwise(F.col("page_in")))
    for flag in ("has_native", "decent", "flate_fallback"):
        if flag not in shaped.columns:
            shaped = shaped.withColumn(flag, F.lit(None).cast("boolean"))
    shaped = shaped.withColumns(
        {
            "has_color": ~F.col("monochrome"), "anomalous": strategy.is_anomalous(F.col("w"), F.col("h"), F.col("page_out"), F.col("strategy")),
            "pixel_ratio": strategy.pixel_ratio(F.col("w"), F.col("h"), F.col("page_out")),
        }
    )
    # at most a few short strings a page, and only of pages that are warned about
    shaped = shaped.withColumn("warned", F.when(processed, report.page_warnings(options)))
    listed = F.array_sort(F.collect_list(F.when(F.size("warned") > 0, F.struct("page_index", "warned"))))
    folded = shaped.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.bool_and("whole_doc").alias("whole_doc"), F.count_if(F.col("route") == "verbatim").alias("verbatim"),
        *[F.count_if(F.col("strategy") == s).alias(s) for s in strategy.STRATEGIES],
        F.flatten(F.transform(listed, lambda x: x["warned"])).alias("page_warnings"), F.sum("page_in").alias("input_bytes"), F.sum("page_out").alias("output_bytes"),
    )
    finished = report.apply_ratio_floor(folded, options)
    if options.skip_verify:
        checked = verify.skipped_verdicts(folded).withColumnRenamed("status", "verifier").select("doc_id", "verifier", "failing_pages")
    else:
        modes = shaped.filter(processed).withColumn("mode", F.lit(options.mode))
        verdicts = verify.verify_pages(strategy.with_thresholds(modes))
        checked = verify.verify_documents(verdicts).withColumnRenamed("status", "verifier").select("doc_id", "verifier", "failing_pages")
    joined = decided.join(finished, "doc_id", "left").join(checked, "doc_id", "left")
    aborts = (F.col("verifier") == "fail") & ~F.lit(options.mode == "fast" or options.accept_drift)
    # the ratio floor is met before drift is looked at: what returns the input can't have drifted
    status = (
        F.when(F.col("decision").startswith("E-"), "refused")
        .when(F.col("decision").startswith("PASSTHROUGH") | F.col("whole_doc"), "passed_through")
        .when(F.col("below_floor"), "passed_through")
        .when(F.coalesce(aborts, F.lit(False)), "drift_aborted")
        .otherwise("ok")
    )
    some = (F.col("verbatim") > 0) & (F.col("verbatim") < F.col("page_count"))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("decision") == "PASSTHROUGH-SIGNED", "passthrough-signed"),
            F.when(F.col("decision") == "PASSTHROUGH-SMALL", "passthrough-min-input"),
            F.when(F.col("whole_doc"), "passthrough-no-image-content"),
            F.when(F.col("below_floor"), "passthrough-ratio-floor"),
            F.when(some & (F.col("status") == "ok"), F.format_string("pages-skipped-verbatim-%d", F.col("verbatim"))),
        )
    )
    return joined.withColumn("status", status).select(
        "doc_id", "status", "decision", "exit_code", "input_bytes", "output_bytes", F.round("ratio", 6).alias("ratio"), "page_count", *strategy.STRATEGIES,
        F.coalesce("verifier", F.lit("skipped")).alias("verifier"), F.array_join("failing_pages", ",").alias("failing_pages"),
        triage.signature_outcome(F.col("is_signed"), F.col("is_certified"), options).alias("signature_state"), F.array_join(F.concat(warnings, F.coalesce("page_warnings", F.array().cast("array<string>"))), ",").alias("warnings"),
    )
