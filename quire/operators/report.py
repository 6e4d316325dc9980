"""Reports of documents and of whole runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import fixed
from quire.options import HOST_SHARE, MEBIBYTE, MEMORY_CEILING, MEMORY_FACTOR, MEMORY_FLOOR, WARNING_CODES, Options
from quire.storage import materialize


def ratio(input_bytes: Column, output_bytes: Column) -> Column:
    return input_bytes / F.greatest(F.lit(1), output_bytes)


def apply_ratio_floor(docs: DataFrame, options: Options) -> DataFrame:
    """``docs`` (input_bytes, output_bytes) with ratio, kept output and status.

    An output that saves too little is thrown away: the input is returned and the
    ratio is 1.
    """
    found = ratio(F.col("input_bytes"), F.col("output_bytes"))
    below = F.lit(options.min_ratio > 0) & (found < options.min_ratio)
    return (
        docs.withColumn("below_floor", below)
        .withColumn("ratio", F.when(F.col("below_floor"), 1.0).otherwise(found))
        .withColumn("output_bytes", F.when(F.col("below_floor"), F.col("input_bytes")).otherwise(F.col("output_bytes")))
        .withColumn("status", F.when(F.col("below_floor"), "passed_through").otherwise("ok"))
    )


def totals(runs: DataFrame, by: str) -> DataFrame:
    """A row for each ``by`` and one for all (null), with bytes, ratio and counts by status."""
    counted = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "refused", "crashed")]
    rows = runs.rollup(by).agg(F.sum("input_bytes").alias("input_bytes"), F.sum("output_bytes").alias("output_bytes"), *counted)
    total = ratio(F.col("input_bytes"), F.col("output_bytes"))
    # sums that miss a crashed run would mislead
    return rows.withColumn("ratio", F.when(F.col("crashed") == 0, total))


def exact_quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column a share): interpolated quantiles of each group's values, nulls left out.

    Rows are sorted over the whole table, by group and value, and written with
    generated ids that rise with the order. A group's count and its first id in each partition are a
    few rows; they give the ids at which the quantiles stand, and only those rows
    are read out. So a group of any size is spread over as many tasks as it fills.
    """
    ordered = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").orderBy("g", "v")
    stored = materialize(ordered.withColumn("id", F.monotonically_increasing_id()), "ordered-values")
    parts = stored.groupBy("g", F.shiftright("id", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    own = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = materialize(parts.withColumns({"before": before, "total": F.sum("n").over(own)}), "value-places")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("total") - 1) * F.lit(share)).alias("at")) for name, share in shares.items()])
    due = placed.select("g", "first", "before", "n", F.inline(wanted))
    ends = due.select("g", "name", "at", "first", "before", "n", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    ids = ends.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select("g", "name", "at", "rank", (F.col("first") + F.col("rank") - F.col("before")).alias("id"))
    # two rows for each group and share
    found = stored.select("id", "v").join(ids, "id")
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    each = found.groupBy("g", "name").agg((low + (high - low) * (F.first("at") - F.floor(F.first("at")))).alias("q"))
    return each.groupBy(F.col("g").alias(by)).pivot("name", list(shares)).agg(F.first("q"))


def setting_rollup(runs: DataFrame, by: str = "setting") -> DataFrame:
    """Quartiles, extremes and wall time of each setting (G11); no setting is gathered in a task."""
    sums = runs.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"), F.sum("wall_s").alias("total_wall"))
    ratios = exact_quantiles(runs, by, "ratio", {"median_ratio": 0.5, "p25_ratio": 0.25, "p75_ratio": 0.75})
    walls = exact_quantiles(runs, by, "wall_s", {"median_wall": 0.5})
    out = sums
    for part in (ratios, walls):
        named = part.withColumnRenamed(by, "__by")
        out = out.join(named, out[by].eqNullSafe(named["__by"]), "left").drop("__by")
    return out


def totals_table(runs: DataFrame) -> DataFrame:
    """(position, label, line): the runs as lines of a Markdown table, by label, and a line for all of them.

    ``runs`` has label, status (ok, refused or crashed), reason, input_bytes, output_bytes, pages, wall_ms and verifier.
    A crash is a bug and not a refusal, so sums that would miss one are left out. The text of a line has no order of
    its own: sort by (position, label).
    """
    number = lambda c: F.format_number(c, 0)
    cell = lambda *parts: F.concat(F.lit("| "), *[x for p in parts for x in (p, F.lit(" | "))][:-1], F.lit(" |"))
    dash = F.lit("\u2014")
    done = cell(F.col("label"), number(F.col("input_bytes")), number(F.col("output_bytes")), F.concat(fixed(ratio(F.col("input_bytes"), F.col("output_bytes")), 2), F.lit("x")), F.col("pages").cast("string"), F.col("wall_ms").cast("string"), F.col("verifier"))
    shout = lambda word: F.concat(F.lit(word), F.col("reason"))
    failed = lambda text: cell(F.col("label"), number(F.col("input_bytes")), dash, dash, dash, dash, text)
    line = F.when(F.col("status") == "ok", done).when(F.col("status") == "refused", failed(shout("REFUSED: "))).otherwise(failed(F.concat(F.lit("*** CRASH: "), F.col("reason"), F.lit(" ***"))))
    body = runs.select(F.lit(0).alias("position"), "label", line.alias("line"))
    of = lambda s, c: F.coalesce(F.sum(F.when(F.col("status") == s, F.col(c))), F.lit(0))
    sums = runs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "refused", "crashed")], of("ok", "input_bytes").alias("i"), of("ok", "output_bytes").alias("o"))
    bold = lambda c: F.concat(F.lit("**"), c, F.lit("**"))
    total = cell(bold(F.format_string("TOTAL (%d ok, %d refused)", F.col("ok"), F.col("refused"))), bold(number(F.col("i"))), bold(number(F.col("o"))), bold(F.concat(fixed(ratio(F.col("i"), F.col("o")), 2), F.lit("x"))), dash, dash, dash)
    crashes = F.format_string("%d runs crashed; totals left out", F.col("crashed"))
    last = sums.filter("crashed > 0 OR i > 0").select(F.lit(1).alias("position"), F.lit("").alias("label"), F.when(F.col("crashed") > 0, crashes).otherwise(total).alias("line"))
    return body.unionByName(last)


#: Warnings about a page, in the order in which its steps meet them.
PAGE_WARNINGS = (
    "native-text-quality-poor-using-tesseract",
    "color-detected-in-monochrome-mode",
    "text-only-demoted-to-mixed-color-detected",
    "jbig2-fallback-to-flate",
    "anomalous-ratio-{}x-safe-verify",
)


def page_warnings(options: Options) -> Column:
    """A page's warnings, ``page-N-...``, from page_index, has_native, decent, has_color, demoted, flate_fallback, anomalous and pixel_ratio.

    A flag that is null warns of nothing. The ratio is rounded to a whole number, halves to even.
    """
    flags = (
        F.col("has_native") & ~F.col("decent") & F.lit(options.ocr and not options.re_ocr and not options.strip_text_layer),
        F.col("has_color") & F.lit(options.force_monochrome),
        F.col("demoted"),
        F.col("flate_fallback"),
        F.col("anomalous") & F.lit(not options.skip_verify),
    )
    ratio_text = F.bround("pixel_ratio").cast("long").cast("string")
    said = lambda text: F.concat(F.lit("page-"), (F.col("page_index") + 1).cast("string"), F.lit("-"), F.replace(F.lit(text), F.lit("{}"), ratio_text) if "{}" in text else F.lit(text))
    return F.array_compact(F.array(*[F.when(flag, said(text)) for flag, text in zip(flags, PAGE_WARNINGS, strict=True)]))


def run_warnings() -> Column:
    """The codes of a run's warning lines, in the order of ``WARNING_CODES``.

    From quiet, image_mode, to_stdout, max_output_mb, output_bytes, format_overridden, chunks,
    oversize_chunks, stale_files, image_failures, chunk_failures, verifier, passed_signed,
    over_memory, caps_state and watchdog_died. A quiet run keeps what a batch must not miss: failures, stale files,
    what became of signatures and memory.
    """
    loud, pdf = ~F.col("quiet"), ~F.col("image_mode")
    split = pdf & ~F.col("to_stdout") & F.col("max_output_mb").isNotNull()
    tests = (
        loud & F.col("image_mode") & F.col("max_output_mb").isNotNull(),
        pdf & F.col("to_stdout") & (F.col("output_bytes") > F.col("max_output_mb") * MEBIBYTE),
        loud & F.col("format_overridden"),
        loud & split & (F.col("chunks") > 1) & (F.col("oversize_chunks") > 0),
        split & (F.col("chunks") > 1) & (F.col("stale_files") > 0),
        loud & split & (F.col("chunks") == 1) & (F.col("oversize_chunks") > 0),
        loud & pdf & (F.col("verifier") == "skipped"),
        loud & pdf & (F.col("verifier") == "fail"),
        F.col("image_mode") & (F.col("image_failures") > 0),
        split & (F.col("chunk_failures") > 0),
        F.col("passed_signed"),
        F.col("over_memory"),
        F.col("caps_state") == "unavailable",
        F.col("caps_state") == "failed",
        F.col("watchdog_died"),
    )
    return F.array_compact(F.array(*[F.when(test, code) for test, code in zip(tests, WARNING_CODES, strict=True)]))


def ratio_buckets(runs: DataFrame, by: str = "setting") -> DataFrame:
    """How many runs of each setting fall into each ratio class."""
    r = F.round("ratio", 2)
    return runs.groupBy(by).agg(
        F.count_if(r < 1).alias("below_1"), F.count_if(r == 1).alias("equal_1"), F.count_if((r > 1) & (r <= 1.5)).alias("to_1_5"),
        F.count_if((r > 1.5) & (r <= 3)).alias("to_3"), F.count_if(r > 3).alias("above_3"),
    )


def best_and_worst(runs: DataFrame, by: str, setting: str = "setting") -> DataFrame:
    """The settings with an input's largest and smallest ratio; ties go to the first name."""
    best = F.min_by(setting, F.struct(-F.col("ratio"), F.col(setting)))
    worst = F.min_by(setting, F.struct(F.col("ratio"), F.col(setting)))
    return runs.groupBy(by).agg(best.alias("best"), F.max("ratio").alias("best_ratio"), worst.alias("worst"), F.min("ratio").alias("worst_ratio"))


def efficiency(workers: DataFrame, by: str, wall_ms: str = "wall_ms", own_ms: str = "worker_ms") -> DataFrame:
    """Worker time over wall time (G9), with the largest sample and whether any passed its cap."""
    return workers.groupBy(by).agg((F.sum(own_ms) / F.greatest(F.lit(1), F.max(wall_ms))).alias("efficiency"), F.max(own_ms).alias("peak_ms"))


def substring_count(warnings: Column, part: str) -> Column:
    """How many warnings hold ``part``."""
    return F.size(F.filter(warnings, lambda x: x.contains(part)))


def link_logs(reports: DataFrame, lines: DataFrame) -> DataFrame:
    """Log lines with the report whose correlation id begins with their short one."""
    return lines.join(reports.withColumn("short_id", F.substring("correlation_id", 1, 8)), "short_id")


def as_json(fields: list[str]) -> Column:
    """The report's fields, in this order, as one JSON object; nulls are written (K9)."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def worker_memory_cap(input_bytes: Column, workers: Column, available: int, setting_mb: Column) -> Column:
    """Bytes for each worker, as ``options.worker_memory_cap`` has them; 0 switches the cap off."""
    # the factor comes after the ceiling, so that it can't overflow
    scaled = F.greatest(F.lit(MEMORY_FLOOR), F.least(input_bytes, F.lit(MEMORY_CEILING // MEMORY_FACTOR)) * MEMORY_FACTOR)
    share = F.floor(F.lit(int(available * HOST_SHARE)) / F.greatest(F.lit(1), workers))
    return F.when(setting_mb == 0, F.lit(0).cast("long")).otherwise(F.least(F.coalesce(setting_mb.cast("long") * MEBIBYTE, scaled), share))


def sidecar(reports: DataFrame, by: str, started_at: str, build: dict[str, str]) -> DataFrame:
    """A row for each run in ``by``: the run's record with an entry for each report, by id.

    A run's record is one document by definition; runs of many reports write the
    entries as lines instead (``write_reports``).
    """
    entry = F.struct("doc_id", "correlation_id", "input_sha256", "status")
    entries = F.array_sort(F.collect_list(entry)).alias("entries")
    info = F.struct(*[F.lit(v).alias(k) for k, v in build.items()]).alias("build_info")
    rows = reports.groupBy(F.col(by).alias("run_id")).agg(entries).select("run_id", F.lit(started_at).alias("started_at"), info, "entries")
    return rows.select(F.to_json(F.struct("run_id", "started_at", "build_info", "entries"), {"ignoreNullFields": "false"}).alias("sidecar"))


def write_reports(reports: DataFrame, path: str, kind: str = "jsonl") -> None:
    """Reports as lines of JSON, as text lines, or not at all (K9)."""
    if kind == "jsonl":
        reports.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif kind == "text":
        reports.select("line").write.mode("overwrite").text(path)
    elif kind != "none":
        raise ValueError(f"unknown report kind {kind!r}")


def content_key(columns: list[str]) -> Column:
    """SHA-256 of the lasting content columns: rows that differ elsewhere agree."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
