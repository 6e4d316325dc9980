"""Queries on ratio floors, totals, logs and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.catalog import query
from quire.catalog.pages import OPTIONS, PAGES
from quire.operators import gate, report
from quire.options import Options
from quire.plans import limits
from quire.sources import bindings as B

RUNS = """
    runs AS (
        SELECT o_orderkey, o_custkey, o_orderpriority AS setting, CAST(trunc(o_totalprice) AS BIGINT) AS input_bytes, CAST(trunc(o_totalprice) AS BIGINT) // (1 + o_orderkey % 5) AS output_bytes,
               CASE WHEN o_orderkey % 40 = 0 THEN 'refused' ELSE 'ok' END AS status, o_orderkey % 977 / 10.0 AS wall_s
        FROM orders),
    rated AS (SELECT *, input_bytes / CAST(greatest(1, output_bytes) AS DOUBLE) AS ratio FROM runs)
"""


def _runs(spark, sf_dir):
    k, size = F.col("o_orderkey"), F.col("o_totalprice").cast("long")
    return B.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderpriority").alias("setting"), size.alias("input_bytes"), F.expr("cast(o_totalprice as bigint) div (1 + o_orderkey % 5)").alias("output_bytes"),
        F.when(k % 40 == 0, "refused").otherwise("ok").alias("status"), (k % 977 / 10.0).alias("wall_s"),
    ).withColumn("ratio", report.ratio(F.col("input_bytes"), F.col("output_bytes")))


@query(f"""
    WITH {RUNS}
    SELECT o_orderkey, ratio < 1.5 AS below_floor, round(CASE WHEN ratio < 1.5 THEN 1.0 ELSE ratio END, 6) AS ratio, CASE WHEN ratio < 1.5 THEN input_bytes ELSE output_bytes END AS output_bytes,
           CASE WHEN ratio < 1.5 THEN 'passed_through' ELSE 'ok' END AS status
    FROM rated
""")
def ratio_floor(spark, sf_dir):
    done = report.apply_ratio_floor(_runs(spark, sf_dir).drop("ratio"), OPTIONS)
    return done.select("o_orderkey", "below_floor", F.round("ratio", 6).alias("ratio"), "output_bytes", "status")


@query(f"""
    WITH {PAGES}, sizes AS (
        SELECT doc_id, CAST(sum(content_bytes + image_bytes + other_bytes) AS BIGINT) AS input_bytes,
               CAST(sum(CASE WHEN route = 'process' THEN content_bytes + image_bytes // 10 + other_bytes ELSE content_bytes + image_bytes + other_bytes END) AS BIGINT) AS made FROM routed GROUP BY doc_id),
    r AS (SELECT *, input_bytes / CAST(greatest(1, made) AS DOUBLE) AS found FROM sizes JOIN docs USING (doc_id)),
    x AS (SELECT doc_id, CASE WHEN found < 1.5 THEN 'passed_through' ELSE 'ok' END AS status, input_bytes, CASE WHEN found < 1.5 THEN input_bytes ELSE made END AS output_bytes, verbatim, pages FROM r)
    SELECT doc_id, '{{"doc_id":' || doc_id || ',"status":"' || status || '","input_bytes":' || input_bytes || ',"output_bytes":' || output_bytes || ',"pages":' || pages || ',"warning":'
           || CASE WHEN verbatim > 0 AND verbatim < pages THEN '"pages-skipped-verbatim-' || verbatim || '"' WHEN verbatim = 0 AND status = 'none' THEN '""' ELSE 'null' END || '}}' AS report
    FROM x
""")
def doc_report(spark, sf_dir):
    gated = gate.gate_pages(gate.score_pages(B.pages(spark, sf_dir), OPTIONS))
    whole = F.col("content_bytes") + F.col("image_bytes") + F.col("other_bytes")
    smaller = F.col("content_bytes") + F.floor(F.col("image_bytes") / 10) + F.col("other_bytes")
    sizes = gated.groupBy("doc_id").agg(F.sum(whole).alias("input_bytes"), F.sum(F.when(F.col("route") == "process", smaller).otherwise(whole)).alias("output_bytes"))
    docs = gate.doc_gate(gated).drop("status", "warning")
    some = (F.col("verbatim") > 0) & (F.col("verbatim") < F.col("pages"))
    done = report.apply_ratio_floor(sizes, OPTIONS).join(docs, "doc_id").withColumn("warning", F.when(some, F.format_string("pages-skipped-verbatim-%d", F.col("verbatim"))))
    return done.select("doc_id", report.as_json(["doc_id", "status", "input_bytes", "output_bytes", "pages", "warning"]).alias("report"))


@query(f"""
    WITH {RUNS}
    SELECT setting, CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(output_bytes) AS BIGINT) AS output_bytes, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'refused') AS refused, count(*) FILTER (status = 'crashed') AS crashed,
           round(sum(input_bytes) / CAST(greatest(1, sum(output_bytes)) AS DOUBLE), 6) AS ratio
    FROM rated GROUP BY ROLLUP (setting)
""")
def corpus_totals(spark, sf_dir):
    return report.totals(_runs(spark, sf_dir), "setting").withColumn("ratio", F.round("ratio", 6))


@query(f"""
    WITH {RUNS}
    SELECT setting, count(*) AS runs, round(quantile_cont(ratio, 0.5), 6) AS median_ratio, round(quantile_cont(ratio, 0.25), 6) AS p25_ratio, round(quantile_cont(ratio, 0.75), 6) AS p75_ratio, round(min(ratio), 6) AS min_ratio,
           round(max(ratio), 6) AS max_ratio, round(quantile_cont(wall_s, 0.5), 6) AS median_wall, round(sum(wall_s), 3) AS total_wall
    FROM rated GROUP BY setting
""")
def setting_rollup(spark, sf_dir):
    rows = report.setting_rollup(_runs(spark, sf_dir))
    rounded = ["median_ratio", "p25_ratio", "p75_ratio", "min_ratio", "max_ratio", "median_wall"]
    return rows.withColumns({c: F.round(c, 6) for c in rounded} | {"total_wall": F.round("total_wall", 3)})


@query(f"""
    WITH {RUNS}, r AS (SELECT setting, round(ratio, 2) AS r FROM rated)
    SELECT setting, count(*) FILTER (r < 1) AS below_1, count(*) FILTER (r = 1) AS equal_1, count(*) FILTER (r > 1 AND r <= 1.5) AS to_1_5, count(*) FILTER (r > 1.5 AND r <= 3) AS to_3, count(*) FILTER (r > 3) AS above_3
    FROM r GROUP BY setting
""")
def ratio_buckets(spark, sf_dir):
    return report.ratio_buckets(_runs(spark, sf_dir))


@query(f"""
    WITH {RUNS}, b AS (SELECT o_custkey, setting, max(ratio) AS ratio FROM rated GROUP BY o_custkey, setting)
    SELECT o_custkey, arg_min(setting, {{'r': -ratio, 's': setting}}) AS best, round(max(ratio), 6) AS best_ratio, arg_min(setting, {{'r': ratio, 's': setting}}) AS worst, round(min(ratio), 6) AS worst_ratio
    FROM b GROUP BY o_custkey
""")
def best_worst(spark, sf_dir):
    by_setting = _runs(spark, sf_dir).groupBy("o_custkey", "setting").agg(F.max("ratio").alias("ratio"))
    return report.best_and_worst(by_setting, "o_custkey").withColumns({c: F.round(c, 6) for c in ("best_ratio", "worst_ratio")})


@query("""
    SELECT user_id, round(sum(value) / greatest(1, max(value)), 6) AS efficiency, round(max(value), 6) AS peak_ms, max(value) > 95 AS exceeded FROM events GROUP BY user_id
""")
def worker_efficiency(spark, sf_dir):
    done = report.efficiency(B.table(spark, sf_dir, "events"), "user_id", "value", "value")
    return done.select("user_id", F.round("efficiency", 6).alias("efficiency"), F.round("peak_ms", 6).alias("peak_ms"), (F.col("peak_ms") > 95).alias("exceeded"))


@query("""
    SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS position, count(*) OVER (PARTITION BY user_id) AS total FROM events
""")
def progress_position(spark, sf_dir):
    mine = Window.partitionBy("user_id")
    return B.table(spark, sf_dir, "events").select("event_id", F.row_number().over(mine.orderBy("ts", "event_id")).alias("position"), F.count(F.lit(1)).over(mine).alias("total"))


@query("""
    WITH r AS (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS cid FROM orders), l AS (SELECT event_id, substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS short_id FROM events)
    SELECT event_id, o_orderkey, cid AS correlation_id FROM l JOIN r ON substr(cid, 1, 8) = short_id
""")
def correlation_join(spark, sf_dir):
    md5 = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    reports = B.table(spark, sf_dir, "orders").select("o_orderkey", md5("o_orderkey").alias("correlation_id"))
    lines = B.table(spark, sf_dir, "events").select("event_id", F.substring(md5("event_id"), 1, 8).alias("short_id"))
    return report.link_logs(reports, lines).select("event_id", "o_orderkey", "correlation_id")


@query("""
    WITH e AS (SELECT o_orderkey AS doc_id, md5(CAST(o_orderkey AS VARCHAR)) AS correlation_id, sha256(CAST(o_orderkey AS VARCHAR)) AS input_sha256, CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE 'ok' END AS status, o_custkey FROM orders)
    SELECT '{"run_id":"run-' || o_custkey || '","started_at":"2026-01-01T00:00:00Z","build_info":{"version":"0.1.0","git_sha":"?"},"entries":[' || coalesce(string_agg('{"doc_id":' || doc_id || ',"correlation_id":"' || correlation_id || '","input_sha256":"' || input_sha256
           || '","status":' || coalesce('"' || status || '"', 'null') || '}', ',' ORDER BY doc_id), '') || ']}' AS sidecar FROM e GROUP BY o_custkey
""")
def correlation_sidecar(spark, sf_dir):
    """The record of each run: a customer's orders."""
    key = F.col("o_orderkey")
    text = key.cast("string").cast("binary")
    reports = B.table(spark, sf_dir, "orders").select(F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("run"), key.alias("doc_id"), F.md5(text).alias("correlation_id"), F.sha2(text, 256).alias("input_sha256"), F.when(key % 40 != 0, "ok").alias("status"))
    return report.sidecar(reports, "run", "2026-01-01T00:00:00Z", {"version": "0.1.0", "git_sha": "?"})


@query("""
    WITH w AS (SELECT o_custkey, list(CASE o_orderkey % 3 WHEN 0 THEN 'page-' || o_orderkey || '-monochrome-discarded' WHEN 1 THEN 'page-' || o_orderkey || '-anomalous-ratio' ELSE 'page-' || o_orderkey || '-ocr-timeout' END) AS ws FROM orders GROUP BY o_custkey)
    SELECT o_custkey, CAST(len(list_filter(ws, lambda x: contains(x, '-monochrome-'))) AS INTEGER) AS discards FROM w
""")
def warning_counts(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "monochrome-discarded").when(k % 3 == 1, "anomalous-ratio").otherwise("ocr-timeout")
    listed = B.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.concat(F.lit("page-"), k.cast("string"), F.lit("-"), kind)).alias("ws"))
    return listed.select("o_custkey", report.substring_count(F.col("ws"), "-monochrome-").alias("discards"))


@query("""
    SELECT bytes, workers, CASE WHEN setting = 0 THEN 0 ELSE least(CASE WHEN setting IS NOT NULL THEN setting * 1048576 ELSE least(17179869184, greatest(8589934592, 16 * bytes)) END, CAST(floor(34359738368 * 0.7) AS BIGINT) // greatest(1, workers)) END AS cap
    FROM (SELECT CAST(p_partkey * 10000000 AS BIGINT) AS bytes, CAST(p_size % 9 AS BIGINT) AS workers, CASE p_partkey % 3 WHEN 0 THEN CAST(NULL AS BIGINT) WHEN 1 THEN CAST(0 AS BIGINT) ELSE CAST(512 AS BIGINT) END AS setting FROM part)
""")
def mem_cap(spark, sf_dir):
    size, key = (F.col("p_partkey") * 10_000_000).cast("long"), F.col("p_partkey") % 3
    parts = B.table(spark, sf_dir, "part").select(size.alias("bytes"), (F.col("p_size") % 9).cast("long").alias("workers"), F.when(key == 1, 0).when(key == 2, 512).alias("setting"))
    return parts.select("bytes", "workers", report.worker_memory_cap(F.col("bytes"), F.col("workers"), 32 << 30, F.col("setting")).alias("cap"))


@query(f"""
    WITH {RUNS}, lines AS (
        SELECT 0 AS position, 'doc-' || o_orderkey AS label, CASE WHEN status = 'ok'
               THEN '| doc-' || o_orderkey || ' | ' || format('{{:,}}', input_bytes) || ' | ' || format('{{:,}}', output_bytes) || ' | ' || format('{{:.2f}}', ratio) || 'x | ' || o_orderkey % 50 || ' | ' || o_orderkey % 9000 || ' | skipped |'
               ELSE '| doc-' || o_orderkey || ' | ' || format('{{:,}}', input_bytes) || ' | — | — | — | — | REFUSED: E-INPUT-SIGNED |' END AS line
        FROM rated),
    sums AS (SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS refused, CAST(sum(input_bytes) FILTER (status = 'ok') AS BIGINT) AS i, CAST(sum(output_bytes) FILTER (status = 'ok') AS BIGINT) AS o FROM rated)
    SELECT position, label, line FROM lines
    UNION ALL
    SELECT 1, '', '| **TOTAL (' || ok || ' ok, ' || refused || ' refused)** | **' || format('{{:,}}', i) || '** | **' || format('{{:,}}', o) || '** | **' || format('{{:.2f}}', i / CAST(greatest(1, o) AS DOUBLE)) || 'x** | — | — | — |' FROM sums
""")
def totals_table(spark, sf_dir):
    k = F.col("o_orderkey")
    runs = _runs(spark, sf_dir).select(
        F.concat(F.lit("doc-"), k.cast("string")).alias("label"), "status", F.lit("E-INPUT-SIGNED").alias("reason"), "input_bytes", "output_bytes", (k % 50).alias("pages"), (k % 9000).alias("wall_ms"), F.lit("skipped").alias("verifier")
    )
    return report.totals_table(runs)


@query("""
    WITH p AS (SELECT o_orderkey AS k, 'page-' || (1 + o_orderkey % 50) || '-' AS page FROM orders)
    SELECT k AS o_orderkey, array_to_string(list_filter([
        CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN page || 'native-text-quality-poor-using-tesseract' END, CASE WHEN k % 5 = 0 THEN page || 'color-detected-in-monochrome-mode' END,
        CASE WHEN k % 7 = 0 THEN page || 'text-only-demoted-to-mixed-color-detected' END, CASE WHEN k % 11 = 0 THEN page || 'jbig2-fallback-to-flate' END,
        CASE WHEN k % 13 = 0 THEN page || 'anomalous-ratio-' || CAST(round_even(k % 977 + 0.5, 0) AS BIGINT) || 'x-safe-verify' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM p
""")
def page_warnings(spark, sf_dir):
    k = F.col("o_orderkey")
    pages = B.table(spark, sf_dir, "orders").select(
        "o_orderkey", (k % 50).alias("page_index"), (k % 2 == 0).alias("has_native"), F.when(k % 2 == 0, k % 3 == 0).alias("decent"), (k % 5 == 0).alias("has_color"), (k % 7 == 0).alias("demoted"),
        F.when(k % 11 == 0, True).alias("flate_fallback"), (k % 13 == 0).alias("anomalous"), (k % 977 + 0.5).cast("double").alias("pixel_ratio"),
    )
    said = report.page_warnings(Options(ocr=True, force_monochrome=True, skip_verify=False))
    return pages.select("o_orderkey", F.array_join(said, ",").alias("warnings"))


@query("""
    WITH r AS (
        SELECT o_orderkey AS k, o_orderkey % 4 = 0 AS quiet, o_orderkey % 5 = 0 AS image_mode, o_orderkey % 3 = 0 AS to_stdout, CASE WHEN o_orderkey % 2 = 0 THEN 0.1 END AS cap, CAST(trunc(o_totalprice) AS BIGINT) AS size, 1 + o_orderkey % 3 AS chunks FROM orders),
    s AS (SELECT *, NOT image_mode AND NOT to_stdout AND cap IS NOT NULL AS split FROM r)
    SELECT k AS o_orderkey, array_to_string(list_filter([
        CASE WHEN NOT quiet AND image_mode AND cap IS NOT NULL THEN 'W-MAX-OUTPUT-MB-IMAGE-MODE' END, CASE WHEN NOT image_mode AND to_stdout AND size > cap * 1048576 THEN 'W-MAX-OUTPUT-MB-STDOUT' END,
        CASE WHEN NOT quiet AND k % 7 = 0 THEN 'W-OUTPUT-FORMAT-EXTENSION-OVERRIDE' END, CASE WHEN NOT quiet AND split AND chunks > 1 AND k % 11 = 0 THEN 'W-CHUNKS-EXCEED-CAP' END,
        CASE WHEN split AND chunks > 1 AND k % 13 = 0 THEN 'W-STALE-CHUNK-FILES' END, CASE WHEN NOT quiet AND split AND chunks = 1 AND k % 11 = 0 THEN 'W-SINGLE-CHUNK-OVERSIZE' END,
        CASE WHEN NOT quiet AND NOT image_mode AND k % 17 = 0 THEN 'W-VERIFIER-SKIPPED' END, CASE WHEN NOT quiet AND NOT image_mode AND k % 17 = 1 THEN 'W-VERIFIER-FAILED' END,
        CASE WHEN image_mode AND k % 19 = 0 THEN 'W-IMAGE-EXPORT-PARTIAL-FAILURE' END, CASE WHEN split AND k % 19 = 1 THEN 'W-CHUNK-WRITE-PARTIAL-FAILURE' END, CASE WHEN k % 23 = 0 THEN 'W-PASSTHROUGH-SIGNED' END,
        CASE WHEN k % 29 = 0 THEN 'W-MEM-RSS-WATCHDOG' END, CASE WHEN k % 31 = 0 THEN 'W-CAPS-UNAVAILABLE' END, CASE WHEN k % 31 = 1 THEN 'W-CAPS-FAILED' END, CASE WHEN k % 37 = 0 THEN 'W-WATCHDOG-DIED' END], lambda x: x IS NOT NULL), ',') AS codes
    FROM s
""")
def run_warnings(spark, sf_dir):
    k = F.col("o_orderkey")
    when = lambda n: F.when(k % n == 0, 1).otherwise(0)
    runs = B.table(spark, sf_dir, "orders").select(
        "o_orderkey", (k % 4 == 0).alias("quiet"), (k % 5 == 0).alias("image_mode"), (k % 3 == 0).alias("to_stdout"), F.when(k % 2 == 0, 0.1).alias("max_output_mb"), F.col("o_totalprice").cast("long").alias("output_bytes"),
        (k % 7 == 0).alias("format_overridden"), (1 + k % 3).alias("chunks"), when(11).alias("oversize_chunks"), when(13).alias("stale_files"), when(19).alias("image_failures"), F.when(k % 19 == 1, 1).otherwise(0).alias("chunk_failures"),
        F.when(k % 17 == 0, "skipped").when(k % 17 == 1, "fail").otherwise("pass").alias("verifier"), (k % 23 == 0).alias("passed_signed"), (k % 29 == 0).alias("over_memory"),
        F.when(k % 31 == 0, "unavailable").when(k % 31 == 1, "failed").alias("caps_state"), (k % 37 == 0).alias("watchdog_died"),
    )
    return runs.select("o_orderkey", F.array_join(report.run_warnings(), ",").alias("codes"))


@query("""
    WITH d AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN -9 WHEN 2 THEN 137 WHEN 3 THEN 3221225540 WHEN 4 THEN 1 ELSE 139 END AS exit_code, event_id % 10 = 0 AS over FROM events)
    SELECT event_id, CASE WHEN over OR exit_code IN (-9, 137, 3221225540) THEN 'E-MEM-CAP' WHEN exit_code <> 0 THEN 'E-ENGINE-ERROR' END AS code FROM d
""")
def worker_deaths(spark, sf_dir):
    codes = F.array(*[F.lit(x).cast("long") for x in (0, -9, 137, 0xC0000044, 1, 139)])
    ended = B.table(spark, sf_dir, "events").select("event_id", F.get(codes, (F.col("event_id") % 6).cast("int")).alias("exit_code"), (F.col("event_id") % 10 == 0).alias("over"))
    return ended.select("event_id", limits.death_code(F.col("exit_code"), F.col("over")).alias("code"))
