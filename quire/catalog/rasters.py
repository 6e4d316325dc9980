"""Queries on rasters, page classes and verdicts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quire.catalog import query
from quire.catalog.pages import PAGES
from quire.catalog.texts import DISTANCE, NUMBERS, TEXTS, _folded
from quire.functions import raster
from quire.operators import strategy, verify
from quire.options import Options
from quire.plans import pipeline
from quire.sources import bindings as B

GREY = """
    vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    grey AS (SELECT vec_id, list_transform(v, lambda x: CAST(floor(255 * (x - list_min(v)) / (list_max(v) - list_min(v))) AS INTEGER)) AS px FROM vectors),
    rasters AS (
        SELECT vec_id, CASE vec_id % 4 WHEN 1 THEN list_transform(px, lambda x: CASE WHEN x >= 64 THEN 255 ELSE x END) WHEN 2 THEN list_transform(px, lambda x: 255)
               WHEN 3 THEN list_transform(px, lambda x: CASE WHEN x >= 32 THEN 255 ELSE x END) ELSE px END AS px FROM grey)
"""
CLASSES = f"""
    {GREY},
    shares AS (SELECT vec_id, len(list_filter(px, lambda x: x < 96)) / 64.0 AS coverage, len(list_filter(px, lambda x: x >= 230)) / 64.0 AS light FROM rasters),
    classes AS (SELECT *, CASE WHEN coverage <= 0.05 THEN 'photo_only' WHEN light >= 0.8 THEN 'text_only' ELSE 'mixed' END AS strategy FROM shares)
"""
SSIM = f"""
    {CLASSES},
    axis AS (SELECT CAST(range AS INTEGER) AS n FROM range(0, 8)), step AS (SELECT CAST(range AS INTEGER) - 3 AS d FROM range(0, 7)),
    reach AS (SELECT n, CASE WHEN n + d < 0 THEN -(n + d) - 1 WHEN n + d > 7 THEN 15 - (n + d) ELSE n + d END AS m FROM axis, step),
    cells AS (SELECT vec_id, r.n AS r, c.n AS c, CAST(px[r.m * 8 + c.m + 1] AS DOUBLE) AS a, CAST(px[r.m * 8 + c.m + 1] - px[r.m * 8 + c.m + 1] % 32 AS DOUBLE) AS b FROM rasters, reach r, reach c),
    means AS (SELECT vec_id, r, c, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab FROM cells GROUP BY vec_id, r, c),
    ssim AS (
        SELECT vec_id, r, c, ((2 * ma * mb + 6.5025) * (2 * 49 / 48.0 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (49 / 48.0 * (aa - ma * ma + bb - mb * mb) + 58.5225)) AS s FROM means),
    likeness AS (SELECT vec_id, avg(s) FILTER (r IN (3, 4) AND c IN (3, 4)) AS ssim_global, min(s) AS ssim_tile_min FROM ssim GROUP BY vec_id)
"""
COLOR = f"""
    {GREY},
    colors AS (SELECT r.vec_id, r.px AS r, coalesce(g.px, r.px) AS g, coalesce(b.px, r.px) AS b FROM rasters r LEFT JOIN rasters g ON g.vec_id = r.vec_id + 1 LEFT JOIN rasters b ON b.vec_id = r.vec_id + 2 WHERE r.vec_id % 3 = 0),
    pixels AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(r) AS r, unnest(g) AS g, unnest(b) AS b FROM colors),
    spreads AS (SELECT *, greatest(r, g, b) - least(r, g, b) AS spread FROM pixels)
"""
VERDICTS = f"""
    {TEXTS}, {SSIM},
    measured AS (
        SELECT doc, page_index, doc_id, strategy, CASE WHEN greatest(length(a), length(b)) = 0 THEN 0 ELSE {DISTANCE} / CAST(greatest(length(a), length(b)) AS DOUBLE) END AS lev,
               {NUMBERS.format('a')} = {NUMBERS.format('b')} AS digits_match, ssim_global, ssim_tile_min, doc_id % 10 <> 0 OR doc_id % 4 = 0 AS color_preserved
        FROM folded JOIN classes ON classes.vec_id = doc_id % 500 JOIN likeness ON likeness.vec_id = doc_id % 500),
    verdicts AS (
        SELECT *, lev <= CASE strategy WHEN 'photo_only' THEN 1.0 ELSE 0.05 END AND digits_match AND ssim_global >= CASE strategy WHEN 'photo_only' THEN 0.5 ELSE 0.92 END
               AND ssim_tile_min >= CASE strategy WHEN 'mixed' THEN 0.85 ELSE -1.0 END AND color_preserved AS passed FROM measured),
    folds AS (
        SELECT doc, count(*) AS pages, greatest(0, max(lev)) AS ocr_levenshtein, least(1, min(ssim_global)) AS ssim_global, least(1, min(ssim_tile_min)) AS ssim_min_tile, count(*) FILTER (NOT digits_match) AS digit_mismatches,
               count(*) FILTER (NOT color_preserved) AS color_losses, coalesce(list(page_index ORDER BY page_index) FILTER (NOT passed), []) AS failing
        FROM verdicts GROUP BY doc)
"""


def _similarity(a, b):
    return {"ssim_global": raster.ssim_global(a, b), "ssim_tile_min": raster.ssim_tile_min(a, b)}


def _pairs(spark, sf_dir):
    coarse = F.transform("px", lambda x: x - x % 32)
    return B.rasters(spark, sf_dir).withColumn("out", coarse)


def _similar(spark, sf_dir):
    return raster.map_rasters(_pairs(spark, sf_dir), _similarity, ["px", "out"], ["vec_id"], "ssim_global double, ssim_tile_min double", stacked=True).drop("error")


def _classes(spark, sf_dir):
    shares = B.rasters(spark, sf_dir).select("vec_id", strategy.fraction_where(F.col("px"), lambda x: x < 96).alias("coverage"), strategy.light_fraction(F.col("px")).alias("light"))
    return shares.withColumn("strategy", strategy.classify_page(F.col("coverage"), F.col("light")))


def _verdicts(spark, sf_dir):
    texts = _folded(spark, sf_dir).select("doc", "page_index", "doc_id", F.col("a").alias("input_text"), F.col("b").alias("output_text"), (F.col("doc_id") % 500).alias("vec_id"))
    pages = texts.join(_classes(spark, sf_dir).join(_similar(spark, sf_dir), "vec_id"), "vec_id")
    key = F.col("doc_id")
    flagged = pages.withColumns({"mode": F.lit("standard"), "anomalous": F.lit(False), "input_color": key % 10 == 0, "output_color": key % 4 == 0})
    return verify.verify_pages(strategy.with_thresholds(flagged))


def _folds(spark, sf_dir):
    return verify.verify_documents(_verdicts(spark, sf_dir), "doc")


def _rounded(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query(f"WITH {SSIM} SELECT vec_id, round(ssim_global, 6) AS ssim_global FROM likeness")
def ssim_global(spark, sf_dir):
    return _similar(spark, sf_dir).select("vec_id", *_rounded("ssim_global"))


@query(f"WITH {SSIM} SELECT vec_id, round(ssim_tile_min, 6) AS ssim_tile_min FROM likeness")
def ssim_tile_min(spark, sf_dir):
    return _similar(spark, sf_dir).select("vec_id", *_rounded("ssim_tile_min"))


@query(f"""
    WITH {CLASSES}
    SELECT vec_id, round(coverage, 6) AS coverage, round(light, 6) AS light, strategy, CASE WHEN strategy = 'text_only' AND vec_id % 3 = 0 THEN 'mixed' ELSE strategy END AS colored, strategy = 'text_only' AND vec_id % 3 = 0 AS demoted FROM classes
""")
def page_strategy(spark, sf_dir):
    rows = _classes(spark, sf_dir).withColumn("d", strategy.demote_color(F.col("strategy"), F.col("vec_id") % 3 != 0, False))
    return rows.select("vec_id", *_rounded("coverage", "light"), "strategy", F.col("d.strategy").alias("colored"), "d.demoted")


@query(f"""
    WITH {CLASSES}
    SELECT vec_id % 7 AS doc_id, count(*) FILTER (strategy = 'text_only') AS text_only, count(*) FILTER (strategy = 'photo_only') AS photo_only, count(*) FILTER (strategy = 'mixed') AS mixed, CAST(0 AS BIGINT) AS already_optimized
    FROM classes GROUP BY 1
""")
def strategy_distribution(spark, sf_dir):
    return strategy.strategy_counts(_classes(spark, sf_dir).withColumn("doc_id", F.col("vec_id") % 7), "doc_id")


@query(f"""
    WITH {CLASSES}, m AS (SELECT vec_id, strategy, CASE vec_id % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'safe' ELSE 'fast' END AS mode, 8 * 8 * 3 / CAST(greatest(1, vec_id % 3) AS DOUBLE) > 200 AND strategy <> 'text_only' AS anomalous FROM classes)
    SELECT vec_id, strategy, mode, anomalous, CASE WHEN strategy = 'photo_only' THEN 1.0 WHEN mode = 'safe' THEN 0.02 ELSE 0.05 END AS lev_ceiling, CASE WHEN strategy = 'photo_only' THEN 0.5 ELSE 0.92 END AS ssim_floor,
           CASE WHEN strategy <> 'mixed' THEN -1.0 WHEN anomalous OR mode = 'safe' THEN 0.88 ELSE 0.85 END AS tile_floor
    FROM m
""")
def page_threshold_lookup(spark, sf_dir):
    modes = F.get(F.array(F.lit("standard"), F.lit("safe"), F.lit("fast")), (F.col("vec_id") % 3).cast("int"))
    anomalous = strategy.is_anomalous(F.lit(8), F.lit(8), F.col("vec_id") % 3, F.col("strategy"))
    pages = _classes(spark, sf_dir).select("vec_id", "strategy", modes.alias("mode"), anomalous.alias("anomalous"))
    return strategy.with_thresholds(pages).select("vec_id", "strategy", "mode", "anomalous", "lev_ceiling", "ssim_floor", "tile_floor")


@query(f"""
    WITH {COLOR}
    SELECT vec_id, quantile_cont(spread, 0.99) <= 15 AND count(*) FILTER (spread > 15) / 64.0 <= 0.001 AS strict, quantile_cont(spread, 0.99) <= 200 AND count(*) FILTER (spread > 200) / 64.0 <= 0.05 AS loose FROM spreads GROUP BY vec_id
""")
def mono_detect(spark, sf_dir):
    rows = B.color_rasters(spark, sf_dir).withColumn("spread", raster.spread_pixels(F.col("r"), F.col("g"), F.col("b")))
    return rows.select("vec_id", raster.is_monochrome_spread(F.col("spread")).alias("strict"), raster.is_monochrome_spread(F.col("spread"), 200, 0.05).alias("loose"))


@query(f"""
    WITH {COLOR}
    SELECT vec_id, coalesce(CAST(trunc(avg(r) FILTER (greatest(r, g, b) >= 230)) AS INTEGER), 255) AS red, coalesce(CAST(trunc(avg(g) FILTER (greatest(r, g, b) >= 230)) AS INTEGER), 255) AS green,
           coalesce(CAST(trunc(avg(b) FILTER (greatest(r, g, b) >= 230)) AS INTEGER), 255) AS blue
    FROM spreads GROUP BY vec_id
""")
def paper_color(spark, sf_dir):
    paper = raster.paper_pixels(F.col("r"), F.col("g"), F.col("b"))
    return B.color_rasters(spark, sf_dir).select("vec_id", paper.alias("c")).select("vec_id", "c.*")


@query(f"""
    WITH {COLOR}
    SELECT vec_id, coalesce(CAST(trunc(median(r) FILTER (r < 96)) AS INTEGER), 0) AS red, coalesce(CAST(trunc(median(g) FILTER (r < 96)) AS INTEGER), 0) AS green, coalesce(CAST(trunc(median(b) FILTER (r < 96)) AS INTEGER), 0) AS blue
    FROM spreads GROUP BY vec_id
""")
def ink_color(spark, sf_dir):
    ink = raster.ink_pixels(F.col("r"), F.col("g"), F.col("b"), lambda p: p["r"] < raster.DARK)
    return B.color_rasters(spark, sf_dir).select("vec_id", ink.alias("c")).select("vec_id", "c.*")


@query(f"""
    WITH {COLOR}, l AS (SELECT vec_id, i, (CAST(r AS BIGINT) * 19595 + CAST(g AS BIGINT) * 38470 + CAST(b AS BIGINT) * 7471 + 32768) >> 16 AS luma FROM pixels)
    SELECT vec_id, array_to_string(list(luma ORDER BY i), ',') AS luma FROM l GROUP BY vec_id
""")
def gray_pixels(spark, sf_dir):
    luma = raster.gray_pixels(F.col("r"), F.col("g"), F.col("b"))
    return B.color_rasters(spark, sf_dir).select("vec_id", F.array_join(F.transform(luma, lambda x: x.cast("string")), ",").alias("luma"))


@query(f"""
    WITH RECURSIVE {COLOR},
    marked AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x FROM spreads WHERE spread > 180),
    spread_out AS (
        SELECT vec_id, i AS source, i, y, x FROM marked
        UNION
        SELECT m.vec_id, s.source, m.i, m.y, m.x FROM spread_out s JOIN marked m ON m.vec_id = s.vec_id AND abs(m.y - s.y) <= 1 AND abs(m.x - s.x) <= 1),
    sizes AS (SELECT vec_id, source, count(*) AS n FROM spread_out GROUP BY vec_id, source),
    largest AS (SELECT vec_id, max(n) AS largest FROM sizes GROUP BY vec_id)
    SELECT c.vec_id, CAST(coalesce(largest, 0) AS INTEGER) AS largest, coalesce(largest, 0) >= 12 AS has_color FROM colors c LEFT JOIN largest l ON l.vec_id = c.vec_id
""")
def color_components(spark, sf_dir):
    def kernel(r, g, b):
        rgb = np.stack([r, g, b])
        return {"largest": raster.largest_component(raster.channel_spread(rgb) > 180), "has_color": raster.has_color(rgb, fraction=1.0, component=12, spread=180)}

    return raster.map_rasters(B.color_rasters(spark, sf_dir), kernel, ["r", "g", "b"], ["vec_id"], "largest int, has_color boolean").drop("error")


@query(f"""
    WITH {GREY},
    taps AS (SELECT CAST(range AS INTEGER) - 12 AS d, exp(-((range - 12) * (range - 12)) / (2 * 4.1 * 4.1)) AS g FROM range(0, 25)),
    axis AS (SELECT CAST(range AS INTEGER) AS n FROM range(0, 8)), edges AS (SELECT n, greatest(0, least(7, n + d)) AS m, sum(g) / (SELECT sum(g) FROM taps) AS weight FROM axis, taps GROUP BY 1, 2),
    means AS (SELECT vec_id, y.n AS y, x.n AS x, round_even(sum(y.weight * x.weight * px[y.m * 8 + x.m + 1]), 0) AS mean FROM rasters, edges y, edges x GROUP BY vec_id, y.n, x.n),
    marked AS (SELECT r.vec_id, y, x, px[y * 8 + x + 1] <= mean - 15 OR px[y * 8 + x + 1] < 96 AS ink FROM rasters r JOIN means m ON m.vec_id = r.vec_id),
    grown AS (SELECT a.vec_id, a.y, a.x, bool_or(b.ink) AS ink FROM marked a JOIN marked b ON b.vec_id = a.vec_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY a.vec_id, a.y, a.x),
    closed AS (SELECT a.vec_id, a.y, a.x, bool_and(b.ink) AS ink FROM grown a JOIN grown b ON b.vec_id = a.vec_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY a.vec_id, a.y, a.x),
    bytes AS (SELECT vec_id, y, sum(CASE WHEN ink THEN 1 << CAST(7 - x AS INTEGER) ELSE 0 END) AS byte, count(*) FILTER (ink) AS n FROM closed GROUP BY vec_id, y)
    SELECT vec_id, CAST(sum(n) AS INTEGER) AS ink, string_agg(format('{{:02x}}', CAST(byte AS INTEGER)), '' ORDER BY y) AS packed FROM bytes GROUP BY vec_id
""")
def adaptive_mask(spark, sf_dir):
    def kernel(px):
        mask = raster.adaptive_mask(px)
        return {"ink": int(mask.sum()), "packed": raster.pack_bits(mask).hex()}

    return raster.map_rasters(B.rasters(spark, sf_dir), kernel, ["px"], ["vec_id"], "ink int, packed string").drop("error")


@query()
def mask_stream(spark, sf_dir):
    """The size of each mask's deflated stream; the deflater has no SQL, so a test inflates what it made."""
    kernel = lambda px: {"stream_bytes": raster.mask_bytes(px < raster.DARK)}
    return raster.map_rasters(B.rasters(spark, sf_dir), kernel, ["px"], ["vec_id"], "stream_bytes int").drop("error")


@query(f"""
    WITH {GREY}, bits AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(px) < 96 AS ink FROM rasters),
    bytes AS (SELECT vec_id, i // 8 AS y, sum(CASE WHEN ink THEN 1 << CAST(7 - i % 8 AS INTEGER) ELSE 0 END) AS byte FROM bits GROUP BY vec_id, i // 8)
    SELECT vec_id, string_agg(format('{{:02x}}', CAST(byte AS INTEGER)), '' ORDER BY y) AS packed FROM bytes GROUP BY vec_id
""")
def packed_mask(spark, sf_dir):
    mask = F.transform("px", lambda x: x < raster.DARK)
    return B.rasters(spark, sf_dir).select("vec_id", raster.packed_hex(mask, F.col("w"), F.col("h")).alias("packed"))


@query(f"""
    WITH {CLASSES}, p AS (SELECT *, vec_id % 600 + 1.0 AS w, CASE strategy WHEN 'photo_only' THEN 200 ELSE 150 END AS dpi FROM classes)
    SELECT vec_id, strategy, strategy <> 'text_only' AS background, CASE WHEN strategy <> 'text_only' THEN CASE WHEN vec_id % 3 <> 0 THEN 'grayscale' ELSE 'rgb' END END AS color_mode, CASE WHEN strategy <> 'text_only' THEN 'jpeg' END AS codec,
           CASE WHEN strategy <> 'photo_only' THEN CASE WHEN vec_id % 2 = 0 THEN 'jbig2' ELSE 'flate' END END AS mask,
           CASE WHEN strategy <> 'text_only' THEN greatest(1, CAST(round_even(w * dpi / 72, 0) AS BIGINT)) END AS width_px, CASE WHEN strategy <> 'text_only' THEN greatest(1, CAST(round_even(0.2 * dpi / 72, 0) AS BIGINT)) END AS height_px
    FROM p
""")
def compose_choice(spark, sf_dir):
    v = F.col("vec_id")
    plan = strategy.compose_plan(F.col("strategy"), v % 3 != 0, v % 2 == 0, v % 600 + 1.0, F.lit(0.2), Options())
    return _classes(spark, sf_dir).select("vec_id", "strategy", plan.alias("p")).select("vec_id", "strategy", "p.*")


@query(f"""
    WITH {VERDICTS}
    SELECT doc, page_index, doc_id, strategy, round(lev, 6) AS lev, digits_match, round(ssim_global, 6) AS ssim_global, round(ssim_tile_min, 6) AS ssim_tile_min, color_preserved, passed FROM verdicts
""")
def verify_page(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("doc", "page_index", "doc_id", "strategy", *_rounded("lev", "ssim_global", "ssim_tile_min"), "digits_match", "color_preserved", "passed")


@query(f"""
    WITH {VERDICTS}
    SELECT doc, pages, round(ocr_levenshtein, 6) AS ocr_levenshtein, round(ssim_global, 6) AS ssim_global, round(ssim_min_tile, 6) AS ssim_min_tile, digit_mismatches = 0 AS digit_multiset_match, true AS structural_match,
           color_losses = 0 AS color_preserved, array_to_string(failing, ',') AS failing_pages, CASE WHEN len(failing) = 0 THEN 'pass' ELSE 'fail' END AS status
    FROM folds
""")
def verify_doc(spark, sf_dir):
    return _folds(spark, sf_dir).select(
        "doc", "pages", *_rounded("ocr_levenshtein", "ssim_global", "ssim_min_tile"), "digit_multiset_match", "structural_match", "color_preserved", F.array_join("failing_pages", ",").alias("failing_pages"), "status"
    )


@query(f"""
    WITH {VERDICTS}
    SELECT doc, CASE WHEN len(failing) = 0 THEN '' ELSE concat_ws(chr(10), len(failing) || '/' || pages || ' pages failed the verifier:',
           CASE WHEN digit_mismatches > 0 THEN '  - ' || digit_mismatches || ' pages: numbers changed' END, CASE WHEN ocr_levenshtein > 0.05 THEN '  - text edit distance up to ' || format('{{:.2f}}', ocr_levenshtein * 100) || '%' END,
           CASE WHEN ssim_global < 0.92 THEN '  - least global similarity ' || format('{{:.4f}}', ssim_global) END, CASE WHEN ssim_min_tile < 0.85 AND ssim_min_tile > -1 THEN '  - least tile similarity ' || format('{{:.4f}}', ssim_min_tile) END,
           CASE WHEN color_losses > 0 THEN '  - ' || color_losses || ' pages: colour lost' END) END AS summary,
           CASE WHEN len(failing) > 0 THEN 'verifier-fail-accept-drift-pages-' || array_to_string(failing[1:10], ',') || CASE WHEN len(failing) > 10 THEN '+' || (len(failing) - 10) ELSE '' END END AS accepted
    FROM folds
""")
def verify_summary(spark, sf_dir):
    return _folds(spark, sf_dir).select("doc", verify.failure_summary().alias("summary"), verify.drift_decision(Options(accept_drift=True)).alias("accepted"))


@query("SELECT DISTINCT o_custkey AS doc_id, 'skipped' AS status, 1.0::DOUBLE AS ocr_levenshtein, 0.0::DOUBLE AS ssim_global, 0.0::DOUBLE AS ssim_min_tile, false AS digit_multiset_match, false AS structural_match, false AS color_preserved, '' AS failing_pages FROM orders")
def skipped_sentinel(spark, sf_dir):
    docs = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"))
    return verify.skipped_verdicts(docs).withColumn("failing_pages", F.array_join("failing_pages", ","))


@query("""
    SELECT coalesce(l.o_orderkey, r.l_orderkey) AS page_key, CASE WHEN l.o_orderkey IS NULL OR r.l_orderkey IS NULL THEN 'E-PAGE-COUNT' END AS error_code
    FROM orders l FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) r ON l.o_orderkey = r.l_orderkey
""")
def page_pairing(spark, sf_dir):
    left = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_key"))
    right = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_key")).distinct()
    return verify.pair_pages(left, right, ["page_key"]).select("page_key", "error_code")


@query(f"""
    WITH {PAGES}, {SSIM},
    flags AS (
        SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 17 = 0 THEN 'E-INPUT-ENCRYPTED' WHEN c_custkey % 19 = 0 THEN 'E-INPUT-CERTIFIED' WHEN c_custkey % 7 = 0 THEN 'E-INPUT-SIGNED'
               WHEN (c_custkey * 37) % 12000 > 11000 OR (c_custkey * 7919) % 400 > 250 THEN 'E-INPUT-OVERSIZE' WHEN c_custkey % 23 = 0 THEN 'E-INPUT-DECOMPRESSION-BOMB' ELSE 'PROCEED' END AS decision FROM customer),
    shaped AS (
        SELECT p.doc_id, page_index, page_key, strategy = 'text_only' AND page_key % 3 = 0 AS demoted, CASE WHEN strategy = 'text_only' AND page_key % 3 = 0 THEN 'mixed' ELSE strategy END AS kind,
               content_bytes + image_bytes + other_bytes AS page_in, image_bytes // 8 + content_bytes AS page_out, ssim_global, ssim_tile_min,
               CASE WHEN page_key % 50 = 0 THEN levenshtein('page ' || page_key, 'lost') / CAST(length('page ' || page_key) AS DOUBLE) ELSE 0 END AS lev
        FROM pages p JOIN flags f ON f.doc_id = p.doc_id AND decision = 'PROCEED' JOIN classes c ON c.vec_id = page_key % 500 JOIN likeness l ON l.vec_id = page_key % 500),
    judged AS (
        SELECT *, lev <= CASE kind WHEN 'photo_only' THEN 1.0 ELSE 0.05 END AND page_key % 50 <> 0 AND ssim_global >= CASE kind WHEN 'photo_only' THEN 0.5 ELSE 0.92 END
               AND ssim_tile_min >= CASE WHEN kind <> 'mixed' THEN -1.0 ELSE 0.85 END AS passed FROM shaped),
    folded AS (
        SELECT doc_id, count(*) AS page_count, count(*) FILTER (kind = 'text_only') AS text_only, count(*) FILTER (kind = 'photo_only') AS photo_only, count(*) FILTER (kind = 'mixed') AS mixed,
               CAST(sum(page_in) AS BIGINT) AS input_bytes, CAST(sum(page_out) AS BIGINT) AS made, array_to_string(coalesce(list(page_index ORDER BY page_index) FILTER (NOT passed), []), ',') AS failing,
               coalesce(list('page-' || (page_index + 1) || '-text-only-demoted-to-mixed-color-detected' ORDER BY page_index) FILTER (demoted), []) AS demotions
        FROM judged GROUP BY doc_id),
    rated AS (SELECT *, input_bytes / CAST(greatest(1, made) AS DOUBLE) AS found FROM folded)
    SELECT f.doc_id, CASE WHEN decision <> 'PROCEED' THEN 'refused' WHEN found < 1.5 THEN 'passed_through' WHEN failing <> '' THEN 'drift_aborted' ELSE 'ok' END AS status, decision,
           CASE decision WHEN 'E-INPUT-ENCRYPTED' THEN 10 WHEN 'E-INPUT-SIGNED' THEN 11 WHEN 'E-INPUT-OVERSIZE' THEN 12 WHEN 'E-INPUT-CERTIFIED' THEN 15 WHEN 'E-INPUT-DECOMPRESSION-BOMB' THEN 16 ELSE 0 END AS exit_code,
           input_bytes, CASE WHEN found < 1.5 THEN input_bytes ELSE made END AS output_bytes, round(CASE WHEN found < 1.5 THEN 1.0 ELSE found END, 6) AS ratio, page_count, text_only, photo_only, mixed, CASE WHEN page_count IS NOT NULL THEN CAST(0 AS BIGINT) END AS already_optimized,
           CASE WHEN page_count IS NULL THEN 'skipped' WHEN failing = '' THEN 'pass' ELSE 'fail' END AS verifier, failing AS failing_pages, 'none' AS signature_state,
           array_to_string(list_concat(CASE WHEN found < 1.5 THEN ['passthrough-ratio-floor'] ELSE [] END, coalesce(demotions, [])), ',') AS warnings
    FROM flags f LEFT JOIN rated r ON r.doc_id = f.doc_id
""")
def batch_report(spark, sf_dir):
    """The whole plan over customers as documents and orders as pages."""
    pages = B.pages(spark, sf_dir).withColumn("vec_id", F.col("page_key") % 500)
    shown = pages.join(_classes(spark, sf_dir).drop("strategy").join(_similar(spark, sf_dir), "vec_id"), "vec_id").withColumns(
        {
            "monochrome": F.col("page_key") % 3 != 0, "output_bytes": F.floor(F.col("image_bytes") / 8) + F.col("content_bytes"), "w": F.lit(8), "h": F.lit(8),
            "input_text": F.concat(F.lit("page "), F.col("page_key").cast("string")), "output_text": F.when(F.col("page_key") % 50 == 0, "lost").otherwise(F.concat(F.lit("page "), F.col("page_key").cast("string"))),
            "input_color": F.lit(False), "output_color": F.lit(False),
        }
    )
    return pipeline.run(B.triage_flags(spark, sf_dir), shown, Options(skip_verify=False, max_pages=11_000))
