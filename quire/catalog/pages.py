"""Queries on page gates, policies, chunks and words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.catalog import query
from quire.functions import geometry, naming
from quire.functions import text as T
from quire.operators import chunking, gate, images, triage, words
from quire.operators import pages as page_ops
from quire.options import CODECS, EXIT_CODES, MODES, WARNING_CODES, Options, parse_pages
from quire.plans import limits
from quire.sources import bindings as B
from quire.storage import new_path

PAGES = """
    streams AS (
        SELECT l_orderkey AS page_key, CAST(trunc(l_extendedprice) AS BIGINT) AS length,
               CASE WHEN l_returnflag = 'R' THEN 'Image' WHEN l_linenumber = 1 THEN 'Content' ELSE 'Form' END AS kind
        FROM lineitem),
    sums AS (
        SELECT page_key, CAST(coalesce(sum(length) FILTER (kind = 'Content'), 0) AS BIGINT) AS content_bytes,
               CAST(coalesce(sum(length) FILTER (kind = 'Image'), 0) AS BIGINT) AS image_bytes,
               CAST(coalesce(sum(length) FILTER (kind = 'Form'), 0) AS BIGINT) AS other_bytes
        FROM streams GROUP BY page_key),
    pages AS (
        SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS page_index,
               o_orderkey AS page_key, content_bytes, image_bytes, other_bytes
        FROM orders JOIN sums ON page_key = o_orderkey),
    scored AS (
        SELECT *, image_bytes / CAST(greatest(1, content_bytes + image_bytes + other_bytes) AS DOUBLE) AS fraction FROM pages),
    gated AS (
        SELECT *, fraction >= 0.30 AS worthy, NOT bool_or(fraction >= 0.30) OVER (PARTITION BY doc_id) AS whole_doc FROM scored),
    routed AS (
        SELECT *, CASE WHEN whole_doc THEN 'passthrough' WHEN worthy THEN 'process' ELSE 'verbatim' END AS route FROM gated),
    docs AS (
        SELECT doc_id, count(*) AS pages, count(*) FILTER (route = 'process') AS processed, count(*) FILTER (route = 'verbatim') AS verbatim,
               bool_and(whole_doc) AS whole_doc,
               coalesce(list(page_index ORDER BY page_index) FILTER (route = 'verbatim'), []) AS verbatim_pages
        FROM routed GROUP BY doc_id)
"""
OPTIONS = Options()
CHUNK_CAP = 500_000
PAGE_SPEC = "1,3-5, 8,30-32"

CHUNKS = f"""
    costs AS (
        SELECT doc_id, page_index, content_bytes + image_bytes + other_bytes AS cost,
               sum(content_bytes + image_bytes + other_bytes) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS n
        FROM pages),
    fold AS (
        SELECT doc_id, page_index, cost, cost AS size, 1 AS chunk_no, total <= {CHUNK_CAP} OR n <= 1 AS whole FROM costs WHERE page_index = 0
        UNION ALL
        SELECT c.doc_id, c.page_index, c.cost,
               CASE WHEN NOT f.whole AND f.size + c.cost > {CHUNK_CAP} THEN c.cost ELSE f.size + c.cost END,
               CASE WHEN NOT f.whole AND f.size + c.cost > {CHUNK_CAP} THEN f.chunk_no + 1 ELSE f.chunk_no END, f.whole
        FROM fold f JOIN costs c ON c.doc_id = f.doc_id AND c.page_index = f.page_index + 1),
    chunks AS (
        SELECT doc_id, chunk_no, count(*) AS pages, CAST(sum(cost) AS BIGINT) AS bytes, max(chunk_no) OVER (PARTITION BY doc_id) AS chunks
        FROM fold GROUP BY doc_id, chunk_no)
"""


def _scored(spark, sf_dir):
    return gate.score_pages(B.pages(spark, sf_dir), OPTIONS)


def _costs(spark, sf_dir):
    return B.pages(spark, sf_dir).select("doc_id", "page_index", (F.col("content_bytes") + F.col("image_bytes") + F.col("other_bytes")).alias("cost"))


def _chunks(spark, sf_dir):
    return chunking.chunk_table(chunking.assign_chunks(_costs(spark, sf_dir), CHUNK_CAP), CHUNK_CAP)


@query(f"WITH {PAGES} SELECT doc_id, page_index, page_key, content_bytes, image_bytes, other_bytes, round(fraction, 6) AS fraction, fraction >= 0.30 AS worthy FROM scored")
def page_image_fraction(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("fraction", F.round("fraction", 6))


@query(f"WITH {PAGES} SELECT doc_id, page_index, round(fraction, 6) AS fraction, worthy, whole_doc, route FROM routed")
def gate_page_decision(spark, sf_dir):
    gated = gate.gate_pages(_scored(spark, sf_dir))
    return gated.select("doc_id", "page_index", F.round("fraction", 6).alias("fraction"), "worthy", "whole_doc", "route")


@query(f"""
    WITH {PAGES}
    SELECT doc_id, pages, processed, verbatim, whole_doc, array_to_string(verbatim_pages, ',') AS verbatim_pages,
           CASE WHEN whole_doc THEN 'passthrough-no-image-content' WHEN verbatim > 0 AND verbatim < pages THEN 'pages-skipped-verbatim-' || verbatim END AS warning,
           CASE WHEN whole_doc THEN 'passthrough' WHEN verbatim > 0 THEN 'partial' ELSE 'full' END AS status
    FROM docs
""")
def gate_skipped_pages(spark, sf_dir):
    rows = gate.doc_gate(gate.gate_pages(_scored(spark, sf_dir)))
    return rows.withColumn("verbatim_pages", F.array_join("verbatim_pages", ","))


@query(f"""
    WITH {PAGES}
    SELECT doc_id, page_index, CASE WHEN page_index >= 5 THEN true ELSE fraction >= 0.30 END AS worthy FROM scored
""")
def gate_flag_padding(spark, sf_dir):
    flags = _scored(spark, sf_dir)
    return gate.complete_flags(flags.select("doc_id", "page_index"), flags.filter("page_index < 5"))


@query(f"WITH RECURSIVE {PAGES}, {CHUNKS} SELECT doc_id, page_index, CAST(cost AS BIGINT) AS cost, chunk_no FROM fold")
def chunk_assign(spark, sf_dir):
    return chunking.assign_chunks(_costs(spark, sf_dir), CHUNK_CAP)


@query(f"""
    WITH RECURSIVE {PAGES}, {CHUNKS}
    SELECT doc_id, chunk_no, pages, bytes, chunks,
           'doc' || doc_id || '_' || lpad(CAST(chunk_no AS VARCHAR), CAST(greatest(3, length(CAST(chunks AS VARCHAR))) AS INTEGER), '0') || '.pdf' AS name
    FROM chunks
""")
def chunk_names(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_no", "pages", "bytes", "chunks", "name")


@query(f"WITH RECURSIVE {PAGES}, {CHUNKS} SELECT doc_id, chunk_no, pages, bytes FROM chunks WHERE bytes > {CHUNK_CAP}")
def chunk_oversize(spark, sf_dir):
    return _chunks(spark, sf_dir).filter("oversize").select("doc_id", "chunk_no", "pages", "bytes")


@query(f"""
    WITH RECURSIVE {PAGES}, {CHUNKS},
    counts AS (SELECT doc_id, max(chunks) AS chunks FROM chunks GROUP BY doc_id),
    files AS (SELECT doc_id, 'doc' || doc_id || '_' || lpad(CAST(page_index + 1 AS VARCHAR), 3, '0') || CASE WHEN page_index % 5 = 4 THEN '.tmp' ELSE '.pdf' END AS name, page_index + 1 AS n FROM pages)
    SELECT doc_id, name FROM files JOIN counts USING (doc_id) WHERE n > chunks AND name LIKE '%.pdf'
""")
def stale_chunks(spark, sf_dir):
    """Files of an earlier run, one for each page; every fifth is no chunk."""
    base = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    ext = F.when(F.col("page_index") % 5 == 4, ".tmp").otherwise(".pdf")
    existing = B.pages(spark, sf_dir).select("doc_id", base.alias("base"), F.lit(".pdf").alias("ext"), naming.numbered(base, F.col("page_index") + 1, F.lit(3), ext).alias("name"))
    counts = chunking.assign_chunks(_costs(spark, sf_dir), CHUNK_CAP).groupBy("doc_id").agg(F.max("chunk_no").alias("chunks"))
    return chunking.stale_chunks(existing, counts)


@query("""
    SELECT p_partkey, 'part-' || p_size || CASE p_size % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.png' WHEN 3 THEN '.webp' WHEN 4 THEN '.pdf' ELSE '' END AS path,
           CASE WHEN p_partkey % 4 = 0 THEN 'png' ELSE CASE p_size % 6 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' WHEN 3 THEN 'webp' ELSE 'pdf' END END AS format,
           p_partkey % 4 = 0 AND p_size % 6 IN (0, 1, 3, 4) AS overridden,
           'part_' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '.png' AS image_name
    FROM part
""")
def output_format(spark, sf_dir):
    part = B.table(spark, sf_dir, "part")
    exts = F.array(*[F.lit(x) for x in (".jpg", ".JPEG", ".png", ".webp", ".pdf", "")])
    path = F.concat(F.lit("part-"), F.col("p_size").cast("string"), F.get(exts, F.col("p_size") % 6))
    explicit = F.when(F.col("p_partkey") % 4 == 0, "png")
    rows = part.select("p_partkey", path.alias("path"), naming.resolve_format(explicit, path).alias("f"), naming.image_name(F.lit("part"), F.col("p_size"), F.lit(50), F.lit(50), F.lit(".png")).alias("image_name"))
    return rows.select("p_partkey", "path", "f.format", "f.overridden", "image_name")


PROFILES = {
    "AUTOMOBILE": Options(),
    "BUILDING": Options(allow_signed_invalidation=True, password="x"),
    "FURNITURE": Options(preserve_signatures=True, max_pages=5000),
    "HOUSEHOLD": Options(allow_certified_invalidation=True, max_input_mb=100.0),
    "MACHINERY": Options(min_input_mb=20.0, allow_signed_invalidation=True, allow_certified_invalidation=True),
}

POLICY = """
    flags AS (
        SELECT c_custkey AS doc_id, c_mktsegment AS profile, c_custkey % 17 = 0 AS enc, c_custkey % 19 = 0 AS cert, c_custkey % 7 = 0 OR c_custkey % 19 = 0 AS sig,
               (c_custkey * 37) % 12000 AS pages, (c_custkey * 7919) % 400 AS mb, c_custkey % 23 = 0 AS huge FROM customer),
    decided AS (
        SELECT *, CASE
            WHEN enc AND profile <> 'BUILDING' THEN 'E-INPUT-ENCRYPTED'
            WHEN cert AND profile NOT IN ('HOUSEHOLD', 'MACHINERY') THEN 'E-INPUT-CERTIFIED'
            WHEN sig AND NOT cert AND profile = 'FURNITURE' THEN 'PASSTHROUGH-SIGNED'
            WHEN sig AND NOT cert AND profile NOT IN ('BUILDING', 'MACHINERY') THEN 'E-INPUT-SIGNED'
            WHEN pages > CASE profile WHEN 'FURNITURE' THEN 5000 ELSE 10000 END THEN 'E-INPUT-OVERSIZE'
            WHEN mb > CASE profile WHEN 'HOUSEHOLD' THEN 100 ELSE 250 END THEN 'E-INPUT-OVERSIZE'
            WHEN huge THEN 'E-INPUT-DECOMPRESSION-BOMB'
            WHEN profile = 'MACHINERY' AND mb < 20 THEN 'PASSTHROUGH-SMALL'
            ELSE 'PROCEED' END AS decision
        FROM flags)
"""


@query(f"WITH {POLICY} SELECT doc_id, profile, decision FROM decided")
def policy_decision(spark, sf_dir):
    return triage.apply_policy(B.triage_flags(spark, sf_dir), PROFILES).select("doc_id", "profile", "decision")


@query(f"""
    WITH {POLICY}
    SELECT decision, CASE decision WHEN 'E-INPUT-ENCRYPTED' THEN 10 WHEN 'E-INPUT-SIGNED' THEN 11 WHEN 'E-INPUT-OVERSIZE' THEN 12 WHEN 'E-INPUT-CERTIFIED' THEN 15
           WHEN 'E-INPUT-DECOMPRESSION-BOMB' THEN 16 ELSE 0 END AS exit_code, count(*) AS docs
    FROM decided GROUP BY 1, 2
""")
def policy_exit_code(spark, sf_dir):
    decided = triage.apply_policy(B.triage_flags(spark, sf_dir), PROFILES)
    return decided.groupBy("decision", "exit_code").agg(F.count(F.lit(1)).alias("docs"))


@query("""
    SELECT * FROM (VALUES ('OK', 0, 'ok'), ('NOOP-PASSTHROUGH', 2, 'passed through'), ('E-INPUT-ENCRYPTED', 10, 'encrypted without password'), ('E-INPUT-SIGNED', 11, 'signed'), ('E-INPUT-OVERSIZE', 12, 'oversize'),
        ('E-INPUT-CORRUPT', 13, 'corrupt'), ('E-INPUT-NOT-PDF', 13, 'no such format'), ('E-INPUT-MALICIOUS', 14, 'malicious'), ('E-INPUT-CERTIFIED', 15, 'certifying signature'), ('E-INPUT-DECOMPRESSION-BOMB', 16, 'decompression bomb'),
        ('E-ENV-MISSING', 17, 'environment'), ('E-MEM-CAP', 18, 'memory cap'), ('E-HOST-RESOURCE', 19, 'host resource'), ('E-VERIFIER-FAIL', 20, 'content drift'), ('E-ENGINE-ERROR', 30, 'engine error'),
        ('E-OCR-TIMEOUT', 30, 'recognition timeout'), ('E-TIMEOUT-PER-PAGE', 30, 'page timeout'), ('E-TIMEOUT-TOTAL', 30, 'total timeout'), ('E-USAGE', 40, 'usage')) t(code, exit_code, label)
""")
def exit_codes(spark, sf_dir):
    return spark.createDataFrame([(code, number, label) for code, (number, label) in EXIT_CODES.items()], "code string, exit_code int, label string")


@query("""
    SELECT unnest(['W-MAX-OUTPUT-MB-IMAGE-MODE', 'W-MAX-OUTPUT-MB-STDOUT', 'W-OUTPUT-FORMAT-EXTENSION-OVERRIDE', 'W-CHUNKS-EXCEED-CAP', 'W-STALE-CHUNK-FILES', 'W-SINGLE-CHUNK-OVERSIZE', 'W-VERIFIER-SKIPPED', 'W-VERIFIER-FAILED',
        'W-IMAGE-EXPORT-PARTIAL-FAILURE', 'W-CHUNK-WRITE-PARTIAL-FAILURE', 'W-PASSTHROUGH-SIGNED', 'W-MEM-RSS-WATCHDOG', 'W-CAPS-UNAVAILABLE', 'W-CAPS-FAILED', 'W-WATCHDOG-DIED']) AS code
""")
def warning_codes(spark, sf_dir):
    return spark.createDataFrame([(code,) for code in WARNING_CODES], "code string")


@query("""
    WITH f AS (
        SELECT c_custkey AS doc_id, c_custkey % 17 = 0 AS enc, c_custkey % 34 = 0 AS password_ok, c_custkey % 29 <> 0 AS parse_ok, c_custkey % 5 = 1 AS bit, c_custkey % 19 = 0 AS mdp,
               c_custkey % 4 = 0 AS archival, c_custkey % 6 = 0 AS tagged, c_custkey % 3 = 0 AS linear FROM customer),
    k AS (SELECT *, parse_ok AND NOT (enc AND NOT password_ok) AS known, enc AND NOT password_ok AS locked FROM f)
    SELECT doc_id, CAST(doc_id * 10 AS BIGINT) AS bytes, CAST(CASE WHEN known THEN doc_id % 50 ELSE 0 END AS BIGINT) AS pages, enc AS is_encrypted, known AND (bit OR mdp) AS is_signed, known AND mdp AS is_certified,
           linear AS is_linearized, known AND archival AS is_archival, known AND tagged AS is_tagged, CASE WHEN known THEN 'maker ' || doc_id % 9 END AS producer,
           CASE WHEN NOT parse_ok THEN 'E-INPUT-CORRUPT' END AS error_code,
           CASE WHEN locked THEN 'require-password' WHEN known AND (mdp OR bit) THEN 'refuse' ELSE 'proceed' END AS classification
    FROM k
""")
def triage_report(spark, sf_dir):
    key = F.col("c_custkey")
    docs = B.table(spark, sf_dir, "customer").select(
        key.alias("doc_id"), (key * 10).alias("bytes"), F.pmod(key, F.lit(50)).alias("pages"), (key % 17 == 0).alias("is_encrypted"), (key % 34 == 0).alias("password_ok"),
        (key % 29 != 0).alias("parse_ok"), F.when(key % 5 == 1, "3").when(key % 5 == 2, "x").otherwise("2").alias("sig_flags"), (key % 19 == 0).alias("has_doc_mdp"),
        F.when(key % 4 == 0, "<pdfaid:part>2").alias("xmp"), F.when(key % 6 == 0, True).alias("marked"), F.lit(None).cast("boolean").alias("has_structure"),
        F.concat(F.lit("maker "), (key % 9).cast("string")).alias("producer"), F.when(key % 3 == 0, "%PDF /Linearized 1.0").otherwise("%PDF").alias("head"),
    )
    return triage.triage(docs)


@query("SELECT page_id, regexp_matches(substr(html, 1, 1024), '/Linearized\\s+[0-9.]+') AS linearized, regexp_matches(substr(html, 1, 1024), '<!DOCTYPE\\s+html') AS has_doctype FROM pages")
def linearized_probe(spark, sf_dir):
    rows = B.table(spark, sf_dir, "pages")
    probe = F.substr("html", F.lit(1), F.lit(1024)).rlike(r"<!DOCTYPE\s+html")
    return rows.select("page_id", triage.is_linearized(F.col("html")).alias("linearized"), probe.alias("has_doctype"))


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN ['/JBIG2Decode'] WHEN 1 THEN ['/FlateDecode', '/DCTDecode'] END AS filters FROM lineitem)
    SELECT l_orderkey, bool_or(coalesce(list_contains(filters, '/JBIG2Decode'), false)) AS has_jbig2 FROM s GROUP BY l_orderkey
""")
def stream_filters(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    filters = F.when(n == 0, F.array(F.lit("/JBIG2Decode"))).when(n == 1, F.array(F.lit("/FlateDecode"), F.lit("/DCTDecode")))
    return B.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(triage.has_filter(filters)).alias("has_jbig2"))


@query("""
    WITH RECURSIVE e AS (
        SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS child, event_type AS key FROM events),
    walk AS (
        SELECT doc_id, child AS node, key, 1 AS level FROM e WHERE child = 1
        UNION ALL
        SELECT e.doc_id, e.child, e.key, w.level + 1 FROM walk w JOIN e ON e.doc_id = w.doc_id AND e.child // 2 = w.node WHERE w.level < 65)
    SELECT doc_id, array_to_string(list_sort(list(DISTINCT key)), ',') AS keys, count(*) AS nodes, max(level) AS max_level, false AS too_deep,
           bool_or(key IN ('JavaScript', 'JS')) AS has_scripts, bool_or(key IN ('EmbeddedFiles', 'EmbeddedFile')) AS has_attachments
    FROM walk GROUP BY doc_id
""")
def tree_keys(spark, sf_dir):
    found = triage.reachable_keys(B.object_edges(spark, sf_dir)).withColumn("f", triage.key_flags(F.col("keys")))
    return found.select("doc_id", F.array_join("keys", ",").alias("keys"), "nodes", "max_level", "too_deep", "f.has_scripts", "f.has_attachments")


@query("""
    WITH g AS (SELECT p_partkey, p_size * 72.0 - 72 AS w, p_retailprice * 20 AS h FROM part),
    x AS (SELECT *, CAST(round_even(w * 300 / 72, 0) AS BIGINT) AS w_px, CAST(round_even(h * 300 / 72, 0) AS BIGINT) AS h_px FROM g)
    SELECT p_partkey, w_px, h_px, CASE WHEN w <= 0 OR h <= 0 THEN 'invalid' WHEN w_px * h_px > 715827882 THEN 'bomb' ELSE 'ok' END AS guard,
           greatest(w, h) > 14400 AS axis_bomb, greatest(1, CAST(round_even(w * 150 / 72, 0) AS BIGINT)) AS target_px
    FROM x
""")
def render_guard(spark, sf_dir):
    w, h, dpi = F.col("p_size") * 72.0 - 72, F.col("p_retailprice") * 20, F.lit(300)
    zero = F.lit(0.0)
    return B.table(spark, sf_dir, "part").select(
        "p_partkey", geometry.points_to_pixels(w, dpi).alias("w_px"), geometry.points_to_pixels(h, dpi).alias("h_px"), geometry.render_guard(w, h, dpi).alias("guard"),
        geometry.axis_bomb(zero, zero, w, h).alias("axis_bomb"), geometry.target_dimension(w, F.lit(150)).alias("target_px"),
    )


@query(f"WITH {PAGES} SELECT doc_id, page_index, page_key FROM pages WHERE page_index + 1 IN (1, 3, 4, 5, 8, 30, 31, 32)")
def pages_spec_select(spark, sf_dir):
    return gate.select_pages(B.pages(spark, sf_dir), parse_pages(PAGE_SPEC)).select("doc_id", "page_index", "page_key")


@query(f"""
    WITH {PAGES}, n AS (SELECT doc_id, count(*) AS n FROM pages GROUP BY doc_id)
    SELECT doc_id, page_no FROM n, (SELECT unnest([1, 3, 4, 5, 8, 30, 31, 32]) AS page_no) WHERE page_no > n
""")
def pages_out_of_range(spark, sf_dir):
    return gate.missing_pages(B.pages(spark, sf_dir), parse_pages(PAGE_SPEC))


LISTS = "lists AS (SELECT o_custkey AS doc_id, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey)"


def _order_lists(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))


@query(f"""
    WITH {LISTS}
    SELECT doc_id, '[' || array_to_string(ids[1:10], ', ') || CASE WHEN len(ids) > 10 THEN ', ... (+' || (len(ids) - 10) || ' more)' ELSE '' END || ']' AS short FROM lists
""")
def page_list_short(spark, sf_dir):
    return _order_lists(spark, sf_dir).select("doc_id", T.page_list_short(F.col("ids")).alias("short"))


@query(f"""
    WITH {LISTS}
    SELECT doc_id, array_to_string(ids[1:10], ',') || CASE WHEN len(ids) > 10 THEN '+' || (len(ids) - 10) ELSE '' END AS tag,
           CASE WHEN len(ids) <= 10 THEN 'pages [' || array_to_string(ids, ', ') || ']'
                ELSE len(ids) || ' pages ([' || array_to_string(ids[1:5], ', ') || '] ... [' || array_to_string(ids[len(ids) - 2:len(ids)], ', ') || '])' END AS display
    FROM lists
""")
def failing_pages_fmt(spark, sf_dir):
    return _order_lists(spark, sf_dir).select("doc_id", T.failing_pages_tag(F.col("ids")).alias("tag"), T.failing_pages_display(F.col("ids")).alias("display"))


@query("""
    WITH g AS (
        SELECT user_id AS page_id, row_number() OVER w - 1 AS i, event_type AS ch, epoch_us(ts) / 3.6e9 AS place, lag(epoch_us(ts) / 3.6e9) OVER w AS before, value
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, sum(CASE WHEN before IS NULL OR place - before > 6.0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) - 1 AS word_no FROM g)
    SELECT page_id, CAST(word_no AS INTEGER) AS word_no, string_agg(ch, '' ORDER BY i) AS text, count(*) AS glyphs, round(min(place), 6) AS "left", round(max(place), 6) AS "right",
           arg_min(ch, i) AS style, round(arg_min(value, i), 6) AS first_value
    FROM n GROUP BY page_id, word_no
""")
def word_islands(spark, sf_dir):
    glyphs = B.glyphs(spark, sf_dir).withColumn("style", F.col("ch"))
    found = words.words(glyphs, carry=["style", "value"])
    return found.select("page_id", "word_no", "text", "glyphs", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "style", F.round("value", 6).alias("first_value"))


@query("""
    WITH g AS (SELECT p_partkey, p_size * 3.5 AS "left", p_size * 2.25 AS bottom, p_size * 3.5 + p_partkey % 7 AS "right", p_size * 2.25 + p_partkey % 5 * 0.5 AS top FROM part)
    SELECT p_partkey, CAST(round_even("left" * 2.5, 0) AS BIGINT) AS x, CAST(round_even((792 - top) * 2.5, 0) AS BIGINT) AS y,
           greatest(1, CAST(round_even(("right" - "left") * 2.5, 0) AS BIGINT)) AS w, greatest(1, CAST(round_even((top - bottom) * 2.5, 0) AS BIGINT)) AS h
    FROM g
""")
def box_pixels(spark, sf_dir):
    left, bottom = F.col("p_size") * 3.5, F.col("p_size") * 2.25
    right, top = left + F.col("p_partkey") % 7, bottom + F.col("p_partkey") % 5 * 0.5
    box = geometry.box_to_pixels(left, bottom, right, top, F.lit(2.5), F.lit(2.5), F.lit(792.0))
    return B.table(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.x", "b.y", "b.w", "b.h")


FILE_CAP = 2_000_000
FILES = CHUNKS.replace(str(CHUNK_CAP), str(FILE_CAP))


@query(f"""
    WITH RECURSIVE {PAGES}, {FILES}, firsts AS (SELECT doc_id, chunk_no, min(page_index) AS first_page FROM fold GROUP BY doc_id, chunk_no)
    SELECT 'doc' || doc_id || '_' || lpad(CAST(chunk_no AS VARCHAR), CAST(greatest(3, length(CAST(chunks AS VARCHAR))) AS INTEGER), '0') || '.pdf' AS name, doc_id, chunk_no, first_page, pages, bytes, CAST(1 AS BIGINT) AS files
    FROM chunks JOIN firsts USING (doc_id, chunk_no)
""")
def chunk_files(spark, sf_dir):
    """Chunks written as files of their names and read back."""
    path = new_path(spark, "chunk-files")
    chunking.write_chunks(chunking.assign_chunks(_costs(spark, sf_dir), FILE_CAP), path, FILE_CAP)
    rows = chunking.read_chunks(spark, path)
    return rows.groupBy("name", "doc_id", "chunk_no").agg(
        F.min("page_index").alias("first_page"), F.count(F.lit(1)).alias("pages"), F.sum("cost").alias("bytes"), F.count_distinct("file").alias("files")
    )


@query("""
    WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS page_index FROM orders),
    a AS (SELECT *, CASE WHEN k % 3 = 0 THEN CAST(greatest(k % 20000, 500) AS DOUBLE) WHEN k % 7 = 0 OR k % 11 = 0 THEN NULL WHEN k % 101 = 0 THEN 14500.5 ELSE 792.0 END AS axis FROM p)
    SELECT doc_id, max(axis) AS axis_pt, min(page_index) FILTER (axis > 14400) + 1 AS first_bomb FROM a GROUP BY doc_id
""")
def page_axis_cap(spark, sf_dir):
    """Orders as pages with crop boxes, media boxes and malformed ones."""
    k = F.col("o_orderkey")
    index = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    box = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    crop = F.when(k % 3 == 0, box("0", "0", (k % 20_000).cast("string"), "500")).when(k % 3 == 1, F.array().cast("array<string>"))
    media = F.when(k % 7 == 0, box("a", "0", "612", "792")).when(k % 11 == 0, box("0", "0", "612")).when(k % 101 == 0, box("14400.5", "0", "-100", "792")).otherwise(box("0", "0", "612", "792"))
    pages = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), index.alias("page_index"), crop.alias("crop"), media.alias("media"))
    return triage.page_axes(pages)


SPLIT_SPEC = "1-2,4"
SPLIT = """
    numbered AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS INTEGER) AS page_index, text AS body FROM conversations),
    picked AS (SELECT *, CAST(strlen(body) AS BIGINT) AS input_bytes FROM numbered WHERE page_index + 1 IN (1, 2, 4))
"""


def _conversation_pages(spark, sf_dir):
    """Conversations as documents, a message a page."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return B.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.transform(listed, lambda x: x["text"]).alias("pages"))


@query(f"WITH {SPLIT} SELECT doc_id, page_index, body, input_bytes FROM picked")
def page_split(spark, sf_dir):
    return page_ops.split_pages(_conversation_pages(spark, sf_dir), parse_pages(SPLIT_SPEC))


@query(f"""
    WITH {SPLIT}, got AS (SELECT * FROM picked WHERE NOT (doc_id % 5 = 0 AND page_index = 1)),
    c AS (SELECT doc_id, count(*) AS wanted FROM picked GROUP BY doc_id),
    g AS (SELECT doc_id, count(*) AS page_count, string_agg(body, chr(12) ORDER BY page_index) AS merged FROM got GROUP BY doc_id)
    SELECT doc_id, page_count, CASE WHEN page_count <> wanted THEN 'E-ENGINE-ERROR' END AS error_code, CASE WHEN page_count = wanted THEN sha256(merged) END AS merged_sha256 FROM c JOIN g USING (doc_id)
""")
def page_merge(spark, sf_dir):
    """Chosen pages put together; every fifth document has lost one."""
    picked = page_ops.split_pages(_conversation_pages(spark, sf_dir), parse_pages(SPLIT_SPEC))
    got = picked.filter(~((F.col("doc_id") % 5 == 0) & (F.col("page_index") == 1)))
    made = page_ops.merge_pages(got, picked)
    return made.select("doc_id", "page_count", "error_code", F.sha2(F.array_join("pages", "\f").cast("binary"), 256).alias("merged_sha256"))


@query("""
    WITH p AS (SELECT vec_id % 7 AS doc_id, CAST(vec_id // 7 AS INTEGER) AS page_index, vec_id, CASE WHEN vec_id % 97 = 0 THEN 200000.0 ELSE 8.0 + vec_id % 5 END AS w, CASE WHEN vec_id % 50 = 49 THEN 0.0 WHEN vec_id % 97 = 0 THEN 200000.0 ELSE 8.0 END AS h FROM embeddings),
    n AS (SELECT *, page_index + 1 AS page_no, greatest(3, length(CAST(count(*) OVER (PARTITION BY doc_id) AS VARCHAR)), length(CAST(max(page_index + 1) OVER (PARTITION BY doc_id) AS VARCHAR))) AS digits FROM p),
    c AS (SELECT *, CASE WHEN w <= 0 OR h <= 0 THEN 'E-INPUT-CORRUPT' WHEN w > 1000 THEN 'E-INPUT-DECOMPRESSION-BOMB' END AS error_code FROM n)
    SELECT doc_id, page_index, page_no, 'doc' || doc_id || '_' || lpad(CAST(page_no AS VARCHAR), CAST(digits AS INTEGER), '0') || '.png' AS name, greatest(1, CAST(round_even(w * 150 / 72, 0) AS BIGINT)) AS width_px, greatest(1, CAST(round_even(h * 150 / 72, 0) AS BIGINT)) AS height_px,
           error_code, error_code IS NULL AND vec_id % 11 <> 0 AS encoded, coalesce(error_code, CASE WHEN vec_id % 11 = 0 THEN 'no raster' END) AS error
    FROM c
""")
def image_export(spark, sf_dir):
    """Every raster as an image of its own; some pages have no size, are too large or were not rendered."""
    v = F.col("vec_id")
    sized = B.rasters(spark, sf_dir).withColumns(
        {
            "doc_id": v % 7, "page_index": F.floor(v / 7).cast("int"), "width_pt": F.when(v % 97 == 0, 200_000.0).otherwise(8.0 + v % 5),
            "height_pt": F.when(v % 50 == 49, 0.0).when(v % 97 == 0, 200_000.0).otherwise(8.0),
        }
    )
    planned = images.plan_images(sized.select(F.col("doc_id").cast("long").alias("doc_id"), "page_index", "width_pt", "height_pt"), "png", 150)
    made = images.export_images(planned, sized.filter(v % 11 != 0))
    return made.select("doc_id", "page_index", "page_no", "name", "width_px", "height_px", "error_code", (F.coalesce("image_bytes", F.lit(0)) > 0).alias("encoded"), "error")


@query("""
    WITH g AS (SELECT event_id AS page_id, CAST(user_id AS INTEGER) AS i, event_type, value, event_id % 5 AS k FROM events)
    SELECT page_id, i, CASE WHEN k <> 0 THEN event_type END AS font_name, CASE WHEN k NOT IN (1, 2) THEN CAST(page_id % 7 + 1 AS INTEGER) END AS font_flags, CASE WHEN k <> 3 AND round(value - 10, 4) > 0 THEN round(value - 10, 4) END AS font_size_pt,
           CASE WHEN k <> 4 THEN CAST(400 + page_id % 3 * 100 AS INTEGER) END AS font_weight, CASE WHEN k NOT IN (2, 3) THEN CAST(page_id % 256 AS VARCHAR) || ',0,255' END AS color, CASE WHEN k <> 1 THEN round((792 - page_id % 800) * 2.5, 6) END AS baseline_y
    FROM g
""")
def glyph_styles(spark, sf_dir):
    """Events as probed glyphs; every fifth of a kind has one field that can't be read."""
    e, k = F.col("event_id"), F.col("event_id") % 5
    zero = F.lit(0.0)
    matrix = F.array(F.lit(1.0), zero, zero, F.lit(1.0), zero, (e % 800).cast("double"))
    fill = F.array((e % 256).cast("int"), F.lit(0), F.lit(255), F.lit(255))
    probes = B.table(spark, sf_dir, "events").select(
        e.alias("page_id"), F.col("user_id").cast("int").alias("i"), F.when(k == 0, "").otherwise(F.col("event_type")).alias("font"), F.when(k == 1, "0").when(k == 2, "x").otherwise((e % 7 + 1).cast("string")).alias("flags"),
        F.when(k == 3, "none").otherwise(F.round(F.col("value") - 10, 4).cast("string")).alias("size"), F.when(k == 4, "-1").otherwise((400 + e % 3 * 100).cast("string")).alias("weight"),
        F.when(k == 2, F.slice(fill, 1, 2)).when(k != 3, fill).alias("fill"), F.when(k != 1, matrix).alias("matrix"),
    )
    found = words.glyph_styles(probes, F.lit(792.0), F.lit(2.5)).select("page_id", "i", "style.*")
    return found.withColumns({"color": F.array_join(F.transform("color", lambda x: x.cast("string")), ","), "baseline_y": F.round("baseline_y", 6)})


@query("""
    SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 19 = 0 THEN 'certified-invalidated-allowed' WHEN c_custkey % 7 = 0 THEN 'invalidated-allowed' ELSE 'none' END AS allowed,
           CASE WHEN c_custkey % 19 = 0 OR c_custkey % 7 = 0 THEN 'invalidated-allowed' ELSE 'none' END AS signed_only, 'none' AS neither FROM customer
""")
def signature_outcome(spark, sf_dir):
    made = lambda **o: triage.signature_outcome(F.col("is_signed"), F.col("is_certified"), Options(**o))
    both = made(allow_signed_invalidation=True, allow_certified_invalidation=True)
    return B.triage_flags(spark, sf_dir).select("doc_id", both.alias("allowed"), made(allow_signed_invalidation=True).alias("signed_only"), made().alias("neither"))


@query("""
    SELECT m.mode, c.codec, f.forced, CASE WHEN m.mode = 'fast' THEN 200 ELSE 300 END AS source_dpi, CASE WHEN m.mode = 'fast' THEN 'jpeg' ELSE c.codec END AS used_codec,
           CASE WHEN m.mode = 'fast' AND c.codec = 'jpeg2000' THEN 'jpeg2000-demoted-to-jpeg-in-fast-mode' ELSE '' END AS warnings, f.forced <> 'nothing' AS all_pages
    FROM (SELECT unnest(['fast', 'standard', 'safe']) AS mode) m, (SELECT unnest(['jpeg', 'jpeg2000']) AS codec) c, (SELECT unnest(['nothing', 're_ocr', 'strip_text_layer', 'legal_codec_profile', 'verify']) AS forced) f
""")
def effects_of_options(spark, sf_dir):
    """What options lead to: resolution, codec and its warnings, and whether every page is processed."""
    forced = {"nothing": {}, "re_ocr": {"re_ocr": True}, "strip_text_layer": {"strip_text_layer": True}, "legal_codec_profile": {"legal_codec_profile": "x"}, "verify": {"skip_verify": False}}
    made = [(m, c, f, Options(mode=m, bg_codec=c, **extra)) for m in MODES for c in CODECS for f, extra in forced.items()]
    rows = [(m, c, f, o.source_dpi, o.effective_codec[0], ",".join(o.effective_codec[1]), o.forces_all_pages) for m, c, f, o in made]
    return spark.createDataFrame(rows, "mode string, codec string, forced string, source_dpi int, used_codec string, warnings string, all_pages boolean")


@query("""
    SELECT p_partkey, greatest(1, least(CASE WHEN p_size % 9 = 0 THEN 7 ELSE p_size % 9 END, greatest(1, p_partkey % 6))) AS eight, greatest(1, least(CASE WHEN p_size % 9 = 0 THEN 1 ELSE p_size % 9 END, greatest(1, p_partkey % 6))) AS one FROM part
""")
def worker_counts(spark, sf_dir):
    setting, pages = (F.col("p_size") % 9).cast("long"), F.col("p_partkey") % 6
    return B.table(spark, sf_dir, "part").select("p_partkey", limits.worker_count(setting, pages, F.lit(8)).alias("eight"), limits.worker_count(setting, pages, F.lit(1)).alias("one"))
