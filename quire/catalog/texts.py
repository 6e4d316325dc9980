"""Queries on text measures, formats and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import query
from quire.functions import text as T
from quire.operators import report, strategy, words
from quire.options import Options
from quire.sources import bindings as B

TEXTS = """
    texts AS (
        SELECT source || '-' || doc_id // 100 AS doc, CAST(row_number() OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id) - 1 AS INTEGER) AS page_index, doc_id, text AS input_text,
               CASE WHEN doc_id % 7 = 0 THEN translate(text, '6', '8') WHEN doc_id % 11 = 0 THEN regexp_replace(text, '(\\d)\\.(\\d)', '\\1\\2', 'g')
                    WHEN doc_id % 13 = 0 THEN substr(text, 1, CAST(floor(length(text) * 0.9) AS INTEGER)) ELSE text END AS output_text
        FROM documents),
    folded AS (
        SELECT *, regexp_replace(input_text, '[^\\x00-\\x7F]', '?', 'g') AS a, regexp_replace(output_text, '[^\\x00-\\x7F]', '?', 'g') AS b FROM texts)
"""
#: The edit distance; where one text begins the other, what is left of it.
DISTANCE = "CASE WHEN a = b THEN 0 WHEN starts_with(a, b) THEN length(a) - length(b) WHEN starts_with(b, a) THEN length(b) - length(a) ELSE levenshtein(a, b) END"
NUMBERS = "list_sort(list_transform(regexp_extract_all({}, '\\d+(?:[.,]\\d+)?(?:\\s*(?:mg|mcg|mL|IU|ng|g|kg|lb|oz|%))?'), lambda x: regexp_replace(x, '\\s+', '', 'g')))"


def _folded(spark, sf_dir):
    """Whole texts; the second engine counts bytes, so they are folded to ASCII."""
    return B.page_texts(spark, sf_dir).withColumns({"a": T.fold_ascii(F.col("input_text")), "b": T.fold_ascii(F.col("output_text"))})


@query("""
    WITH j AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), ' ') AS t FROM documents),
    w AS (SELECT *, list_filter(string_split(t, ' '), lambda x: regexp_full_match(x, '\\p{L}+')) AS ws, len(regexp_extract_all(t, '[\\p{L}\\s]')) AS letters FROM j),
    m AS (SELECT *, list_sum(list_transform(ws, lambda x: length(x))) / CAST(len(ws) AS DOUBLE) AS mean, len(list_filter(ws, lambda x: length(x) = 1)) / CAST(len(ws) AS DOUBLE) AS single FROM w),
    l AS (SELECT doc_id, length(t) AS chars, CASE WHEN t = '' THEN 'empty' WHEN length(t) < 30 THEN 'sparse' WHEN letters / CAST(length(t) AS DOUBLE) < 0.5 THEN 'symbols' WHEN len(ws) = 0 THEN 'no-words'
                 WHEN mean < 2 OR mean > 12 THEN 'word-length' WHEN single > 0.4 THEN 'single-chars' ELSE 'ok' END AS label FROM m)
    SELECT doc_id, chars, label, label IN ('sparse', 'ok') AS decent FROM l
""")
def text_quality(spark, sf_dir):
    rows = B.table(spark, sf_dir, "documents").select("doc_id", T.one_spaced(F.col("text")).alias("t"))
    labelled = rows.select("doc_id", F.length("t").cast("long").alias("chars"), T.quality_label(F.col("t")).alias("label"))
    return labelled.withColumn("decent", F.col("label").isin("sparse", "ok"))


@query("""
    SELECT doc_id, doc_id % 3 <> 0 AS has_native, doc_id % 5 <> 0 AS decent,
           CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 'native' ELSE 'none' END AS plain, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 'native' ELSE 'ocr' END AS searchable, 'none' AS stripped, 'ocr' AS renewed
    FROM documents
""")
def text_source_policy(spark, sf_dir):
    native, decent = F.col("doc_id") % 3 != 0, F.col("doc_id") % 5 != 0
    choose = lambda **o: strategy.text_source(native, decent, Options(**o))
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", native.alias("has_native"), decent.alias("decent"), choose().alias("plain"), choose(ocr=True).alias("searchable"), choose(strip_text_layer=True).alias("stripped"), choose(re_ocr=True).alias("renewed")
    )


@query("""
    SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'recognized ' || item_id WHEN item_id % 3 = 1 THEN 'recognized ' || item_id ELSE text END AS ground_truth FROM benchmark
""")
def ground_truth_text(spark, sf_dir):
    native = F.when(F.col("item_id") % 3 == 0, " \n\t ").when(F.col("item_id") % 3 == 2, F.col("text"))
    return B.table(spark, sf_dir, "benchmark").select("item_id", strategy.ground_truth(native, F.concat(F.lit("recognized "), F.col("item_id").cast("string"))).alias("ground_truth"))


@query(f"SELECT doc_id, array_to_string({NUMBERS.format('text')}, '|') AS numbers, len({NUMBERS.format('text')}) AS n FROM documents")
def digit_tokens(spark, sf_dir):
    found = T.number_tokens(F.col("text"), unicode_digits=False)
    return B.table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, "|").alias("numbers"), F.size(found).cast("long").alias("n"))


@query(f"WITH {TEXTS} SELECT doc_id, doc, page_index, {NUMBERS.format('input_text')} = {NUMBERS.format('output_text')} AS digits_match FROM texts")
def digit_multiset(spark, sf_dir):
    return B.page_texts(spark, sf_dir).select("doc_id", "doc", "page_index", T.same_numbers(F.col("input_text"), F.col("output_text"), unicode_digits=False).alias("digits_match"))


@query(f"""
    WITH {TEXTS}, t AS (SELECT unnest({NUMBERS.format('text')}) AS token FROM documents)
    SELECT token, count(*) AS n FROM t GROUP BY token
""")
def digit_counts(spark, sf_dir):
    tokens = B.table(spark, sf_dir, "documents").select(F.explode(T.number_tokens(F.col("text"), unicode_digits=False)).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH {TEXTS}
    SELECT doc_id, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 0 ELSE {DISTANCE} / CAST(greatest(length(a), length(b)) AS DOUBLE) END, 6) AS ratio FROM folded
""")
def lev_ratio(spark, sf_dir):
    return _folded(spark, sf_dir).select("doc_id", F.round(T.levenshtein_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(f"""
    WITH {TEXTS}
    SELECT doc_id, {DISTANCE} <= floor(greatest(length(a), length(b)) * 0.05) AS standard, {DISTANCE} <= floor(greatest(length(a), length(b)) * 0.02) AS safe FROM folded
""")
def lev_gate(spark, sf_dir):
    within = lambda c: T.levenshtein_within(F.col("a"), F.col("b"), c)
    return _folded(spark, sf_dir).select("doc_id", within(0.05).alias("standard"), within(0.02).alias("safe"))


@query("SELECT page_id, substr(sha1(list_last(string_split(url, '/'))), 1, 8) || '…' || right(list_last(string_split(url, '/')), 8) AS redacted FROM pages")
def redact_url(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", T.redact_name(F.col("url")).alias("redacted"))


@query("""
    WITH n AS (SELECT page_id, nfc_normalize('Cafe' || chr(769) || '-' || list_last(string_split(url, '/')) || '-u' || chr(776)) AS name FROM pages)
    SELECT page_id, substr(sha1(name), 1, 8) || '…' || right(name, 8) AS redacted FROM n
""")
def redact_composed(spark, sf_dir):
    """Names whose accents come as marks of their own are composed before they are redacted."""
    name = F.concat(F.lit("/in/Cafe\u0301-"), F.element_at(F.split("url", "/"), -1), F.lit("-u\u0308"))
    return B.table(spark, sf_dir, "pages").select("page_id", T.redact_name(T.nfc(name)).alias("redacted"))


@query("SELECT doc_id, '<redacted:' || length(text) || '-chars>' AS whole, '<redacted:' || least(length(text), 1000) || '-chars>' AS capped FROM documents")
def redact_text(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", T.redact_text(F.col("text")).alias("whole"), T.redact_text(F.col("text"), 1000).alias("capped"))


@query("SELECT conv_id, turn, replace(replace(replace('(' || text, '\\', '\\\\'), '(', '\\('), ')', '\\)') AS escaped FROM conversations")
def pdf_escape(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.pdf_escape(F.concat(F.lit("("), F.col("text"))).alias("escaped"))


BOXES = """
    tokens AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(0, len(string_split(text, ' ')))) AS k FROM conversations),
    boxes AS (
        SELECT conv_id, turn * 1000000 + k AS n, regexp_replace(word, '[\\s]', '', 'g') AS word, turn * 40 + conv_id % 30 + k * 3 AS x, turn * 50 AS y, CASE WHEN k % 6 = 5 THEN 0 ELSE 30 + conv_id % 50 END AS w, 10 + turn AS h
        FROM tokens)
"""


def _boxes(spark, sf_dir):
    """Every word of every message as a box."""
    tokens = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("k", "word"))
    return tokens.select(
        "conv_id", (F.col("turn") * 1_000_000 + F.col("k")).alias("n"), F.regexp_replace("word", r"\s", "").alias("word"),
        (F.col("turn") * 40 + F.col("conv_id") % 30 + F.col("k") * 3).alias("x"), (F.col("turn") * 50).alias("y"),
        F.when(F.col("k") % 6 == 5, 0).otherwise(30 + F.col("conv_id") % 50).alias("w"), (10 + F.col("turn")).alias("h"),
    )


@query(f"""
    WITH {BOXES}, o AS (
        SELECT conv_id, n, '/F-Invisible ' || format('{{:.3f}}', h * 0.75) || ' Tf' || chr(10)
            || format('{{:.2f}}', (w * 0.5) / greatest(0.5 * length(word) * (h * 0.75), 0.001) * 100) || ' Tz' || chr(10)
            || '1 0 0 1 ' || format('{{:.3f}}', x * 0.5) || ' ' || format('{{:.3f}}', 600 - (y + h) * 0.75) || ' Tm' || chr(10)
            || '(' || regexp_replace(replace(replace(replace(word, '\\', '\\\\'), '(', '\\('), ')', '\\)'), '[^\\x00-\\x7F]', '?', 'g') || ') Tj' AS op
        FROM boxes WHERE w > 0 AND h > 0 AND trim(word) <> '')
    SELECT conv_id, 'q' || chr(10) || 'BT' || chr(10) || '3 Tr' || chr(10) || string_agg(op, chr(10) ORDER BY n) || chr(10) || 'ET' || chr(10) || 'Q' || chr(10) AS stream FROM o GROUP BY conv_id
""")
def text_ops(spark, sf_dir):
    op = T.text_operators(F.col("word"), F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(800.0), F.lit(800.0), F.lit(400.0), F.lit(600.0))
    rows = _boxes(spark, sf_dir).select("conv_id", "n", op.alias("op"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "op"))), lambda x: x["op"])
    return rows.groupBy("conv_id").agg(T.text_stream(listed).alias("stream"))


@query(f"WITH {BOXES} SELECT conv_id AS page_id, string_agg(word, ' ' ORDER BY n) AS text FROM boxes WHERE trim(word) <> '' GROUP BY conv_id")
def ocr_text_join(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).select(F.col("conv_id").alias("page_id"), F.col("n").alias("word_no"), F.col("word").alias("text"), F.lit("90").alias("confidence"))
    return words.page_text(words.recognized(boxes))


@query("""
    SELECT event_id, CASE WHEN event_type = 'error' THEN -1.0 ELSE least(100.0, greatest(0.0, round(value * 3 - 50, 6))) END AS confidence FROM events WHERE event_type <> 'view'
""")
def ocr_confidence(spark, sf_dir):
    events = B.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_type") == "error", "?").otherwise(F.round(F.col("value") * 3 - 50, 6).cast("string"))
    boxes = events.select("event_id", F.when(F.col("event_type") == "view", " \n").otherwise("w").alias("text"), raw.alias("confidence"))
    return words.recognized(boxes).select("event_id", "confidence")


@query(f"WITH {TEXTS} SELECT doc_id, sha256(input_text) AS input_sha256, sha256(output_text) AS output_sha256 FROM texts")
def content_sha(spark, sf_dir):
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return B.page_texts(spark, sf_dir).select("doc_id", sha("input_text").alias("input_sha256"), sha("output_text").alias("output_sha256"))


@query("SELECT min(doc_id) AS first_doc, count(*) AS docs FROM documents GROUP BY text, lang HAVING count(*) > 1")
def canonical_dedup(spark, sf_dir):
    keyed = B.table(spark, sf_dir, "documents").select("doc_id", report.content_key(["text", "lang"]).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("docs")).filter("docs > 1").drop("key")


@query("""
    SELECT page_id, '[quire] corr=' || substr(md5(url), 1, 8) || ' ' || substr(sha1(list_last(string_split(url, '/'))), 1, 8) || '…' || right(list_last(string_split(url, '/')), 8) || ': warning [W-CHUNKS-EXCEED-CAP]: page ' || page_id AS warning,
           '[quire] error [E-INPUT-SIGNED]: refused: page ' || page_id AS refusal
    FROM pages
""")
def message_lines(spark, sf_dir):
    said = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    warning = T.message_line("quire", "warning", F.lit("W-CHUNKS-EXCEED-CAP"), said, F.col("url"), F.md5(F.col("url").cast("binary")))
    refusal = T.message_line("quire", "error", F.lit("E-INPUT-SIGNED"), F.concat(F.lit("refused: "), said))
    return B.table(spark, sf_dir, "pages").select("page_id", warning.alias("warning"), refusal.alias("refusal"))


@query("""
    SELECT o_orderkey, 'ok  ' || format('{:,}', (o_orderkey + 1) * 1000) || ' -> ' || format('{:,}', (o_orderkey + 1) * 100 * (1 + o_orderkey % 9)) || ' bytes (' || format('{:.1f}', 10.0 * (1 + o_orderkey % 9)) || '%, ratio '
           || format('{:.2f}', 10 / CAST(1 + o_orderkey % 9 AS DOUBLE)) || 'x, ' || o_orderkey % 50
           || ' pages, ' || o_orderkey % 9000 || ' ms) verifier=skipped' || CASE WHEN o_orderkey % 3 > 0 THEN ' warnings=' || o_orderkey % 3 ELSE '' END AS line
    FROM orders
""")
def report_lines(spark, sf_dir):
    k = F.col("o_orderkey")
    size, made = (k + 1) * 1000, (k + 1) * 100 * (1 + k % 9)
    line = T.report_line(size, made, report.ratio(size, made), k % 50, k % 9000, F.lit("skipped"), k % 3)
    return B.table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


@query("""
    WITH v AS (SELECT p_partkey, p_size || '.' || p_partkey % 20 || '.' || p_partkey % 7 AS version FROM part)
    SELECT p_partkey, version, version AS first_line, version AS named_line,
           p_size > 11 OR p_size_tie AND (p_partkey % 20 > 6 OR p_partkey % 20 = 6 AND p_partkey % 7 >= 3) AS meets_floor
    FROM v JOIN (SELECT p_partkey, p_size, p_size = 11 AS p_size_tie FROM part) USING (p_partkey)
""")
def version_floor(spark, sf_dir):
    key = F.col("p_partkey")
    version = F.concat_ws(".", F.col("p_size").cast("string"), (key % 20).cast("string"), (key % 7).cast("string"))
    first = T.tool_version(F.concat(F.lit("\ntool "), version, F.lit("\n library-1.84.1")))
    named = T.tool_version(F.concat(F.lit("banner 0.1\nqpdf version "), version), "qpdf")
    return B.table(spark, sf_dir, "part").select("p_partkey", version.alias("version"), first.alias("first_line"), named.alias("named_line"), T.meets_floor(F.concat(version, F.lit("-1")), F.lit("11.6.3")).alias("meets_floor"))


@query("""
    SELECT event_id, coalesce(nullif(nullif(CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'unknown' WHEN 'error' THEN NULL ELSE event_type END, ''), 'unknown'), '?') AS build, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS started_at,
           CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def build_fallback(spark, sf_dir):
    raw = F.when(F.col("event_type") == "click", "").when(F.col("event_type") == "view", "unknown").when(F.col("event_type") != "error", F.col("event_type"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return B.table(spark, sf_dir, "events").select("event_id", T.known_or(raw, F.lit("?")).alias("build"), stamp.alias("started_at"), F.from_json("props", "k long")["k"].alias("k"))
