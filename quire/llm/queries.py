"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, exact_dedup, langid, line_dedup, mixing, packing, quality, simhash, storage, token_counts, token_files

MIX_WEIGHTS = [5.0, 2.0, 1.0]
MIX_SHARE = 1.5
PACK_TOKENS = 2048
END_OF_DOCUMENT = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), width=4, distance=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return rest.select("doc_id", "n_lines", "n_deleted", exact_dedup.sha256_hex(F.col("text")).alias("text_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_tokens(documents(spark, sf_dir), PACK_TOKENS)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, PACK_TOKENS)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    prototypes = langid.train(docs.filter("NOT held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), prototypes).drop("text")


#: The tool that the conversations' derived calls use.
CHAT_TOOLS = {
    "lookup": {
        "type": "object",
        "properties": {"query": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0, "maximum": 6}},
        "required": ["query", "turn"],
        "additionalProperties": False,
    }
}


def tool_traffic(messages: DataFrame) -> DataFrame:
    """Messages of a table without tool calls, with such calls made of them.

    Every assistant message becomes a message with one call, whose query is its
    text; every user message after the first turn also is a tool message that
    answers the call of the turn before, so calls of last turns have no result.
    """
    name = F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    before = F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    call = F.struct(name.alias("id"), F.lit("lookup").alias("name"), F.struct(F.col("turn"), F.col("text").alias("query")).alias("arguments"))
    asking = F.to_json(F.struct(F.lit("").alias("content"), F.array(call).alias("tool_calls")))
    answer = F.to_json(F.struct(before.alias("tool_call_id"), F.col("text").alias("content")))
    made = messages.withColumn("text", F.when(F.col("role") == "assistant", asking).otherwise(F.col("text")))
    results = messages.filter("role = 'user' AND turn > 0").select("conv_id", "turn", F.lit("tool").alias("role"), answer.alias("text"))
    return made.select("conv_id", "turn", "role", "text").unionByName(results)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(tool_traffic(spark.read.parquet(f"{sf_dir}/conversations.parquet")), CHAT_TOOLS)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), MIX_WEIGHTS, MIX_SHARE)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), path, end_id=END_OF_DOCUMENT)
    return token_files.token_index(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_simhash, op2_exact_dedup, op3_token_counts, op4_quality, op5_line_dedup, op6_packing, op7_language_id, op8_chat_format, op9_mixing, op10_token_files)
    return {f.__name__: f for f in made}


_WORD = "[^\\x20\\x09-\\x0D]"

def _rule_sql() -> str:
    """The rule table as a condition on the measures of ``_QUALITY_SQL``."""
    ratio = {
        "mean_word_chars": "word_chars / n", "symbol_ratio": "n_symbols / CAST(greatest(word_chars, 1) AS DOUBLE)",
        "stop_ratio": "n_stop / n", "dup_line_ratio": "n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE)",
    }
    parts = []
    for rule in quality.RULES:
        bounds = [f"{ratio[rule.measure]} {sign} {bound}" for sign, bound in ((">=", rule.least), ("<=", rule.most)) if bound is not None]
        held = " AND ".join(bounds)
        parts.append(f"({held})" if rule.languages is None else f"(lang IS NULL OR lang NOT IN ({', '.join(repr(x) for x in rule.languages)}) OR {held})")
    return " AND ".join(parts)


_STOPS = " ".join(f"WHEN '{lang}' THEN len(list_filter(ws, lambda x: lower(x) IN ({', '.join(repr(w) for w in words)})))" for lang, words in quality.STOP_WORDS.items())

_QUALITY_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '{_WORD}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
    g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
    p AS (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS at FROM c WHERE n > 1),
    k AS (SELECT r, count(*) AS n FROM p GROUP BY r),
    m AS (
        SELECT doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
               CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
               coalesce(k.n, 0) AS n_repeat_words, CASE lang {_STOPS} END AS n_stop
        FROM w LEFT JOIN k ON k.r = w.r),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(greatest(n_words, 1) AS DOUBLE) AS n FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rule_sql()} AS kept
    FROM b
"""

_LINES_SQL = f"""
    WITH d AS (
        SELECT DISTINCT doc_id, coalesce(text, '') AS t, substr(sha256(coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 1, 32) AS key FROM documents),
    l AS (SELECT key, doc_id, unnest(range(1, len(ls) + 1)) AS place, unnest(ls) AS line FROM (SELECT key, doc_id, string_split(t, chr(10)) AS ls FROM d)),
    s AS (SELECT *, len(regexp_extract_all(line, '{_WORD}+')) AS w, row_number() OVER (PARTITION BY key ORDER BY place) AS i FROM l WHERE regexp_matches(line, '{_WORD}')),
    c AS (SELECT *, sum(w) OVER (PARTITION BY key ORDER BY i) AS upto FROM s),
    e AS (SELECT a.key, a.doc_id, a.i, b.i AS j FROM c a JOIN c b ON b.key = a.key AND b.i BETWEEN a.i AND a.i + {line_dedup.MIN_WORDS - 1} AND b.upto - a.upto + a.w >= {line_dedup.MIN_WORDS}),
    n AS (SELECT key, doc_id, i, min(j) AS j FROM e GROUP BY key, doc_id, i UNION SELECT key, doc_id, max(i), j FROM e GROUP BY key, doc_id, j),
    r AS (SELECT n.key, n.doc_id, n.i, n.j, list(line ORDER BY c.i) AS run FROM n JOIN c ON c.key = n.key AND c.i BETWEEN n.i AND n.j GROUP BY n.key, n.doc_id, n.i, n.j),
    k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, key, i) AS k FROM r),
    g AS (SELECT DISTINCT c.key, c.place FROM k JOIN c ON c.key = k.key AND c.i BETWEEN k.i AND k.j WHERE k > 1),
    done AS (
        SELECT l.key, count(*) AS n_lines, count(g.place) AS n_deleted, sha256(coalesce(string_agg(line, chr(10) ORDER BY l.place) FILTER (g.place IS NULL), '')) AS text_sha256
        FROM l LEFT JOIN g ON g.key = l.key AND g.place = l.place GROUP BY l.key)
    SELECT documents.doc_id, CASE WHEN text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_deleted, CASE WHEN text IS NOT NULL THEN text_sha256 END AS text_sha256
    FROM documents JOIN d ON d.doc_id IS NOT DISTINCT FROM documents.doc_id AND d.t = coalesce(text, '') JOIN done ON done.key = d.key
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
            g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
            SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
            FROM d JOIN g ON d.t = g.t
        """,
        "op4_quality": _QUALITY_SQL,
        "op5_line_dedup": _LINES_SQL,
    }
