"""From documents to packed token sequences, in five stages.

Each stage reads its predecessor's table and writes its own, so a lost executor
costs the tasks at hand and never the chain. All stages but the last return the
columns of ``documents``. The rows can't be had by SQL (profiles and tokens), so
``ORACLE_SQL`` is None and the tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, line_dedup, mixing, packing, simhash
from quire.llm.storage import created, drop_since, materialize
from quire.session import ship

MIX_WEIGHTS = [5.0, 2.0, 1.0]
MIX_SHARE = 1.5
PACK_TOKENS = 2048
#: Near-duplicates: five-word shingles and this Jaccard similarity.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.

    Those without a letter (null and empty texts too) go, as do those of
    ``langid.FLOOR_LETTERS`` letters or more whose best cosine lies below
    ``langid.FLOOR``, which chance alone reaches for a text unlike every language. If nothing can be learned,
    as from an empty table, no document has a language and all go. Repeated rows
    are judged alike, and whole texts are read however long.
    """
    ship(spark)
    judged = langid.identify(docs, langid.train(docs))
    return judged.filter(langid.in_a_language(F.col("text"))).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; a document of nothing else goes.

    Null and empty texts have no runs and stay as they are if they came this far; rows that repeat id
    and text are one document, an empty table gives an empty result, and texts of any length are taken whole.
    """
    ship(spark)
    rest = line_dedup.line_dedup(docs)
    left = rest.filter((F.col("n_deleted") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_deleted") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: that with the smallest doc_id.

    Of different texts under that doc_id the one with the smallest SHA-256 stays,
    and of rows that repeat id and text the one with the smallest hash of all its
    columns, so the choice is the same on every run. A null doc_id comes last.
    Rows that are like no other all stay, whatever ids they share. An empty table
    gives an empty result.
    """
    ship(spark)
    classes = materialize(simhash.similar_documents(docs, SHINGLE_WORDS, SIMILARITY), "near-classes")
    place = F.struct(F.col("id").isNull(), "id", "digest")
    first = classes.groupBy("class").agg(F.min(place).alias("first"))
    judged = classes.join(first, "class").withColumn("stays", place == F.col("first"))
    listed = materialize(judged.filter("NOT stays OR n_rows > 1").select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "stays"), "near-copies")

    def named(rows: DataFrame):
        return docs["doc_id"].eqNullSafe(rows["__id"]) & (simhash.text_digest(docs["text"]) == rows["__digest"])

    repeated = listed.filter("stays")
    whole = F.struct(*docs.columns)
    again = docs.join(repeated, named(repeated)).groupBy("__id", "__digest").agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("__row"))
    return docs.join(listed, named(listed), "left_anti").unionByName(again.select("__row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source, a null or empty text adds no words and is taken as its hash has it, rows alike in
    id and text are taken together, and an empty table gives an empty result.
    """
    ship(spark)
    return mixing.mixed_rows(docs, MIX_WEIGHTS, MIX_SHARE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most ``PACK_TOKENS``.

    A null or empty text is one piece of its end id, repeated rows and null ids are documents of their own, and an
    empty table has no pieces. Only texts longer than a sequence are cut.
    """
    ship(spark)
    pieces = packing.cut_tokens(docs, PACK_TOKENS)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), PACK_TOKENS)


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and reread.

    What a stage wrote on its way, and what it read from the one before, is deleted once its own table stands.
    """
    rows, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), created()
    for name, stage in STAGES:
        rows = materialize(stage(spark, rows, sf_dir), name.replace(" ", "-").lower())
        drop_since(start, rows)
    return rows
