"""Exact duplicates by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.storage import materialize


def sha256_hex(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_hex, salts: int = 64) -> DataFrame:
    """One row per different text: digest, keep_id, group_size, and the text.

    Three stages, each of which groups by the full text besides its digest, so
    two texts that share a digest never merge:

    1. every task combines its own copies (the partial aggregate), the salt
       being that task's number;
    2. the rows of a digest and salt are merged;
    3. the winners of the salts are merged. A group of any size reaches this
       stage with at most ``salts`` rows, and stage 2 with one row per task.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("__id"),
        body.alias("__text"),
        digest(body).alias("__digest"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("__salt"),
    )
    merged = keyed.groupBy("__digest", "__salt", "__text").agg(F.max("__id").alias("__top"), F.count(F.lit(1)).alias("__n"))
    return (
        merged.groupBy("__digest", "__text")
        .agg(F.max("__top").alias("keep_id"), F.sum("__n").alias("group_size"))
        .select(F.col("__digest").alias("digest"), F.col("__text").alias("text"), "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_hex, salts: int = 64) -> DataFrame:
    """Every row of ``docs`` with its group of identical texts.

    Adds ``keep_id`` (the largest id among the copies), ``group_size``, ``kept``
    and ``digest``. Texts are compared byte for byte; a null text counts as
    empty. Rows that repeat an id are rows of their own: ``kept`` holds for each
    row whose id is ``keep_id``. A null id is below every other; a group whose
    ids are all null has a null ``keep_id`` and keeps those rows. An empty table
    gives an empty result; other columns pass through, and names that clash with
    the added ones are replaced.

    Groups go back to their rows by digest alone, which is exact for a digest
    that belongs to one text of the whole table, as ``exact_groups`` has shown
    by then. Rows of any other digest are matched by their full text.
    """
    groups = exact_groups(docs, id_col, text_col, digest, salts)
    by_digest = materialize(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("__texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        ),
        "exact-groups",
    )
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.drop("keep_id", "group_size", "kept", "digest").withColumn("digest", digest(body))
    single = by_digest.filter("__texts = 1").drop("__texts")
    out = rows.join(single, "digest")
    shared = by_digest.filter("__texts > 1").select("digest")
    if not shared.isEmpty():
        texts = groups.join(shared, "digest", "left_semi")
        same = (rows["digest"] == texts["digest"]) & (F.coalesce(rows[text_col], F.lit("")) == texts["text"])
        own = [rows["digest"] if c == "digest" else rows[c] if c in rows.columns else texts[c] for c in out.columns]
        out = out.unionByName(rows.join(texts, same).select(*own))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
