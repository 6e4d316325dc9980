"""Mixing sources to target weights by hash-threshold histograms.

DataFrame operations only. Documents are never sorted: sizes are summed per
source and hash bucket, the bucket in which a source's budget ends is split
again and again, and a document is taken when its hash lies below the threshold.
The hash does not depend on the budget, so a smaller budget takes a subset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.joins import lookup_join
from quire.llm.storage import materialize

LEVEL_BITS = 12
LEVELS = 4
HASH_BITS = LEVEL_BITS * LEVELS

#: The bytes that separate words: space and tab to carriage return.
SPACES = " \t\n\x0b\f\r"


def word_count(text: F.Column) -> F.Column:
    """Number of runs of other characters than the six separators; null has none."""
    flat = F.coalesce(text, F.lit(""))
    for space in SPACES[1:]:
        flat = F.replace(flat, F.lit(space), F.lit(" "))
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def source_targets(totals: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Targets of the sources (source, source_size), one row each.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes. No target passes ``most`` times its source's
    size; what is cut there is shared again by weight among the others until
    none is above. That fixed point is found at once: with sources in order of
    capacity per weight, those filled up are a prefix, and the level is the rest
    of the budget over the rest of the weights.
    """
    one = Window.partitionBy(F.lit(0))
    ordered = one.orderBy(F.col("source").asc_nulls_last())
    ranked = (
        totals.withColumn("__turn", F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))))
        .withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("__turn") + 1))
        .withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    )
    filling = one.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(one) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (
        F.sum("__w").over(one) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    )
    staged = ranked.withColumn("__level", level).withColumn("__place", F.row_number().over(filling))
    # the first source in filling order whose capacity the level does not pass ends the prefix
    fits = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct("__place", "__level"))
    final = staged.withColumn("__final", F.min(fits).over(one)["__level"])
    return final.select("source", "source_size", F.coalesce(F.least(F.col("__cap"), F.col("__final") * F.col("__w")), F.col("__cap")).alias("target"))


def _hash(id_col: str, text_col: str) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))), 64 - HASH_BITS)


def thresholds(sizes: DataFrame, weights: list[float], share: float, most: int = 2) -> DataFrame:
    """(source, source_size, target, full, threshold) for ``sizes`` (source, size, hash).

    Every document of a source is taken ``full`` times, and once more when its
    hash lies below ``threshold``: the end of the last single hash value that
    fits the target, or of the next where that comes nearer.
    """
    targets = materialize(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("full", full).select(
        "source", "source_size", "target", "full", (F.col("target") - F.col("full") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix")
    )
    within = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        # level 1 has all rows of a source in its only bucket so far; later levels only the boundary bucket's
        rows = sizes if level == 1 else lookup_join(sizes, state.select("source", "prefix"), "source", "inner").filter(
            F.shiftrightunsigned("hash", shift + LEVEL_BITS) == F.col("prefix")
        )
        histogram = rows.groupBy("source", F.shiftrightunsigned("hash", shift).alias("bucket")).agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(within))
        joined = histogram.join(state.drop("n"), histogram["source"].eqNullSafe(state["source"]), "right").drop(histogram["source"])
        # the first bucket that the budget does not cover; if there is none, the last
        fits = F.col("upto") <= F.col("left")
        at = F.when(fits, -F.col("bucket")).otherwise(F.col("bucket"))
        cut = F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("below"), "n"), F.struct(fits.alias("fits"), at.alias("at")))
        boundary = joined.groupBy("source", "source_size", "target", "full", "left").agg(cut.alias("cut"))
        state = materialize(
            boundary.select(
                "source", "source_size", "target", "full",
                (F.col("left") - F.coalesce(F.col("cut.below"), F.lit(0))).alias("left"),
                F.coalesce("cut.bucket", F.lit(0)).cast("long").alias("prefix"),
                F.coalesce("cut.n", F.lit(0)).alias("n"),
            ),
            "mix-level",
        )
    # the last bucket is one hash value: in when that is nearer to the target than out
    end = F.col("prefix") + F.when(2 * F.col("left") >= F.col("n"), 1).otherwise(0)
    return state.select("source", "source_size", "target", "full", end.alias("threshold"))


def _copies(most: int) -> F.Column:
    more = F.when((F.col("full") < most) & (F.col("hash") < F.col("threshold")), 1).otherwise(0)
    return (F.col("full") + more).cast("long")


def mix(docs: DataFrame, weights: list[float], share: float, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies) for every row of ``docs``.

    ``size`` is the number of words and ``copies`` how often the mix takes the
    document. A null or blank text has size 0, so it adds nothing at either
    choice; a null source is a source of its own; rows alike in id and text have
    one hash and are taken together. An empty table gives an empty result. Only
    the three named columns are read, so other columns cannot clash.
    """
    sizes = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), _hash(id_col, text_col).alias("hash")),
        "mix-sizes",
    )
    found = lookup_join(sizes, thresholds(sizes, weights, share, most), "source")
    return found.select("id", "source", "size", "source_size", "target", _copies(most).alias("copies"))


def mixed_rows(docs: DataFrame, weights: list[float], share: float, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it does; see ``mix``.

    A row without words is taken as its hash has it, although it adds no words.
    """
    named = F.col(source_col).cast("string").alias("source")
    sizes = materialize(docs.select(named, word_count(F.col(text_col)).alias("size"), _hash(id_col, text_col).alias("hash")), "mix-sizes")
    chosen = thresholds(sizes, weights, share, most).select(F.col("source").alias("__source"), "full", "threshold")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(source_col).cast("string").alias("__source"), _hash(id_col, text_col).alias("hash"))
    taken = lookup_join(rows, chosen, "__source").select("__row", F.explode(F.array_repeat(F.lit(0), _copies(most).cast("int"))))
    return taken.select("__row.*")
