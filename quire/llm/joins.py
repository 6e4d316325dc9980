"""Joins that hold up under skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes up to which a small side is broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: A key is common when it holds more than one in so many rows; there are at most so many of them.
COMMON_SHARE = 2000


def lookup_join(large: DataFrame, small: DataFrame, key: str, how: str = "left", bound: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Join ``small`` (one row per key, null included) to ``large`` on ``key``.

    The small side's rows and the bytes of its keys are counted first. Up to ``bound`` rows of
    ``BROADCAST_BYTES`` in all it is broadcast, so a key that holds a third of
    ``large`` moves nowhere. Beyond that both sides are shuffled on (key, salt), the small side once per
    salt, so such a key is spread over ``salts`` tasks. The null key matches itself.
    """
    other = small.withColumnRenamed(key, "__key")
    head = small.limit(bound + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + F.lit(8 * len(small.columns))).alias("bytes")).first()
    if head["n"] <= bound and (head["bytes"] or 0) <= BROADCAST_BYTES:
        return large.join(F.broadcast(other), large[key].eqNullSafe(other["__key"]), how).drop("__key")
    salted = large.withColumn("__salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)))
    spread = other.withColumn("__with", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    on = salted[key].eqNullSafe(spread["__key"]) & (salted["__salt"] == spread["__with"])
    return salted.join(spread, on, how).drop("__key", "__salt", "__with")


def counted_join(large: DataFrame, classes: DataFrame, on: list[str], share: int = COMMON_SHARE) -> DataFrame:
    """Inner join of ``large`` to ``classes``, one row a key, whose ``n`` counts the key's rows in ``large``.

    Keys with more than one in ``share`` of the counted rows, of which there can be only
    ``share``, are broadcast, and their rows stay where they are; all others are shuffled on
    the key. ``large`` is read twice, so it should be a written table.
    """
    total = classes.agg(F.sum("n")).first()[0] or 0
    common = classes.filter(F.col("n") > total // share)
    few = large.join(F.broadcast(common), on)
    rest = large.join(F.broadcast(common.select(*on)), on, "left_anti").join(classes.filter(F.col("n") <= total // share).hint("merge"), on)
    return few.unionByName(rest)
