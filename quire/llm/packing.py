"""Best-fit packing by minimum bin slack.

Which pieces share a sequence depends on their lengths alone, and there are at
most ``capacity`` different lengths. So the packing is found on the histogram of
lengths, a table whose size the capacity bounds: per bin, a bitset subset-sum over
the lengths left finds the fullest combination with the longest one, and that
combination is removed as often as the counts allow. Pieces are then dealt to the
resulting places by their number among the pieces of their length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.storage import materialize
from quire.llm.tokens import byte_batches, encode_words, shared_encoder, tokenizer_path
from quire.plans.limits import tidy


@dataclass(frozen=True)
class Pattern:
    """``times`` equal bins; parts are (length, how often in a bin)."""

    times: int
    parts: tuple[tuple[int, int], ...]


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of lengths, at most ``counts`` of each, with the largest sum <= room.

    Bit s of a bitset says that some combination of the lengths so far sums to s.
    A length that may be used several times enters in powers of two. The bitsets
    from before each step are kept, and walking them backwards gives the
    combination. Long lengths enter first, so ties prefer few long pieces; the
    search ends as soon as the room can be filled exactly.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, power = min(counts[length], room // length), 1
        while left:
            take = min(power, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, power = left - take, power * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return sorted(chosen.items(), reverse=True)


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that pack all lengths: each bin holds the longest left, then the fullest rest."""
    left, patterns = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = dict(fullest({k: n for k, n in left.items() if n}, capacity - longest))
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        patterns.append(Pattern(times, tuple(sorted(chosen.items(), reverse=True))))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return patterns


def cut_tokens(docs: DataFrame, capacity: int, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): the documents' ids, cut into pieces of ``capacity``.

    A document is its text's ids, then ``end_id``; a null or empty text has only
    that. Repeated rows and null ids are documents of their own, an empty table
    has no pieces, and only the two named columns are read. Only longer documents are cut, and only their last piece may be shorter.
    ``ids`` are little-endian unsigned 32-bit integers, as binary.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        encoder = shared_encoder(path)
        for batch in batches:
            for some in byte_batches(batch, 1):
                offsets, ids = encode_words(some.column(1), encoder)
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                whole = np.diff(offsets)
                n = -(-whole // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(whole[row] - start, capacity)
                at = (offsets[:-1][row] + start).tolist()
                data = ids.tobytes()
                binary = pa.array([data[4 * a : 4 * (a + k)] for a, k in zip(at, length.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), binary],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidy(cut), f"doc_id {id_type}, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Every sequence is gapless from 0 and holds at most ``capacity``. Lengths must
    lie between 1 and ``capacity``; other rows, nulls among them, raise an error.
    Any two pieces of a length can change places, so repeated rows are no special
    case; an empty table gives an empty result. Pieces get their number inside
    their length from partial counts (length and part of the input), so a length
    that many pieces share is numbered in many tasks.
    """
    spark = pieces.sparkSession
    checked = pieces.withColumn(
        length_col, F.when(F.col(length_col).between(1, capacity), F.col(length_col)).otherwise(F.raise_error(F.lit("length outside 1..capacity")))
    )
    # a written table keeps its rows' places, so that numbers agree when a task runs again
    stored = materialize(checked.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "pack-pieces")
    by_part = stored.groupBy(F.col(length_col).alias("__length"), "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("__length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    # at most ``capacity`` rows, whatever the input
    counts = {r["__length"]: r["n"] for r in by_part.groupBy("__length").agg(F.sum("__n").alias("n")).collect()}
    slots, first_bin = [], 0
    used: dict[int, int] = {}
    for pattern in minimum_bin_slack(counts, capacity):
        offset = 0
        for length, each in pattern.parts:
            begin = used.get(length, 0)
            used[length] = begin + each * pattern.times
            slots.append((length, begin, used[length], each, first_bin, offset))
            offset += length * each
        first_bin += pattern.times
    schema = "__length long, __from long, __to long, __each long, __bin long, __offset long"
    places = spark.createDataFrame(slots, schema).groupBy("__length").agg(F.array_sort(F.collect_list(F.struct("__from", "__to", "__each", "__bin", "__offset"))).alias("__slots"))
    inside = Window.partitionBy(length_col, "__part").orderBy("__row")
    ranked = stored.withColumn("__at", F.row_number().over(inside) - 1).withColumnRenamed(length_col, "__length")
    ranked = ranked.join(bases, ["__length", "__part"]).withColumn("__at", F.col("__at") + F.col("__base"))
    # as bounded as the histogram: one row per length
    placed = ranked.join(F.broadcast(places), "__length").withColumn(
        "__slot", F.filter("__slots", lambda s: (s["__from"] <= F.col("__at")) & (F.col("__at") < s["__to"]))[0]
    )
    slot, nth = F.col("__slot"), F.col("__at") - F.col("__slot.__from")
    return placed.withColumns(
        {
            length_col: F.col("__length"),
            "sequence_id": slot["__bin"] + F.floor(nth / slot["__each"]),
            "offset": slot["__offset"] + F.pmod(nth, slot["__each"]) * F.col("__length"),
        }
    ).select(*pieces.columns, "sequence_id", "offset")
