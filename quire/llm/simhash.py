"""SimHash near-duplicates by multi-index hashing.

Two searches share one way to link. ``near_duplicates`` links 64-bit fingerprints
within a Hamming distance and finds every such pair. ``similar_documents`` links
texts whose shingle sets have a Jaccard similarity; its 256-bit fingerprints bring
up candidates, which are then compared exactly.

Both cut a fingerprint into segments and list each fingerprint under the values of
a small Hamming ball around each segment; fingerprints listed under one value meet,
and all their bits are compared. How many values a fingerprint is listed under is
fixed by its length and the distance, not by the table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.storage import drop_table, let_go, materialize
from quire.llm.tokens import byte_batches, forget
from quire.plans.limits import tidy

BITS = 64
#: Shingles hashed and summed at once, and bytes cut to words at once, so that a text of any length needs little memory.
BLOCK = 1 << 16
TEXT_BLOCK = 1 << 20

#: Fingerprints of similar documents: lanes of 64 bits, segments cut from them, and
#: the bits of a segment that its ball turns over, those that hung by the least.
LANES = 4
SEGMENTS = 9
SEGMENT_BITS = 26
SOFT_BITS = 6
#: The passes take so many segments each.
PASS_SEGMENTS = (2, 3, 4)
#: Differing bits of 256 up to which two texts are compared.
DISTANCE = 46
#: Prefixes: a shingle is common that is in more texts than this as far as one text in so many tells; the most
#: frequent ones, so many at most, are told apart; what rounding may cost.
COMMON_LEAST = 15
ESTIMATE = 8
COMMON_SHINGLES = 1 << 20
SLACK = 1e-6
#: A round of comparisons moves as many shingles as so many times all sets that are compared.
ROUND_SETS = 2
#: Prefixes' shingles are dealt by key in so many rounds.
KEY_ROUNDS = 2
#: The sieve of candidates' texts: bits for each, and bits of one bitmap, and bitmaps at most (32 MB).
SIEVE_BITS = 32
BITMAP_BITS = 1 << 15
BITMAPS = 1 << 13

_SPACE = re.compile(rb"[ \t-\r]")


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, the words of about ``TEXT_BLOCK`` bytes at a time."""
    start = 0
    while start < len(text):
        found = _SPACE.search(text, start + TEXT_BLOCK) if start + TEXT_BLOCK < len(text) else None
        stop = found.start() if found else len(text)
        yield text[start:stop].lower().split()
        start = stop


def _shingle_blocks(text: bytes, width: int) -> Iterator[list[bytes]]:
    """Lists of words whose windows of ``width`` are the text's shingles, each window in one list."""
    tail: list[bytes] = []
    fresh = False
    for words in word_blocks(text):
        for first in range(0, len(words), BLOCK):
            tail = tail + words[first : first + BLOCK]
            fresh = True
            if len(tail) >= width:
                yield tail
                tail, fresh = tail[len(tail) - width + 1 :], False
    if fresh:
        yield tail


def simhash(text: bytes | None, width: int) -> int:
    """Fingerprint of UTF-8 text over shingles of ``width`` words, as an unsigned integer.

    A-Z are lower-cased; words are runs of other bytes than space and tab to
    carriage return. Bit i is set when more than half of the shingles' XXH64
    (seed 42) have it. Fewer words than ``width`` are one shingle; none give 0.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    total, ones = 0, np.zeros(BITS, np.int64)
    for words in _shingle_blocks(text or b"", width):
        n = max(1, len(words) - width + 1)
        hashes = np.fromiter((xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)), ">u8", n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        total += n
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit integer; a null text has 0."""

    def hashed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([simhash(x.as_py(), width) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(tidy(hashed), f"id {source.schema['id'].dataType.simpleString()}, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments that find every pair of 64-bit fingerprints within ``distance``.

    Two fingerprints are listed under a common value of a segment when they differ
    in at most two of its bits, as balls of radius one meet. With m segments, a pair that
    differs in three bits or more of each differs in 3 m at least, so m is
    distance // 3 + 1. A fingerprint is listed 64 + m times, at any size.
    """
    m = max(2, distance // 3 + 1)
    out, shift = [], BITS
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        shift -= width
        out.append((shift, width))
    return out


def ball_keys(fp: Column, distance: int) -> tuple[Column, list[Column]]:
    """(values, balls): the segments' values, and for each segment its value and those with one of its bits turned over."""
    values, balls = [], []
    for i, (shift, width) in enumerate(segments(distance)):
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        key = F.lit(i << 32).cast("bigint").bitwiseOR(value)
        values.append(key)
        balls.append(F.array(key, *[key.bitwiseXOR(F.lit(1 << b).cast("bigint")) for b in range(width)]))
    return F.array(*values), balls


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, class) of ``classes`` after ``links`` (a_class, b_class) between them; a node without links so far is a class of its own."""
    across = components(links.select(F.col("a_class").alias("a"), F.col("b_class").alias("b")))
    merged = materialize(across.select(F.col("node").alias("class"), F.col("root").alias("top")), "merged-classes")
    lone = merged.join(classes.select("class").distinct(), "class", "left_anti").select(F.col("class").alias("node"), F.col("top").alias("class"))
    return materialize(classes.join(merged, "class", "left").select("node", F.coalesce("top", "class").alias("class")).unionByName(lone), "classes")


def connect(nodes: DataFrame, payload: list[str], near: Callable[[Callable, Callable], Column], passes: list[str], verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root): components of the links between ``nodes``, for every linked node.

    ``nodes`` has node (long, each once), the ``payload`` columns, ``base`` (the
    segments' own values) and, in the columns ``passes``, all values it is listed under. Two nodes
    with a common value are linked when ``near`` holds, a condition that is given both nodes'
    columns by name, and ``verify`` keeps their pair (a, b). The components are those of
    all links, but not every link is made, so that a crowd of g nodes close to
    one another costs about g rows and not g squared:

    1. Stars. Under each segment value the smallest and the largest node are
       compared with all others, two comparisons for each node and value, and the
       links found make first classes.
    2. Passes. Links inside a class can't change it, so values that only one class
       uses leave, and under the others only nodes of different classes meet. What a
       pass links is one class in the next.

    Minima are combined before their shuffle; both sides of a join by key are
    plainly shuffled, so nothing is gathered or broadcast.
    """

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), *[F.col(p).alias(f"{name}_{p}") for p in payload])

    def of(name: str) -> Callable[[str], Column]:
        return lambda column: F.col(name if column == "node" else f"{name}_{column}")

    close = near(of("a"), of("b"))
    checked = verify or (lambda pairs: pairs)
    base = nodes.select("node", F.explode("base").alias("key"))
    ends = base.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    spokes = base.hint("merge").join(ends.hint("merge"), "key").select(F.explode(F.array("lo", "hi")).alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
    if payload:
        spokes = spokes.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    classes = materialize(components(checked(spokes.filter(close).select("a", "b"))).withColumnRenamed("root", "class"), "star-classes")

    for column in passes:
        tagged = nodes.hint("merge").join(classes, "node", "left").select("node", F.coalesce("class", "node").alias("class"), *payload, column)
        keyed = tagged.select("node", "class", *payload, F.explode(column).alias("key"))
        mixed = keyed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("key")
        meeting = keyed.hint("merge").join(mixed.hint("merge"), "key", "left_semi")
        left, right = (
            meeting.select(F.col("key").alias(f"{s}_key"), F.col("node").alias(s), F.col("class").alias(f"{s}_class"), *[F.col(p).alias(f"{s}_{p}") for p in payload]) for s in "ab"
        )
        apart = (F.col("a_key") == F.col("b_key")) & (F.col("a_class") < F.col("b_class")) & close
        pairs = left.hint("merge").join(right.hint("merge"), apart).select("a", "b", "a_class", "b_class").distinct()
        classes = _merged(classes, checked(pairs))
    return classes.withColumnRenamed("class", "root")


def near_duplicates(docs: DataFrame, width: int = 5, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    Rows are linked when their fingerprints differ in at most ``distance`` bits;
    ``component_id`` is the smallest id that links reach, the row's own included.
    Rows without a word (null, empty or blank texts) have fingerprint 0 and are
    linked like any other. Rows with one fingerprint are one point of the search,
    so copies cost nothing and never pair up; repeated rows are copies. A null id
    is nobody's smallest; a component without other ids has a null
    ``component_id``. An empty table gives an empty result. Only the two named
    columns are read.
    """
    rows = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    table = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep")), "fingerprint-table")
    base, balls = ball_keys(F.col("fp"), distance)
    passes = [f"ball{i}" for i in range(len(balls))]
    nodes = table.select(F.col("fp").alias("node"), base.alias("base"), *[ball.alias(name) for ball, name in zip(balls, passes, strict=True)])
    near = lambda a, b: F.bit_count(a("node").bitwiseXOR(b("node"))) <= distance
    roots = connect(nodes, [], near, passes)
    reached = table.join(roots, table["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = reached.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = materialize(reached.join(least, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("id", "fp", "component_id")


def _mixed(x):
    """Every bit of 64-bit integers spread over all of them."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hashes of words; short ones are remembered up to a bound."""

    def __init__(self):
        from xxhash import xxh64_intdigest

        self.digest = xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self.digest(word)
        if len(word) <= 32 and len(self) < 1 << 17:
            self[word] = value
        return value


def _of_windows(codes, first, lengths, width: int):
    """Hashes of the windows of ``width`` codes that begin at ``first``, of fewer where ``lengths`` ends a text before."""
    import numpy as np

    x = codes[first]
    for k in range(1, width):
        further = codes[np.minimum(first + k, len(codes) - 1)]
        x = np.where(k < lengths, (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + further, x)
    return _mixed(x)


def _long_shingles(text: bytes, width: int, known: dict[bytes, int]):
    """Sorted hashes of one text's different shingles, its words taken block by block."""
    import numpy as np

    parts = [np.zeros(0, np.uint64)]
    for words in _shingle_blocks(text, width):
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(codes) - width + 1)
        parts.append(np.unique(_of_windows(codes, np.arange(n), np.full(n, len(codes)), width)))
    return np.unique(np.concatenate(parts))


def shingle_hashes(texts: list[bytes], width: int, known: dict[bytes, int]):
    """(row, hash): the different shingles of ``width`` words of each text, sorted; none for a text without a word."""
    import numpy as np

    if len(texts) == 1 and len(texts[0]) > TEXT_BLOCK:
        own = _long_shingles(texts[0], width, known)
        return np.zeros(len(own), np.int64), own
    words = [t.lower().split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(lengths.sum()))
    windows = np.where(lengths > 0, np.maximum(1, lengths - width + 1), 0)
    rows = np.repeat(np.arange(len(texts)), windows)
    inside = np.arange(len(rows)) - np.repeat(np.cumsum(windows) - windows, windows)
    hashes = _of_windows(codes, (np.cumsum(lengths) - lengths)[rows] + inside, lengths[rows], width) if len(rows) else codes
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def text_groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``BLOCK`` * 4 bytes; one beyond ``TEXT_BLOCK`` stands alone."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and (held + len(text) > BLOCK * 4):
            yield first, i
            first, held = i, 0
        held += len(text)
    if texts:
        yield first, len(texts)


def margins(rows, hashes, n_rows: int):
    """(n_rows, LANES * BITS): for each bit the votes of a row's hashes for it less those against."""
    import numpy as np

    ones = np.zeros((n_rows, LANES, BITS), np.int64)
    for start in range(0, len(hashes), BLOCK):
        own, part = rows[start : start + BLOCK], hashes[start : start + BLOCK]
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        # a bit a byte, eight bytes added as one integer: 255 rows at most before a byte runs over
        inside = np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))
        pieces = np.flatnonzero(inside % 255 == 0)
        rejoin = np.searchsorted(pieces, begins)
        for lane in range(LANES):
            voted = _mixed(part + np.uint64(0x9E3779B97F4A7C15 * (lane + 1) & (1 << 64) - 1))
            bits = np.unpackbits(voted.view(np.uint8)).view(np.uint64).reshape(-1, 8)
            sums = np.add.reduceat(bits, pieces, axis=0).view(np.uint8).astype(np.int64)
            ones[own[begins], lane] += np.add.reduceat(sums, rejoin, axis=0)
    return (2 * ones - np.bincount(rows, minlength=n_rows)[:, None, None]).reshape(n_rows, -1)


def segment_keys(votes):
    """Rows' segment values, then those with one of the softest bits turned over: int32 with the segment's number above."""
    import numpy as np

    power = 1 << np.arange(SEGMENT_BITS)
    cut = votes[:, : SEGMENTS * SEGMENT_BITS].reshape(-1, SEGMENTS, SEGMENT_BITS)
    values = (cut > 0) @ power
    soft = np.argsort(np.abs(cut), axis=2, kind="stable")[:, :, :SOFT_BITS]
    number = np.arange(SEGMENTS) << SEGMENT_BITS
    turned = (values[:, :, None] ^ power[soft]) | number[:, None]
    return np.concatenate([values | number, turned.reshape(len(cut), -1)], axis=1).astype(np.int32)


def prefixes(rows, hashes, n_rows: int, similarity: float, common=(), times=()):
    """(sizes, lists): each row's number of hashes, and its prefix, as an Arrow list.

    ``hashes`` are sorted in each row. All have one order: their own, but those of the sorted array ``common`` come last,
    the ones with more ``times`` behind those with fewer. Sets of n hashes that share ``similarity`` of their union share that much of each set at least, so the first n - ceil(similarity * n) + 1
    hashes of one and of the other have one in common, whatever the order is.
    """
    import numpy as np
    import pyarrow as pa

    if len(common):
        place = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        late = np.where(common[place] == hashes, np.asarray(times, np.int64)[place] if len(times) else 1, 0)
        hashes = hashes[np.argsort(rows * (late.max(initial=0) + 1) + late, kind="stable")]
    sizes = np.bincount(rows, minlength=n_rows)
    inside = np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]
    lengths = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - SLACK).astype(np.int64) + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return sizes, pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[inside < lengths[rows]].view(np.int64)))


def sketches(rows: DataFrame, width: int, similarity: float, common=((), ())) -> DataFrame:
    """(digest, f0 and so on, keys, n, prefix) of ``rows`` (digest, text as binary): fingerprint, listed values, ``prefixes``.

    ``common`` has the hashes that come late in the prefixes' order, and their times.
    """

    def made(batches):
        import numpy as np
        import pyarrow as pa

        forget()
        known = _WordHashes()
        for batch in batches:
            for some in byte_batches(batch, 1):
                texts = some.column(1).to_pylist()
                votes, sizes, firsts = [], [], []
                for a, b in text_groups(texts):
                    found = shingle_hashes(texts[a:b], width, known)
                    votes.append(margins(*found, b - a))
                    size, first = prefixes(*found, b - a, similarity, *common)
                    sizes.append(size)
                    firsts.append(first)
                keys = np.concatenate([segment_keys(v) for v in votes])
                lanes = np.concatenate([np.packbits(v > 0, axis=1).view(">i8") for v in votes]).astype(np.int64)
                offsets = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))
                columns = [some.column(0), *(pa.array(np.ascontiguousarray(lanes[:, k])) for k in range(LANES)), lists, pa.array(np.concatenate(sizes)), pa.concat_arrays(firsts)]
                yield pa.RecordBatch.from_arrays(columns, ["digest", *_FP, "keys", "n", "prefix"])

    return rows.select("digest", "text").mapInArrow(tidy(made), f"digest binary, {', '.join(f'{c} long' for c in _FP)}, keys array<int>, n long, prefix array<long>")


_FP = [f"f{k}" for k in range(LANES)]


def text_digest(text: Column) -> Column:
    """SHA-256 of the text as 32 bytes; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, shingles) of ``texts`` (node, text as binary): the number of different shingles, and their hashes."""

    def hashed(batches):
        import numpy as np
        import pyarrow as pa

        forget()
        known = _WordHashes()
        for batch in batches:
            for some in byte_batches(batch, 1):
                texts = some.column(1).to_pylist()
                for a, b in text_groups(texts):
                    rows, hashes = shingle_hashes(texts[a:b], width, known)
                    offsets = np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([some.column(0).slice(a, b - a), pa.array(np.diff(offsets).astype(np.int64)), lists], ["node", "n", "shingles"])

    return texts.select("node", "text").mapInArrow(tidy(hashed), "node long, n long, shingles array<long>")


def sieved(texts: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose digest is in ``named``, and of the others about one in ``SIEVE_BITS``.

    The digests' hashes are bits of bitmaps, which are broadcast, so that most texts that aren't named stay where they are. More
    digests than the bitmaps are made for let more of the others through and lose none.
    """
    bitmaps = min(BITMAPS, max(1, -(-named.count() * SIEVE_BITS // BITMAP_BITS)))

    def place(digest: Column) -> tuple[Column, Column]:
        bit = F.pmod(F.xxhash64(digest), F.lit(bitmaps * BITMAP_BITS))
        return F.shiftright(bit, BITMAP_BITS.bit_length() - 1), bit.bitwiseAND(F.lit(BITMAP_BITS - 1))

    bucket, bit = place(named["digest"])
    made = named.select(bucket.alias("__bitmap"), bit.alias("__bit")).groupBy("__bitmap").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    bucket, bit = place(texts["digest"])
    byte = F.conv(F.hex(F.substring(made["__bits"], F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return texts.join(F.broadcast(made), (bucket == made["__bitmap"]) & (F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1), "left_semi")


class _Comparison:
    """Keeps the pairs (a, b) of nodes whose texts have similar enough sets of shingles.

    A set goes with each pair of its text, so the pairs are compared in rounds that move ``ROUND_SETS`` times all sets each.
    """

    def __init__(self, source: DataFrame, table: DataFrame, width: int, similarity: float):
        self.source, self.table, self.width, self.similarity = source, table, width, similarity
        self.used: list[DataFrame] = []

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        self.used.append(materialize(df, name))
        let_go(df.sparkSession)
        return self.used[-1]

    def __call__(self, pairs: DataFrame) -> DataFrame:
        pairs = self._kept(pairs, "candidates")
        both = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
        named = self._kept(self.table.join(both, self.table["node"] == both["a"], "left_semi").select("node", "digest"), "candidate-texts")
        texts = sieved(self.source.select("digest", "text"), named).join(named, "digest").dropDuplicates(["node"])
        sets = self._kept(_shingle_sets(texts, self.width), "shingle-sets")
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        held = sets.agg(F.sum("n")).first()[0] or 0
        moved = pairs.join(sets.select(F.col("node").alias("a"), "n"), "a").agg(F.sum("n")).first()[0] or 0
        rounds = max(1, -(-moved // max(1, ROUND_SETS * held)))

        def similar(some: DataFrame) -> DataFrame:
            joined = some.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
            return joined.filter(F.col("both") >= self.similarity * (F.size("x") + F.size("y") - F.col("both"))).select(*pairs.columns)

        if rounds == 1:
            return similar(pairs)
        part = F.pmod(F.xxhash64("a", "b"), F.lit(rounds))
        return reduce(DataFrame.unionByName, [self._kept(similar(pairs.filter(part == k)), "similar-pairs") for k in range(rounds)])

    def clear(self) -> None:
        """Delete the tables behind pairs that have been used."""
        for df in self.used:
            drop_table(df)
        self.used.clear()


def _needed(similarity: float) -> Column:
    return (F.col("a_n") + F.col("b_n")) * (similarity / (1 + similarity)) - SLACK


def _met(places: DataFrame, similarity: float) -> DataFrame:
    """Two texts' rows of ``places`` with one key, where that place leaves room for the similarity of texts of different classes.

    ``places`` has (key, node, class, n, at, before): ``before`` counts the text's rows of smaller ``at``. All texts have one
    order, so what two share before a place they share is among these rows in both; shingles that no text of another class
    has in its prefix are no rows and can't be common there.
    """
    left, right = (places.select(*[F.col(c).alias(f"{s}_{c}") for c in ("key", "class", "n", "at", "before")], F.col("node").alias(s)) for s in "ab")
    room = F.least("a_before", "b_before") + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    apart = (F.col("a_key") == F.col("b_key")) & (F.col("a_class") < F.col("b_class")) & (room >= _needed(similarity))
    return left.hint("merge").join(right.hint("merge"), apart)


def _roomy_pairs(places: DataFrame, similarity: float) -> DataFrame:
    """(a, b, a_class, b_class): texts of different classes that can be similar for what their prefixes share.

    Up to the last shingle that both prefixes hold, two texts share what is counted here and nothing else, as all
    have one order; so what they share in all is that and what follows that place in both at most. Of the rest all
    lies behind the prefix that ends first.
    """
    met = _met(places, similarity)
    pairs = met.groupBy("a", "b", "a_class", "b_class", "a_n", "b_n").agg(F.count(F.lit(1)).alias("both"), F.max("a_at").alias("a_last"), F.max("b_at").alias("b_last"))
    after = F.least(F.col("a_n") - F.col("a_last"), F.col("b_n") - F.col("b_last")) - 1
    behind = F.greatest(*[F.ceil(F.col(n) * similarity - SLACK) - 1 for n in ("a_n", "b_n")])
    return pairs.filter(F.col("both") + F.least(after, behind) >= _needed(similarity)).select("a", "b", "a_class", "b_class")


def common_shingles(texts: DataFrame, width: int):
    """(hashes, times): the frequent shingles of ``texts`` (text as binary), sorted, and how many of the counted texts have them.

    Every ``ESTIMATE``-th text is counted, repeated ones each time: the choice decides how many texts meet, never which links are found.
    """
    import numpy as np

    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(ESTIMATE)) == 0).select(F.lit(0).cast("long").alias("node"), "text")
    keys = _shingle_sets(some, width).select(F.explode("shingles").alias("key"))
    counted = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > COMMON_LEAST // ESTIMATE), "common-shingles")
    least, held = 0, 0
    for r in counted.groupBy("times").agg(F.count(F.lit(1)).alias("n")).sort(F.desc("times")).collect():
        held += r["n"]
        if held > COMMON_SHINGLES:
            least = r["times"]
            break
    kept = counted.filter(F.col("times") > least).toArrow()
    drop_table(counted)
    hashes, times = kept["key"].to_numpy().view(np.uint64), kept["times"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], times[order]


def link_rest(source: DataFrame, table: DataFrame, classes: DataFrame, width: int, similarity: float, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``classes`` (node, class) after the links that fingerprints didn't bring up: none is missed.

    Similar texts share a shingle of their ``prefixes``, so texts of different classes that share one are compared, where
    sizes, the places in the prefixes and the number of shared ones leave room for the similarity. Links inside a class can't
    change it. Frequent shingles come last in the order of all, so most texts share none that is in their prefix.
    """
    spark = source.sparkSession
    let_go(spark)
    keyed, parts = table.select("node", "n", F.posexplode("prefix").alias("at", "key")), []
    for k in range(KEY_ROUNDS):
        some = keyed.filter(F.pmod("key", F.lit(KEY_ROUNDS)) == k)
        shared = some.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("times > 1")
        parts.append(materialize(shared.select("key", "node", "n", "at"), "shared-places"))
        let_go(spark)
    places = reduce(DataFrame.unionByName, parts)
    # a text that no link has reached is a class of its own
    tagged = materialize(places.hint("merge").join(classes.hint("merge"), "node", "left").withColumn("class", F.coalesce("class", "node")), "shared-classes")
    for part in parts:
        drop_table(part)
    mixed = tagged.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("key")
    meeting = tagged.hint("merge").join(mixed.hint("merge"), "key", "left_semi")
    meeting = materialize(meeting.withColumn("before", F.row_number().over(Window.partitionBy("node").orderBy("at")) - 1), "meeting-places")
    drop_table(tagged)
    let_go(spark)
    merged = _merged(classes, compare(_roomy_pairs(meeting, similarity)))
    drop_table(meeting)
    return merged


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_rows, class): each different pair of id and text, with its class of near-duplicates.

    Texts are linked when their sets of ``width``-word shingles (A-Z lower-cased)
    have at least the Jaccard ``similarity``; ``class`` is a number that linked
    texts share. Links are searched among texts that meet under a segment value and
    whose 256-bit fingerprints differ in at most ``distance`` bits; each is then
    compared by its whole sets, so no other texts are linked. That finds nearly all
    links; ``link_rest`` finds the others, so that no pair of ``similarity`` or more ends in two classes.

    Nodes of the search are different texts, told apart by ``digest`` (SHA-256):
    copies cost nothing, and an equal fingerprint alone links nothing. Null and empty
    texts are one text; texts without a word are linked with each other. ``n_rows``
    counts the rows with this id and text; null ids are kept. An empty table gives
    an empty result. Only the two named columns are read.
    """
    source = docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    made = sketches(source, width, similarity, common_shingles(source.select("text"), width)).groupBy("digest").agg(*[F.first(c).alias(c) for c in (*_FP, "keys", "n", "prefix")])
    table = materialize(made.withColumn("node", F.monotonically_increasing_id()), "sketches")
    turned = lambda first, last: F.slice("keys", SEGMENTS + 1 + first * SOFT_BITS, (last - first) * SOFT_BITS)
    base = F.slice("keys", 1, SEGMENTS)
    # the first pass takes few segments: it finds most links of a crowd, which are one class in the next; a pass's rows hold
    # fingerprints once a value, so that the disk they take at once is that of the largest pass
    bounds = [sum(PASS_SEGMENTS[:k]) for k in range(len(PASS_SEGMENTS) + 1)]
    passes = {f"pass{k}": F.concat(F.slice("keys", first + 1, last - first), turned(first, last)) for k, (first, last) in enumerate(zip(bounds, bounds[1:], strict=False))}
    nodes = table.select("node", *_FP, base.alias("base"), *[listed.alias(name) for name, listed in passes.items()])

    def near(a, b) -> Column:
        return sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in _FP[1:]), F.bit_count(a(_FP[0]).bitwiseXOR(b(_FP[0])))) <= distance

    compare = _Comparison(source, table, width, similarity)
    found = connect(nodes, _FP, near, [*passes], compare).withColumnRenamed("root", "class")
    compare.clear()
    roots = link_rest(source, table, found, width, similarity, compare).withColumnRenamed("class", "root")
    compare.clear()
    classes = table.select("node", "digest").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("class"))
    return source.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n_rows")).join(classes, "digest").select("id", "digest", "n_rows", "class")


def hex_fingerprint(fp: F.Column) -> F.Column:
    """16 lower-case hexadecimal digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
