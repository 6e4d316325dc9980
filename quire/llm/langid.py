"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that its code point seeds. The
vector of an n-gram binds (multiplies) its letters' vectors, each permuted (rolled)
by its place; a text's profile bundles (adds) its n-grams' vectors. A language's
prototype is the bundle of its training texts, and a document gets the language
whose prototype has the largest cosine with its profile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import byte_batches, forget
from quire.plans.limits import tidy

DIMENSIONS = 1024
NGRAM = 3
SEED = 20_011
#: Characters cut to n-grams at once, documents and characters of a block, and n-grams whose vectors exist at once.
BLOCK_CHARS = 1 << 20
BLOCK_DOCS = 64
SLICE_GRAMS = 2048
#: Languages that can be learned: the driver and every worker hold a vector of each.
MAX_LANGUAGES = 2000
#: A text that shares no n-gram with a prototype has a cosine of either sign by
#: chance, with a standard deviation of 1 / sqrt(DIMENSIONS); three of them, of a
#: text of so many letters, are needed to be in a language at all. Shorter texts
#: have too few n-grams to say.
FLOOR = 3 / DIMENSIONS**0.5
FLOOR_LETTERS = 30


@lru_cache(maxsize=1)
def _letters():
    """For each code point whether it is a letter."""
    import numpy as np

    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=65_536)
def _letter_vector(code: int):
    import numpy as np

    return np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1


def ngram_vectors(codes):
    """Vectors of packed n-grams (21 bits a code point), one row each, as float32."""
    import numpy as np

    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for place in range(NGRAM):
        points, which = np.unique((codes >> (21 * place)) & 0x1FFFFF, return_inverse=True)
        table = np.stack([np.roll(_letter_vector(int(p)), place) for p in points]) if len(points) else np.ones((0, DIMENSIONS), np.int8)
        out *= table[which]
    return out.astype(np.float32)


def _packed(points):
    """Packed n-grams of a sequence of code points."""
    import numpy as np

    codes = np.zeros(max(0, len(points) - NGRAM + 1), np.int64)
    for place in range(NGRAM if len(codes) else 0):
        codes |= points[place : place + len(codes)] << (21 * place)
    return codes


def gram_counts(text: str | None, step: int = BLOCK_CHARS):
    """(codes, counts) of the n-grams of the lower-cased text, runs of other characters being one blank.

    The text is taken ``step`` characters at a time, each part after the last
    points of the one before, so that a long text needs little memory.
    """
    import numpy as np

    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters, parts, points = _letters(), [], np.zeros(1, np.int64)
    for start in range(0, len(text), step):
        last = start + step >= len(text)
        part = text[start : start + step].lower() + " " * last
        new = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        points = np.concatenate([points, np.where(letters[new], new, 0)])
        points = points[(points != 0) | np.concatenate([[True], points[:-1] != 0])]
        parts.append(np.unique(_packed(points), return_counts=True))
        points = points[1 - NGRAM :]
    if len(parts) == 1:
        return parts[0]
    codes, which = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(which, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def profiles(rows, codes, counts, n_rows: int):
    """(n_rows, DIMENSIONS) float64: each row's bundle of its n-grams' vectors.

    The three arrays say that row ``rows[i]`` has n-gram ``codes[i]``, ``counts[i]``
    times. Vectors are made for ``SLICE_GRAMS`` n-grams at a time, so the memory
    does not depend on how many there are; sums are of integers, and exact.
    """
    import numpy as np

    out = np.zeros((n_rows, DIMENSIONS))
    order = np.argsort(codes, kind="stable")
    rows, codes, counts = rows[order], codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    bounds = np.append(starts[::SLICE_GRAMS], len(codes))
    for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        own = starts[k * SLICE_GRAMS : (k + 1) * SLICE_GRAMS]
        which = np.searchsorted(own, np.arange(low, high), side="right") - 1
        matrix = np.bincount(rows[low:high] * len(own) + which, counts[low:high], n_rows * len(own)).reshape(n_rows, len(own))
        kind = np.float32 if matrix.sum() < 1 << 24 else np.float64
        out += matrix.astype(kind) @ ngram_vectors(codes[own]).astype(kind, copy=False)
    return out


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts: ``BLOCK_DOCS`` of them, or fewer that hold ``BLOCK_CHARS`` characters."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and (i - first == BLOCK_DOCS or held + len(text or "") > BLOCK_CHARS):
            yield first, i
            first, held = i, 0
        held += len(text or "")
    if texts:
        yield first, len(texts)


def counted(texts: list[str | None], rows: list[int]):
    """(rows, codes, counts) of the texts' n-grams, the i-th text's under ``rows[i]``."""
    import numpy as np

    found = [gram_counts(t) for t in texts]
    return np.repeat(np.array(rows, np.int64), [len(c) for c, _ in found]), np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found])


def held_out(id_column: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Prototype of each language of ``docs``: DIMENSIONS integers.

    Every task bundles its own rows and returns one vector a language; the sums
    are integers, so the result does not depend on the partitions. Rows without
    text or language teach nothing; repeated rows count as often as they stand;
    an empty table teaches nothing. What reaches the driver is one vector for
    each language, of which there may be ``MAX_LANGUAGES``; more raise a
    ValueError before any text is read.
    """

    def bundle(batches):
        import numpy as np
        import pyarrow as pa

        forget()
        sums: dict[str, np.ndarray] = {}
        for batch in (some for whole in batches for some in byte_batches(whole, 0)):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in _blocks(texts):
                names = sorted(set(langs[first:last]))
                place = {name: i for i, name in enumerate(names)}
                own = np.rint(profiles(*counted(texts[first:last], [place[x] for x in langs[first:last]]), len(names))).astype(np.int64)
                for name, row in zip(names, own, strict=True):
                    sums[name] = sums.get(name, 0) + row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "profile"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} different values")
    partial = rows.mapInArrow(tidy(bundle), "lang string, profile array<long>")
    total = partial.select("lang", F.posexplode("profile").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    prototypes: dict[str, list[int]] = {}
    for row in total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("profile")).collect():
        prototypes[row["lang"]] = [x["value"] for x in row["profile"]]
    return dict(sorted(prototypes.items()))


def in_a_language(text: Column) -> Column:
    """Whether a text judged by ``identify`` is in one of the languages, as ``FLOOR`` says; false for ``und``."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return (F.col("lang_pred") != "und") & ((F.col("score") >= FLOOR) | (letters < FLOOR_LETTERS))


def identify(docs: DataFrame, prototypes: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the cosine, at least 0).

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text when there are no prototypes. Equal cosines go to the language that
    sorts first. Each row is judged by its whole text alone, so repeated rows
    agree and an empty table gives an empty result; other columns pass through,
    and columns with the added names are replaced.
    """
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StringType, StructType

    rest = docs.drop("lang_pred", "score")
    at = rest.columns.index(text_col)
    schema = StructType(list(rest.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())
    names = list(prototypes)

    def judge(batches):
        import numpy as np

        table = np.array([prototypes[n] for n in names], np.float64).reshape(len(names), DIMENSIONS)
        table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)
        forget()
        for batch in (some for whole in batches for some in byte_batches(whole, at)):
            texts = batch.column(at).to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            for first, last in _blocks(texts) if names else ():
                rows, codes, counts = counted(texts[first:last], list(range(last - first)))
                own = profiles(rows, codes, counts, last - first)
                norms = np.linalg.norm(own, axis=1)
                cosines = own @ table.T / np.maximum(norms, 1e-12)[:, None]
                best = cosines.argmax(1)
                for i in np.unique(rows).tolist():
                    langs[first + i], scores[first + i] = names[best[i]], min(1.0, max(0.0, float(cosines[i, best[i]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*batch.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(tidy(judge), schema)
