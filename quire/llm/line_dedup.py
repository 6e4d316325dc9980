"""Repeated runs of lines, by a suffix array over line ids.

The texts' lines, blank ones left out, form a sequence of line ids a document.
Prefix doubling sorts the suffixes: ranks by the first line give ranks by the first
two lines, those ranks by four, and so on until no two suffixes share a rank. Each
round is one distributed sort of the different pairs (rank here, rank 2^k lines
on). Suffixes that begin with a line, or a doubled run, that no other place has are
settled and leave, so the rounds work on repeated runs only, and there are as many
as the longest repeated run has doublings. Whole copies of a document are told by
their text and take no part.

Suffixes of one rank after round k stand side by side in the array; they are an
interval whose longest common prefix is 2^k lines at least, and its first place in the
corpus is known from the round. Two things are read off:

* Maximal runs. A place whose 2^k lines stand earlier, k as large as can be, is
  compared with the first place of that interval: going down the rounds again gives
  their longest common prefix line by line. Where the place before is
  aligned to the place before the other's, the run doesn't begin here.
* Intervals at the depth that matters. Runs too short for their 2^k lines to hold ``min_words``
  words may reach them with another earlier place than the first. So for each place the interval of the shortest run
  with enough words is formed from two ranks, one at its begin, one at its end.

Every place but the first of an interval is a later copy, and its lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.columns import let, staged
from quire.llm.joins import counted_join
from quire.llm.storage import materialize

MIN_WORDS = 10
#: What separates words, but for line ends.
_BLANKS = " \t\x0b\f\r"


def _digest(value: Column) -> Column:
    """The first half of SHA-256, 16 bytes."""
    return F.unhex(F.substring(F.sha2(value.cast("binary"), 256), 1, 32))


def _document_key(id_col: str, text_col: str) -> Column:
    """16 bytes that name a document: its id and its text; a null text counts as empty."""
    ident = F.col(id_col).cast("string")
    return _digest(F.concat(F.coalesce(F.concat(F.length(ident).cast("string"), F.lit(":"), ident), F.lit("-")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, i, at, line, words, content, total): the i-th line with a word, at its place among all lines.

    A document's first line also has the digest of the text and the words in all lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    flat = text
    for blank in _BLANKS[1:]:
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    count = lambda line: F.size(F.array_remove(F.split(line, " "), ""))
    numbered = let(F.split(flat, "\n"), lambda plain: F.transform(F.split(text, "\n"), lambda x, k: F.struct(x.alias("text"), k.alias("at"), count(F.get(plain, k)).alias("words"))))
    with_word = let(F.filter(numbered, lambda x: x["words"] > 0), lambda xs: F.struct(xs.alias("lines"), F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("total")))
    rows = docs.select(F.col(id_col).alias("id"), _document_key(id_col, text_col).alias("key"), _digest(text).alias("content"), with_word.alias("d"))
    each = rows.select("key", "id", "content", F.col("d.total").alias("total"), F.posexplode("d.lines").alias("i", "x"))
    head = F.col("i") == 0
    return each.select(
        "key", "id", "i", F.col("x.at").alias("at"), _digest(F.col("x.text")).alias("line"), F.col("x.words").alias("words"),
        F.when(head, F.col("content")).alias("content"), F.when(head, F.col("total")).alias("total"),
    )


def _classes(places: DataFrame, by: list[str], name: str) -> DataFrame:
    """Groups of two places or more with n, their first place, and ``rank``, a number in the order of ``by``.

    The rows are sorted over the whole table: partition p holds smaller values
    than p + 1 and is sorted itself, so the generated id rises with the order. It
    is written before it is used, so it is the same wherever it is read.
    """
    groups = places.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key", "i")).alias("first")).filter("n > 1")
    return materialize(groups.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), name)


def _copies(lines: DataFrame) -> DataFrame:
    """(key, id, total, first): documents whose whole text an earlier one has, with that one's id and key."""
    heads = lines.filter("i = 0").select("key", "id", "content", "total").distinct()
    groups = heads.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key")).alias("first")).filter("n > 1")
    found = counted_join(heads, materialize(groups, "line-contents"), ["content"])
    return materialize(found.filter(F.col("first.key") != F.col("key")).select("key", "id", "total", "first"), "line-copies")


def _levels(places: DataFrame) -> list[DataFrame]:
    """Round k's table (key, id, i, rank, first): suffixes whose first 2^k lines stand elsewhere too.

    The first round's also has each line's ``at`` and ``words``.
    """
    classes = _classes(places, ["line"], "line-ranks")
    levels = [materialize(counted_join(places, classes, ["line"]).select("key", "id", "i", "rank", "first", "at", "words"), "line-level")]
    order, size = Window.partitionBy("key").orderBy("i"), 1
    while True:
        # a repeated run of twice the size has only repeated runs inside, so no row between is missing
        on = F.lead(F.struct("i", "rank"), size).over(order)
        paired = levels[-1].withColumn("on", on).filter(F.col("on.i") == F.col("i") + size)
        pairs = materialize(paired.select("key", "id", "i", F.col("rank").alias("head"), F.col("on.rank").alias("tail")), "line-pairs")
        classes = _classes(pairs, ["head", "tail"], "line-ranks")
        if classes.isEmpty():
            return levels
        levels.append(materialize(counted_join(pairs, classes, ["head", "tail"]).select("key", "id", "i", "rank", "first"), "line-level"))
        size *= 2


def _later(levels: list[DataFrame]) -> DataFrame:
    """(key, id, i, top, first): places whose 2^top lines stand earlier, top as large as can be, and where first."""
    marked = [level.filter(F.struct("id", "key", "i") != F.col("first")).select("key", "id", "i", F.lit(k).alias("top"), "first") for k, level in enumerate(levels)]
    out = marked[0]
    for more in marked[1:]:
        out = out.unionByName(more)
    best = F.max(F.struct("top", "first")).alias("best")
    return materialize(out.groupBy("key", "id", "i").agg(best).select("key", "id", "i", "best.top", "best.first"), "line-later")


def _runs(levels: list[DataFrame], later: DataFrame, least: int) -> DataFrame:
    """(key, id, i, n_lines, first): maximal runs of 2^least lines or more that stand earlier.

    ``n_lines`` is the longest common prefix with the first place.
    """
    before = F.lag(F.struct("i", "first"), 1).over(Window.partitionBy("key").orderBy("i"))
    goes_on = (F.col("before.i") == F.col("i") - 1) & (F.col("before.first.key") == F.col("first.key")) & (F.col("before.first.i") == F.col("first.i") - 1)
    starts = later.withColumn("before", before).filter(~F.coalesce(goes_on, F.lit(False)) & (F.col("top") >= least))
    runs = starts.select("key", "id", "i", "top", "first", F.call_function("shiftleft", F.lit(1), F.col("top")).alias("n_lines"))
    for k in reversed(range(len(levels) - 1)):
        # both go on by 2^k lines where the suffixes behind the common lines have one rank
        ranks = levels[k].select("key", "i", "rank")
        here = ranks.select(F.col("key").alias("k1"), F.col("i").alias("i1"), F.col("rank").alias("r1"))
        there = ranks.select(F.col("key").alias("k2"), F.col("i").alias("i2"), F.col("rank").alias("r2"))
        behind = runs.join(here, (F.col("top") > k) & (F.col("key") == F.col("k1")) & (F.col("i") + F.col("n_lines") == F.col("i1")), "left")
        both = behind.join(there, (F.col("first.key") == F.col("k2")) & (F.col("first.i") + F.col("n_lines") == F.col("i2")) & (F.col("r1") == F.col("r2")), "left")
        longer = F.col("n_lines") + F.when(F.col("r2").isNotNull(), 1 << k).otherwise(0)
        # a table a round: one plan of all rounds' joins is planned anew after each of its stages, in the driver's memory
        runs = materialize(both.select("key", "id", "i", "top", "first", longer.alias("n_lines")), "line-runs")
    return runs.select("key", "id", "i", "n_lines", "first")


def _windows(places: DataFrame, min_words: int) -> DataFrame:
    """(key, i, depth): the shortest runs of ``min_words`` words that begin or that end at a place.

    Every repeated run with enough words is a union of such runs, and whether a
    run is one depends on its own lines only.
    """
    order = Window.partitionBy("key").orderBy("i")
    item = F.struct("i", "words")
    ahead = F.collect_list(item).over(order.rowsBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list(item).over(order.rowsBetween(1 - min_words, 0)))

    def depth(items: Column, step: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def add(state: Column, x: Column) -> Column:
            joined = state["open"] & (state["sum"] < min_words) & (x["i"] == F.col("i") + step * state["n"])
            return F.struct(
                (state["sum"] + F.when(joined, x["words"]).otherwise(0)).alias("sum"), (state["n"] + F.when(joined, 1).otherwise(0)).alias("n"), joined.alias("open")
            )

        return F.aggregate(items, start, add, lambda s: F.when(s["sum"] >= min_words, s["n"]))

    both = places.select("key", "i", ahead.alias("ahead"), behind.alias("behind")).select("key", "i", depth(F.col("ahead"), 1).alias("fore"), depth(F.col("behind"), -1).alias("back"))
    runs = F.array(F.struct(F.col("i").alias("i"), F.col("fore").alias("depth")), F.struct((F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("depth")))
    return both.select("key", F.inline(F.array_distinct(F.filter(runs, lambda r: r["depth"].isNotNull())))).distinct()


def _short_copies(levels: list[DataFrame], later: DataFrame, min_words: int, long: int) -> DataFrame:
    """(key, i, n_lines): shortest runs with enough words that stand earlier, where no run of 2^long lines does."""
    windows = materialize(_windows(levels[0], min_words), "line-windows")
    found = []
    for k in range(min(long, len(levels) - 1) + 1):
        size, level = 1 << k, levels[k]
        due = windows.filter(F.col("depth").between(size, 2 * size - 1))
        begin = due.join(level.select("key", "i", "id", F.col("rank").alias("head")), ["key", "i"])
        end = level.select("key", F.col("i").alias("end"), F.col("rank").alias("tail"))
        found.append(begin.withColumn("end", F.col("i") + F.col("depth") - size).join(end, ["key", "end"]).select("key", "id", "i", "depth", "head", "tail"))
    runs = found[0]
    for more in found[1:]:
        runs = runs.unionByName(more)
    # ranks of different rounds don't meet, since the depth tells the round
    runs = materialize(runs, "line-intervals")
    by = ["depth", "head", "tail"]
    intervals = runs.groupBy(*by).agg(F.min(F.struct("id", "key", "i")).alias("first")).withColumn("n", F.lit(1))
    open_ = runs.join(later.filter(F.col("top") < long).select("key", "i"), ["key", "i"], "left_semi")
    sizes = open_.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    classes = materialize(sizes.join(intervals.drop("n"), by), "line-firsts")
    copies = counted_join(materialize(open_, "line-open"), classes, by).filter(F.struct("id", "key", "i") != F.col("first"))
    return copies.select("key", "i", F.col("depth").alias("n_lines"))


def _array(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(copies, levels, later) of the documents."""
    lines = materialize(_lines(docs, id_col, text_col), "lines")
    copies = _copies(lines)
    originals = lines.join(copies.select("key"), "key", "left_anti").select("key", "id", "i", "at", "line", "words")
    # rows that repeat id and text are one document
    twice = materialize(lines.filter("i = 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "line-repeats")
    if not twice.isEmpty():
        once = originals.join(twice, "key", "left_semi").dropDuplicates(["key", "i"])
        originals = originals.join(twice, "key", "left_anti").unionByName(once)
    levels = _levels(materialize(originals, "line-places"))
    return copies, levels, _later(levels)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, n_lines, words, first_id, first_line): maximal runs that stand earlier in the corpus.

    A run begins at the ``line``-th line with a word (from 0) and is compared with the
    first place of its longest doubled beginning; ``n_lines`` lines agree there, and
    neither the line before nor the line after does. Runs of fewer than ``min_words``
    words are left out. A document whose whole text stands earlier is one run. Null
    texts have no lines, rows that repeat id and text are one document, and an
    empty table gives an empty result.
    """
    copies, levels, later = _array(docs, id_col, text_col)
    runs = _runs(levels, later, 0)
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = materialize(levels[0].select("key", "i", "words", upto.alias("upto")), "line-sums")
    begin = sums.select("key", "i", (F.col("upto") - F.col("words")).alias("before"))
    end = sums.select("key", (F.col("i") + 1).alias("stop"), "upto")
    counted = runs.join(begin, ["key", "i"]).withColumn("stop", F.col("i") + F.col("n_lines")).join(end, ["key", "stop"])
    parts = counted.select("id", F.col("i").alias("line"), "n_lines", (F.col("upto") - F.col("before")).alias("words"), F.col("first.id").alias("first_id"), F.col("first.i").alias("first_line"))
    own = docs.select(_document_key(id_col, text_col).alias("key"), F.size(F.filter(F.split(text_col, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))).alias("n_lines")).distinct()
    whole = copies.join(own, "key").select("id", F.lit(0).alias("line"), "n_lines", F.col("total").alias("words"), F.col("first.id").alias("first_id"), F.lit(0).alias("first_line"))
    return parts.unionByName(whole).filter(F.col("words") >= min_words)


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, whole, lines): the places of each document's deleted lines, or that all lines with a word go.

    Documents without any are absent.
    """
    copies, levels, later = _array(docs, id_col, text_col)
    # 2^long lines hold enough words whatever they are
    long = max(0, (min_words - 1).bit_length())
    spans = _short_copies(levels, later, min_words, long).unionByName(_runs(levels, later, long).select("key", "i", "n_lines"))
    covered = spans.select("key", F.explode(F.sequence("i", F.col("i") + F.col("n_lines") - 1)).alias("i")).distinct()
    parts = covered.join(levels[0].select("key", "i", "at"), ["key", "i"]).groupBy("key").agg(F.collect_set("at").alias("lines"))
    whole = copies.filter(F.col("total") >= min_words).select("key", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("lines"))
    return parts.select("key", F.lit(False).alias("whole"), "lines").unionByName(whole)


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without later copies of line runs; adds ``n_lines`` and ``n_deleted``.

    A run of consecutive lines (blank ones between them don't count) that holds
    ``min_words`` words or more and stands at an earlier place too is deleted; the
    place of a line is its document's id, then its number. Lines are equal when
    identical. In a run that overlaps its own copy the first line stays. The rest of
    a text is joined by line ends as before, and a text whose lines are all
    deleted is empty.

    A null text stays null and has no lines; ``n_lines`` counts all lines of other
    texts. Rows that agree in id and text are one document and are treated alike.
    A null id comes first; different texts under one id stand in the order of a
    digest. Other columns pass through, whatever their names; ``n_lines`` and
    ``n_deleted`` are replaced. An empty table gives an empty result. A text of any
    length is one row, and so are its lines while they are counted.
    """
    deleted = materialize(deleted_lines(docs, min_words, id_col, text_col), "deleted-lines")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    rest = F.struct(*[F.col(f"`{c}`") for c in kept if c != text_col])
    rows = docs.select(rest.alias("rest"), F.col(text_col).alias("text"), _document_key(id_col, text_col).alias("key"))
    joined = rows.join(deleted, "key", "left")
    parted = staged(joined, {"all": F.when(F.col("whole").isNotNull(), F.split("text", "\n"))})
    blank = F.filter("all", lambda x: ~x.rlike("[^\\x20\\x09-\\x0D]"))
    some = F.transform(F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("lines")), lambda k: F.get("all", k))
    done = staged(parted, {"left": F.when(F.col("whole"), blank).when(F.col("whole").isNotNull(), some)})
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    text = F.when(F.col("whole").isNull(), F.col("text")).otherwise(F.array_join("left", "\n"))
    n_deleted = F.when(F.col("whole").isNull(), 0).otherwise(F.size("all") - F.size("left")).cast("long")
    columns = [text.alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in kept]
    return done.select(*columns, n_lines.alias("n_lines"), n_deleted.alias("n_deleted"))
