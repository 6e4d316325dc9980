"""Text measures and formats as Column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.columns import let

#: Fixed values of the text-quality heuristic.
SPARSE_CHARS = 30
LEAST_LETTER_SHARE = 0.5
WORD_LENGTH = (2.0, 12.0)
MOST_SINGLE_SHARE = 0.4
#: Fixed value: numbers, with a decimal part and a unit if they have them.
NUMBER_PATTERN = r"\d+(?:[.,]\d+)?(?:\s*(?:mg|mcg|mL|IU|ng|g|kg|lb|oz|%))?"


#: Edits up to which two texts are compared along diagonals.
FEW_EDITS = 48


def fold_ascii(text: Column) -> Column:
    """Every code point beyond ASCII as a question mark."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def one_spaced(text: Column) -> Column:
    """The words of a text, joined by one blank."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def quality_label(joined: Column) -> Column:
    """Why a text layer of blank-joined words is decent or not.

    empty, sparse (too short to judge, so decent), symbols, no-words,
    word-length, single-chars or ok. The text and its words are bound once.
    """

    def judged(words: Column, text: Column) -> Column:
        count, chars = F.size(words), F.length(text)
        symbols = chars - F.length(F.regexp_replace(text, r"(?U)[^\p{L}\s]+", ""))
        mean = F.length(F.array_join(words, "")) / count
        single = F.size(F.filter(words, lambda w: F.length(w) == 1)) / count
        return (
            F.when((chars - symbols) / chars < LEAST_LETTER_SHARE, "symbols")
            .when(count == 0, "no-words")
            .when((mean < WORD_LENGTH[0]) | (mean > WORD_LENGTH[1]), "word-length")
            .when(single > MOST_SINGLE_SHARE, "single-chars")
            .otherwise("ok")
        )

    def label(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(r"(?<![^ ])\p{L}++(?![^ ])"), F.lit(0))
        long = let(words, lambda ws: judged(ws, text))
        return F.when(F.coalesce(text, F.lit("")) == "", "empty").when(F.length(text) < SPARSE_CHARS, "sparse").otherwise(long)

    return let(joined, label)


def is_decent(joined: Column) -> Column:
    return quality_label(joined).isin("sparse", "ok")


def _common(a: str, i: int, b: str, j: int) -> int:
    """How many characters agree from a[i] and b[j] on, by halves of slices."""
    most = min(len(a) - i, len(b) - j)
    low, step = 0, 32
    while low < most and a[i + low : i + low + step] == b[j + low : j + low + step]:
        low, step = min(low + step, most), step * 2
    high = min(low + step, most)
    while low < high:
        middle = (low + high + 1) // 2
        if a[i + low : i + middle] == b[j + low : j + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def few_edits(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is at most ``most``, by furthest places on diagonals: steps grow with its square, not the texts."""
    goal = len(b) - len(a)
    if abs(goal) > most:
        return None
    reach = {0: _common(a, 0, b, 0)}
    for edits in range(most + 1):
        if reach.get(goal, -1) >= len(a):
            return edits
        further = {}
        for d in range(max(-edits - 1, goal - most), min(edits + 1, goal + most) + 1):
            i = min(max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1), len(a), len(b) - d)
            if i >= max(0, -d):
                further[d] = i + _common(a, i, b, i + d)
        reach = further
    return None


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance of whole texts: few edits by diagonals, more with a column of the table per step as bits of one integer (Myers, Hyyrö)."""
    if a == b:
        return 0
    few = few_edits(a, b, FEW_EDITS)
    if few is not None:
        return few
    if len(a) > len(b):
        a, b = b, a
    start, least = 0, len(a)
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : least - end], b[start : len(b) - end]
    if not a:
        return len(b)
    places: dict[str, bytearray] = {}
    for i, ch in enumerate(a):
        places.setdefault(ch, bytearray(len(a) // 8 + 1))[i >> 3] |= 1 << (i & 7)
    equal = {ch: int.from_bytes(bits, "little") for ch, bits in places.items()}
    mask, last, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = mask, 0
    for ch in b:
        same = equal.get(ch, 0)
        across = (((same & up) + up) ^ up) | same
        right, left = down | (mask & ~(across | up)), up & across
        distance += bool(right & last) - bool(left & last)
        right, left, same = (right << 1 | 1) & mask, left << 1 & mask, same | down
        up, down = left | (mask & ~(same | right)), right & same
    return distance


def _edit_distances(a: Column, b: Column) -> Column:
    @F.arrow_udf("long")
    def distances(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = ((p.as_py(), q.as_py()) for p, q in zip(x, y, strict=True))
        return pa.array([None if p is None or q is None else edit_distance(p, q) for p, q in pairs], pa.int64())

    return distances(a, b)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(_edit_distances(a, b) / F.greatest(longer, F.lit(1)))


def levenshtein_within(a: Column, b: Column, ceiling: float) -> Column:
    """Whether the ratio is at most ``ceiling``: equality and lengths decide most pairs before the distance does."""
    allowed = F.floor(F.greatest(F.length(a), F.length(b)) * F.lit(ceiling)).cast("int")
    far = F.abs(F.length(a) - F.length(b)) > allowed
    unsure = ~far & (a != b)
    return F.when(a == b, True).when(far, False).otherwise(_edit_distances(F.when(unsure, a), F.when(unsure, b)) <= allowed)


def number_tokens(text: Column, unicode_digits: bool = True) -> Column:
    """Sorted number tokens of a text, inner white space removed."""
    pattern = ("(?U)" if unicode_digits else "") + NUMBER_PATTERN
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_sort(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", "")))


def same_numbers(a: Column, b: Column, unicode_digits: bool = True) -> Column:
    """Whether two texts have the same multiset of number tokens (T4)."""
    return number_tokens(a, unicode_digits) == number_tokens(b, unicode_digits)


def nfc(text: Column) -> Column:
    """The text in Unicode's composed normal form (T7); ASCII is in it already."""

    @F.arrow_udf("string")
    def composed(x: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in x.to_pylist()], pa.string())

    return composed(text)


def redact_name(path: Column) -> Column:
    """Eight digits of the base name's SHA-1, an ellipsis and its last eight characters (T5)."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.concat(F.substring(F.sha1(base.cast("binary")), 1, 8), F.lit("…"), F.right(base, F.lit(8)))


def redact_text(text: Column, limit: int = 0) -> Column:
    """A text's length in place of the text, at most ``limit`` if given."""
    n = F.least(F.length(text), F.lit(limit)) if limit else F.length(text)
    return F.format_string("<redacted:%d-chars>", n)


def page_list_short(ids: Column, limit: int = 10) -> Column:
    """``[1, 2, ... (+N more)]`` of page numbers in order."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    shown = F.array_join(F.slice(F.array_sort(ids), 1, limit), ", ")
    more = F.when(F.size(ids) > limit, F.format_string(", ... (+%d more)", F.size(ids) - limit)).otherwise("")
    return F.concat(F.lit("["), shown, more, F.lit("]"))


def failing_pages_tag(ids: Column, limit: int = 10) -> Column:
    """Page numbers in order, joined by commas, ``+N`` past the limit."""
    shown = F.array_join(F.slice(F.array_sort(ids), 1, limit), ",")
    return F.concat(shown, F.when(F.size(ids) > limit, F.format_string("+%d", F.size(ids) - limit)).otherwise(""))


def failing_pages_display(ids: Column, inline: int = 10) -> Column:
    """All page numbers, or the first five and the last three."""
    listed = lambda x: F.concat(F.lit("["), F.array_join(x, ", "), F.lit("]"))
    ends = F.format_string("%d pages (%s ... %s)", F.size(ids), listed(F.slice(ids, 1, 5)), listed(F.slice(ids, F.greatest(F.size(ids) - 2, F.lit(1)), F.lit(3))))
    return F.when(F.size(ids) <= inline, F.concat(F.lit("pages "), listed(ids))).otherwise(ends)


def fixed(value: Column, digits: int) -> Column:
    """A double with ``digits`` decimals, its binary value rounded, ties to even.

    ``format_string`` rounds the shortest decimal that names the double, halves
    up, which differs for 5.005 or 0.125. Here the fraction is cut in two parts whose
    products with the power of ten are exact, so the comparison with a half is too.
    """
    scale = float(10**digits)

    def rounded(x: Column) -> Column:
        whole = F.floor(x["v"])
        fraction = x["v"] - whole
        high = F.floor(fraction * float(1 << 26)) / float(1 << 26)
        low = fraction - high
        return F.struct(whole.alias("whole"), F.floor(high * scale).alias("part"), (high * scale - F.floor(high * scale) - 0.5 + low * scale).alias("over"), x["negative"].alias("negative"))

    def written(x: Column) -> Column:
        up = (x["over"] > 0) | (x["over"] == 0) & (x["part"] % 2 == 1)
        total = x["whole"] * int(scale) + x["part"] + F.when(up, 1).otherwise(0)
        whole = F.concat(F.when(x["negative"], "-").otherwise(""), F.floor(total / F.lit(int(scale))).cast("string"))
        return F.concat(whole, F.lit("."), F.lpad((total % int(scale)).cast("string"), digits, "0"))

    doubled = value.cast("double")
    return let(F.struct(F.abs(doubled).alias("v"), (doubled < 0).alias("negative")), lambda x: let(rounded(x), written))


def pdf_escape(text: Column) -> Column:
    """Backslashes and parentheses escaped, backslashes first."""
    for char in ("\\", "(", ")"):
        text = F.replace(text, F.lit(char), F.lit("\\" + char))
    return text


def text_operators(text: Column, x: Column, y: Column, w: Column, h: Column, raster_w: Column, raster_h: Column, page_w: Column, page_h: Column) -> Column:
    """The four text operators of one word box, null for a blank or empty box.

    The font size is the box's height in points and the horizontal scale fits
    half an em a character to the box's width; characters beyond ASCII become ``?``.
    """
    sx, sy = page_w / raster_w, page_h / raster_h
    size = h * sy
    scale = (w * sx) / F.greatest(F.lit(0.5) * F.length(text) * size, F.lit(1e-3)) * 100
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("/F-Invisible "), fixed(size, 3), F.lit(" Tf")),
        F.concat(fixed(scale, 2), F.lit(" Tz")),
        F.concat(F.lit("1 0 0 1 "), fixed(x * sx, 3), F.lit(" "), fixed(page_h - (y + h) * sy, 3), F.lit(" Tm")),
        F.concat(F.lit("("), pdf_escape(text), F.lit(") Tj")),
    )
    return F.when((F.trim(text) != "") & (w > 0) & (h > 0), fold_ascii(lines))


def text_stream(operators: Column) -> Column:
    """A page's text object from the operators of its boxes, in order; empty without boxes."""
    body = F.filter(operators, lambda o: o.isNotNull())
    whole = F.concat(F.array_join(F.concat(F.array(F.lit("q"), F.lit("BT"), F.lit("3 Tr")), body, F.array(F.lit("ET"), F.lit("Q"))), "\n"), F.lit("\n"))
    return F.when(F.size(operators) == 0, "").otherwise(whole)


def message_line(tool: str, level: str, code: Column, message: Column, name: Column | None = None, correlation: Column | None = None) -> Column:
    """``[tool] corr=… redacted: level [CODE]: message``, parts that are missing left out."""
    corr = F.when(correlation.isNotNull(), F.concat(F.lit(" corr="), F.substring(correlation, 1, 8))).otherwise("") if correlation is not None else F.lit("")
    tagged = F.concat(F.lit("["), code, F.lit("]: "), message)
    bare = F.concat(F.lit(f"[{tool}] {level}"), corr, F.lit(" "), tagged)
    if name is None:
        return bare
    named = F.concat(F.lit(f"[{tool}]"), corr, F.lit(" "), redact_name(name), F.lit(f": {level} "), tagged)
    return F.when(name.isNull(), bare).otherwise(named)


def report_line(input_bytes: Column, output_bytes: Column, ratio: Column, pages: Column, wall_ms: Column, status: Column, warnings: Column) -> Column:
    """One line on a finished document, with thousands separators."""
    percent = output_bytes / F.greatest(F.lit(1), input_bytes) * 100
    tail = F.when(warnings > 0, F.format_string(" warnings=%d", warnings)).otherwise("")
    return F.concat(
        F.lit("ok  "), F.format_number(input_bytes, 0), F.lit(" -> "), F.format_number(output_bytes, 0),
        F.lit(" bytes ("), fixed(percent, 1), F.lit("%, ratio "), fixed(ratio, 2), F.format_string("x, %d pages, %d ms) verifier=%s", pages, wall_ms, status), tail,
    )


def first_version(text: Column) -> Column:
    """The first ``X.Y`` or ``X.Y.Z`` in a text, or null."""
    found = F.regexp_extract(text, r"\b(\d+\.\d+(?:\.\d+)?)\b", 1)
    return F.nullif(found, F.lit(""))


def tool_version(raw: Column, line_with: str | None = None) -> Column:
    """The version on the first line that holds ``line_with`` (else the first non-blank line), or anywhere for such a tool."""
    lines = F.filter(F.split(raw, r"\r?\n"), lambda x: F.trim(x) != "")
    if line_with is None:
        return first_version(F.get(lines, 0))
    own = F.filter(lines, lambda x: F.lower(x).contains(line_with) & first_version(x).isNotNull())
    return F.coalesce(first_version(F.get(own, 0)), first_version(raw))


def version_numbers(version: Column) -> Column:
    """Dotted numbers as an array; what follows a part's digits is dropped."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\d+", 0).try_cast("int"), F.lit(0)))


def meets_floor(found: Column, floor: Column) -> Column:
    return version_numbers(found) >= version_numbers(floor)


def known_or(value: Column, fallback: Column) -> Column:
    """``value`` unless null, empty or 'unknown'."""
    return F.coalesce(F.nullif(F.nullif(value, F.lit("")), F.lit("unknown")), fallback)
