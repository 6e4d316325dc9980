import pytest
from pyspark.sql import functions as F

from quire.functions import naming
from quire.functions import text as T


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_levenshtein_ratio(spark):
    pairs = [("hello", "hello"), ("abc", "xyz"), ("hello", "helpo"), ("", ""), ("abc", ""), ("ä", "a")]
    got = values(spark, pairs, "a string, b string", T.levenshtein_ratio(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [0.0, 1.0, 0.2, 0.0, 1.0, 1.0]


def test_levenshtein_within_agrees_with_the_ratio(spark):
    pairs = [("a" * 100, "a" * 95 + "b" * 5), ("a" * 100, "a" * 94 + "b" * 6), ("a" * 100, "a" * 90), ("x", "x"), ("", "a"), ("", "")]
    got = values(spark, pairs, "a string, b string", T.levenshtein_within(F.col("a"), F.col("b"), 0.05))
    assert [g[0] for g in got] == [True, False, False, True, False, True]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("take 5 mg and 10 mL", "10 mL then 5 mg", True),
        ("total 166.50", "total 168.50", False),
        ("1.25 mg", "125 mg", False),
        ("no numbers", "none here either", True),
        ("٣ mg", "3 mg", False),
        ("٣ mg", "٣mg", True),
    ],
)
def test_number_multiset(spark, a, b, same):
    assert values(spark, [(a, b)], "a string, b string", T.same_numbers(F.col("a"), F.col("b"))) == [(same,)]


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("the quick brown fox jumps over the lazy dog today", "ok"),
        ("S c a l i n g o f t h e w h o l e p a g e h e r e", "word-length"),
        ("a b c d e f g h i j kilogram lemonade marmalade nougats", "single-chars"),
        ("?? ## !! ** ?? ## !! ** ?? ## !! ** ??", "symbols"),
        ("Cover", "sparse"),
        ("", "empty"),
        ("   ", "empty"),
        (" ".join(["x" * 30] * 4), "word-length"),
        ("été à la plage et près des forêts enneigées", "ok"),
    ],
)
def test_text_quality(spark, text, label):
    assert values(spark, [(text,)], "t string", T.quality_label(T.one_spaced(F.col("t")))) == [(label,)]


def test_lists(spark):
    ids = F.array(*[F.lit(i) for i in range(12, 0, -1)])
    few = F.array(F.lit(3), F.lit(1))
    got = values(spark, [(1,)], "x int", T.page_list_short(ids), T.page_list_short(few), T.failing_pages_tag(ids), T.failing_pages_display(F.array_sort(ids)))
    assert got == [("[1, 2, 3, 4, 5, 6, 7, 8, 9, 10, ... (+2 more)]", "[1, 3]", "1,2,3,4,5,6,7,8,9,10+2", "12 pages ([1, 2, 3, 4, 5] ... [10, 11, 12])")]
    with pytest.raises(ValueError):
        T.page_list_short(ids, 0)


def test_redaction(spark):
    got = values(spark, [("/home/x/patient-records-2026.pdf",), ("a.b",)], "p string", T.redact_name(F.col("p")))
    assert got[0][0].endswith("…2026.pdf") and len(got[0][0]) == 17 and got[1][0].endswith("…a.b")
    assert values(spark, [("abcd",)], "t string", T.redact_text(F.col("t")), T.redact_text(F.col("t"), 2)) == [("<redacted:4-chars>", "<redacted:2-chars>")]


def test_composed_names(spark):
    got = values(spark, [("e\u0301",), ("plain",), (None,), ("\u00e9",)], "t string", T.nfc(F.col("t")))
    assert [g[0] for g in got] == ["\u00e9", "plain", None, "\u00e9"]


def test_fixed_decimals(spark):
    import random

    r = random.Random(8)
    found = [5.005, 0.125, 2.675, -0.125, 0.0, 1e9 + 0.5, 78.125, 65.625, 0.9995, 99.995, -3.999999] + [r.uniform(-1000, 1000) for _ in range(2000)] + [r.randrange(-9999, 9999) / 64 for _ in range(1000)]
    got = values(spark, [(x,) for x in found], "x double", *[T.fixed(F.col("x"), n) for n in (1, 2, 3, 4)])
    assert got == [tuple(f"{x:.{n}f}" for n in (1, 2, 3, 4)) for x in found]


def test_escape_order(spark):
    assert values(spark, [("a(b)\\",)], "t string", T.pdf_escape(F.col("t"))) == [("a\\(b\\)\\\\",)]


def test_versions(spark):
    rows = [("tesseract 5.3.4\n leptonica-1.84.1",), ("\n",), (None,)]
    assert values(spark, rows, "t string", T.tool_version(F.col("t"))) == [("5.3.4",), (None,), (None,)]
    floors = [("11.6.4", "11.6.3", True), ("11.6.3-1", "11.6.3", True), ("9.9", "10.0", False), ("11.6", "11.6.0", False)]
    got = values(spark, floors, "a string, b string, ok boolean", T.meets_floor(F.col("a"), F.col("b")), "ok")
    assert all(a == b for a, b in got)


def test_names(spark):
    rows = [("doc_0007.pdf", "doc"), ("doc_07.pdf", "doc"), ("doc_12345.pdf", "doc"), ("other_001.pdf", "doc"), ("doc_abc.pdf", "doc"), ("a+b_004.pdf", "a+b")]
    got = values(spark, rows, "n string, b string", naming.stale_index(F.col("n"), F.col("b"), F.lit(".pdf")))
    assert [g[0] for g in got] == [7, None, 12345, None, None, 4]
    names = values(spark, [(7, 9), (7, 1200)], "i int, n int", naming.chunk_name(F.lit("x"), F.col("i"), F.col("n"), F.lit(".pdf")))
    assert names == [("x_007.pdf",), ("x_0007.pdf",)]
    formats = [(None, "o.JPG"), ("png", "o.pdf"), (None, "o"), ("png", "o.png"), (None, "dir.png/o")]
    got = values(spark, formats, "e string, p string", naming.resolve_format(F.col("e"), F.col("p")).alias("f"))
    assert [tuple(g[0]) for g in got] == [("jpeg", False), ("png", True), ("pdf", False), ("png", False), ("pdf", False)]


def test_text_stream(spark):
    op = T.text_operators(F.col("t"), F.lit(0), F.lit(0), F.col("w"), F.lit(10), F.lit(100.0), F.lit(100.0), F.lit(50.0), F.lit(50.0))
    got = values(spark, [("naïve", 20), (" ", 20), ("x", 0)], "t string, w int", op)
    assert got[0][0] == "/F-Invisible 5.000 Tf\n80.00 Tz\n1 0 0 1 0.000 45.000 Tm\n(na?ve) Tj" and got[1:] == [(None,), (None,)]
    assert values(spark, [(1,)], "x int", T.text_stream(F.array().cast("array<string>"))) == [("",)]
