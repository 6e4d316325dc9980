"""The pipeline's stages against brute force, and that the rest of the library needs none of this."""

import subprocess
import sys

import pytest
from fixtures import WORD, frame, plain_languages, plain_line_dedup

import corpus_pipeline as P
from quire.llm import langid, mixing, packing


@pytest.fixture(scope="module")
def stages(spark, rows):
    """The input and output of each stage, as lists of rows."""
    unique = [r for i, r in enumerate(rows) if r[0] is not None and not (r[0] == 5 and i > 5)]
    table, seen = frame(spark, unique, extra=False), []
    for _, stage in P.STAGES:
        made = stage(spark, table, "").cache()
        seen.append((table.collect(), made.collect(), made.columns))
        table = made
    return seen


def test_languages(stages):
    before, after, columns = stages[0]
    assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
    judged = plain_languages([(r.text, r.lang) for r in before], [r.text for r in before])
    letters = lambda t: sum(c.isalpha() for c in t or "")
    wanted = {r.doc_id for r, (lang, score) in zip(before, judged, strict=True) if lang != "und" and (score >= langid.FLOOR or letters(r.text) < langid.FLOOR_LETTERS)}
    assert {r.doc_id for r in after} == wanted
    assert {r.doc_id for r in before if letters(r.text)} - wanted <= {908, 909}


def test_unknown_scripts_go_and_short_texts_stay(spark, rows):
    import random

    r = random.Random(7)
    learned = [(x[0], x[1], x[2]) for x in rows[:120]]
    foreign = [(5000 + i, "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(200)), "en") for i in range(60)]
    short = [(6000 + i, t, "en") for i, t in enumerate(["A.", "Avec.", "Oui!", "x", "中"])]
    # foreign texts teach nothing here, so that no prototype knows them
    table = spark.createDataFrame([(*x, "s", 0) for x in learned + [(i, t, None) for i, t, _ in foreign + short]], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in P.language_id(spark, table, "").collect()}
    assert {i for i, *_ in learned} <= kept and {i for i, *_ in short} <= kept
    assert len({i for i, *_ in foreign} & kept) <= 3


def test_lines(stages):
    before, after, _ = stages[1]
    left = plain_line_dedup([tuple(r) for r in before], 10)
    wanted = {r.doc_id: left[i] for i, r in enumerate(before) if left[i] == (r.text or "") or WORD.search(left[i])}
    assert {r.doc_id: r.text for r in after} == wanted
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_duplicates(stages):
    before, after, _ = stages[2]
    kept = {r.doc_id for r in after}
    shingles = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in before for w in [r.text.lower().split()]}

    def alike(a, b):
        both = len(shingles[a] & shingles[b])
        return both >= 0.8 * (len(shingles[a]) + len(shingles[b]) - both)

    left, wanted = set(shingles), set()
    while left:
        group, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left - group if alike(x, y)}
            todo += near - set(todo)
        wanted.add(min(group))
        left -= group
    # no clean document goes; a link near 0.8 may be missed
    assert wanted <= kept and len(kept - wanted) <= 2 and len(after) == len(kept)


def test_rows_are_told_apart_by_text(spark):
    """Different texts under one id, near copies without any id, repeated rows."""
    text = " ".join(f"w{i}" for i in range(400))
    near = text.replace("w200 ", "changed ")
    other = " ".join(f"v{i}" for i in range(400))
    rows = [(1, text, "a"), (1, other, "a"), (2, near, "a"), (None, text + " end", "a"), (3, other + " end", "a"), (None, "alone", "a"), (7, "twice", "a"), (7, "twice", "b"), (8, None, "a"), (9, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in P.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(1, text, "a"), (1, other, "a"), (None, "alone", "a"), (8, None, "a"), next(r for r in got if r[0] == 7)], key=repr)
    for _ in range(2):
        assert sorted(map(tuple, P.near_dedup(spark, docs.repartition(7), "").collect()), key=repr) == sorted(got, key=repr)


def test_mix(stages):
    before, after, columns = stages[3]
    assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
    copies = {r.doc_id: sum(x.doc_id == r.doc_id for x in after) for r in before}
    assert set(copies.values()) <= {0, 1, 2} and len(after) == sum(copies.values())
    taken = sum(len(WORD.findall(r.text)) for r in after)
    whole = sum(len(WORD.findall(r.text)) for r in before)
    assert abs(taken - 1.5 * whole) <= 3 * max(len(WORD.findall(r.text)) for r in before)


def test_sequences(stages):
    before, after, _ = stages[4]
    total = sum(r.length for r in after)
    sequences = {}
    for r in after:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= P.PACK_TOKENS
    assert len({(r.doc_id) for r in after}) == len({r.doc_id for r in before}) and len(sequences) <= 1.05 * total / P.PACK_TOKENS + 2
    assert packing.minimum_bin_slack({}, 5) == [] and langid.train is not None and mixing.LEVELS == 4


def test_awkward_and_empty_tables(spark, docs, none):
    assert P.near_dedup(spark, docs, "").columns == docs.columns
    for table in (docs, none):
        rows = table
        for _, stage in P.STAGES:
            rows = stage(spark, rows, "")
        assert (rows.count() > 0) == (table is docs)


def test_run(spark, sf_dir):
    assert P.run(spark, sf_dir).count() > 100 and 4 <= len(P.STAGES) <= 5


def test_library_without_this():
    code = "import sys; sys.modules['quire.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
