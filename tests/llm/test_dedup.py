import hashlib

import numpy as np
import pytest
from fixtures import plain_line_dedup
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quire.llm import components, exact_dedup, joins, line_dedup, simhash


def sorted_rows(found):
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, rows, weak):
    """With a digest that many texts share, only whole texts tell groups apart."""
    digest = (lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(5)).cast("string")) if weak else exact_dedup.sha256_hex
    got = exact_dedup.exact_dedup(docs, digest=digest, salts=3)
    assert set(docs.columns) <= set(got.columns)
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    wanted = []
    for doc_id, text, *_ in rows:
        own = groups[text or ""]
        keep = max((x for x in own if x is not None), default=None)
        wanted.append((doc_id, keep, len(own), doc_id == keep))
    assert sorted_rows(got.select("doc_id", "keep_id", "group_size", "kept").collect()) == sorted_rows(wanted)
    if not weak:
        sums = {r.digest for r in got.select("digest").collect()}
        assert sums == {hashlib.sha256(t.encode()).hexdigest() for t in groups}


def test_exact_empty(none):
    assert exact_dedup.exact_dedup(none).count() == 0


def plain_simhash(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(items, linked):
    """Smallest id of each item's class, from (id, value) items."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if linked(items[a][1], items[b][1]):
                parent[find(a)] = find(b)
    least = {}
    for i, (ident, _) in enumerate(items):
        if ident is not None:
            least[find(i)] = min(least.get(find(i), ident), ident)
    return [least.get(find(i)) for i in range(len(items))]


@pytest.mark.parametrize(("width", "distance"), [(4, 4), (5, 11)])
def test_simhash(docs, rows, width, distance):
    got = simhash.near_duplicates(docs, width, distance).select("id", simhash.hex_fingerprint(F.col("fp")), "component_id").collect()
    items = [(r[0], plain_simhash(r[1], width)) for r in rows]
    wanted = [(i, f"{fp:016x}", c) for (i, fp), c in zip(items, plain_classes(items, lambda a, b: (a ^ b).bit_count() <= distance), strict=True)]
    assert sorted_rows(got) == sorted_rows(wanted)


def test_simhash_in_blocks(monkeypatch):
    """Blocks of words and of bytes change nothing, wherever they end."""
    text = (" ".join(f"W{i % 50}" for i in range(400)) + "  \t\nend").encode()
    whole = [simhash.simhash(text, w) for w in (1, 4, 500)]
    assert whole == [plain_simhash(text.decode(), w) for w in (1, 4, 500)]
    for block, size in ((1, 10), (3, 1), (7, 64), (64, 33)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "TEXT_BLOCK", size)
        assert [simhash.simhash(text, w) for w in (1, 4, 500)] == whole


def test_simhash_empty(none):
    assert simhash.near_duplicates(none).count() == simhash.similar_documents(none).count() == 0


@given(st.integers(0, 60), st.data())
@settings(max_examples=200, deadline=None)
def test_segments_miss_nothing(distance, data):
    """However the differing bits lie, some segment has two of them at most."""
    plan = simhash.segments(distance)
    assert sum(w for _, w in plan) == 64 and plan[-1][0] == 0 and len(plan) >= 2
    flipped = sum(1 << b for b in data.draw(st.sets(st.integers(0, 63), max_size=distance)))
    assert any((flipped >> shift & (1 << width) - 1).bit_count() <= 2 for shift, width in plan)


def by_bits(distance):
    return lambda a, b: F.bit_count(a("node").bitwiseXOR(b("node"))) <= distance


@pytest.mark.parametrize("distance", [4, 11])
def test_connect_in_a_crowd(spark, distance):
    """Fingerprints that share every segment's value but one, chains of them, and strangers."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    values = {base ^ int(x) for x in rng.integers(0, 1 << 14, 300)} | {int(x) for x in rng.integers(0, 1 << 62, 300)} | {-1, -2, 0, 1, 31, 1023}
    table = spark.createDataFrame([(v,) for v in values], "node long")
    own, balls = simhash.ball_keys(F.col("node"), distance)
    passes = [f"p{i}" for i in range(len(balls))]
    nodes = table.select("node", own.alias("base"), *[b.alias(p) for b, p in zip(balls, passes, strict=True)])
    assert {sum(len(r[p]) for p in passes) for r in nodes.collect()} == {64 + distance // 3 + 1}
    got = {r.node: r.root for r in simhash.connect(nodes, [], by_bits(distance), passes).collect()}
    items = [(v, v) for v in sorted(values)]
    wanted = dict(zip([v for v, _ in items], plain_classes(items, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= distance), strict=True))
    classes = {}
    for v in values:
        classes.setdefault(got.get(v, v), set()).add(v)
    expected = {}
    for v, root in wanted.items():
        expected.setdefault(root, set()).add(v)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))


def plain_shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_copies(seed=5):
    """Texts with copies in which some words are changed, moved or cut, at similarities from 0.5 to 1."""
    import random

    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    out = []
    for _ in range(150):
        words = [word() for _ in range(r.choice([30, 80, 200, 600]))]
        out.append(" ".join(words))
        for _ in range(4):
            new, edits = list(words), r.randint(0, max(1, len(words) // 70))
            for _ in range(edits):
                new[r.randrange(len(new))] = word()
            if r.random() < 0.3:
                new = new[: int(len(new) * r.uniform(0.8, 1))]
            out.append(" ".join(new))
    return out


def test_similar_documents_recall(spark):
    """Every class holds only what links of 0.8 or more connect, and over 0.9 of these pairs are found."""
    texts = sorted(set(edited_copies()))
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.id: r["class"] for r in got}
    sets = [plain_shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] & sets[b] and jaccard(sets[a], sets[b]) >= 0.8]
    near = [(a, b) for a, b in pairs if jaccard(sets[a], sets[b]) < 0.85]
    exact = dict(zip(range(len(texts)), plain_classes(list(enumerate(range(len(texts)))), lambda a, b, linked=set(pairs): (a, b) in linked), strict=True))
    assert all(len({exact[i] for i in own}) == 1 for c in set(found.values()) for own in [[i for i in found if found[i] == c]])
    assert len(pairs) > 500 and len(near) > 100
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.95 * len(pairs)
    assert sum(found[a] == found[b] for a, b in near) >= 0.9 * len(near)


@pytest.mark.parametrize("least", [simhash.COMMON_LEAST, 2])
def test_similar_documents_miss_nothing(spark, monkeypatch, least):
    """Every pair of 0.8 or more ends in one class, and only such links join, also where shared shingles count as common."""
    monkeypatch.setattr(simhash, "COMMON_LEAST", least)
    if least == 2:
        monkeypatch.setattr(simhash, "ESTIMATE", 1)
    texts = sorted({*edited_copies(6), *(f"a b c d e f g h {i} " + " ".join(f"u{i}v{k}" for k in range(20)) for i in range(30)), "one", "two words", ""})[::2]
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.id: r["class"] for r in got}
    sets = [plain_shingles(t) for t in texts]
    pairs = {(a, b) for a in range(len(texts)) for b in range(a) if sets[a] & sets[b] and jaccard(sets[a], sets[b]) >= 0.8}
    exact = plain_classes(list(enumerate(range(len(texts)))), lambda a, b: (max(a, b), min(a, b)) in pairs)
    assert len(pairs) > 100 and all(found[a] == found[b] for a, b in pairs)
    assert len(set(exact)) == len(set(found.values())) == len({(exact[i], found[i]) for i in found})


def sketched(spark, texts):
    """(source, table) of texts, nodes in their order."""
    digests = [hashlib.sha256(t.encode()).digest() for t in texts]
    source = spark.createDataFrame(list(zip(digests, map(str.encode, texts), strict=True)), "digest binary, text binary")
    nodes = spark.createDataFrame([(d, i) for i, d in enumerate(digests)], "digest binary, node long")
    return source, simhash.sketches(source, 5, 0.8).join(nodes, "digest").cache()


def test_shared_passages_are_not_compared(spark):
    """Texts that share a passage meet under its shingles, but only those that can be similar are compared."""
    passage = " ".join(f"p{k}" for k in range(14))
    texts = [" ".join(f"u{i}v{k}" for k in range(50)) + f" {passage} " + " ".join(f"w{i}x{k}" for k in range(50)) for i in range(40)]
    texts += [texts[3].replace("u3v7 ", "changed "), texts[9] + " and more", texts[0] + " " + " ".join(f"y{k}" for k in range(24))]
    source, table = sketched(spark, texts)
    seen = []

    def compare(pairs):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return pairs

    classes = simhash.link_rest(source, table, spark.createDataFrame([], "node long, class long"), 5, 0.8, compare).collect()
    assert {tuple(sorted(p)) for p in seen} == {(3, 40), (9, 41), (0, 42)} and len(seen) == 3
    assert {(r.node, r["class"]) for r in classes} == {(x, min(p)) for p in [(3, 40), (9, 41), (0, 42)] for x in p}


def test_frequent_shingles_bring_nobody_together(spark, monkeypatch):
    """Passages that many texts share, each in some of them, come behind the texts' own shingles and out of their prefixes."""
    passages = [" ".join(f"p{j}w{k}" for k in range(24)) for j in range(4)]
    texts = [f"{' '.join(f'u{i}v{k}' for k in range(40))} {passages[i % 4]}" for i in range(320)]
    texts += [f"{texts[i]} and more" for i in (3, 9)]
    met = []

    def counted(places, similarity, roomy=simhash._roomy_pairs):
        met.append(places.groupBy("key").count().agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0] or 0)
        return roomy(places, similarity)

    monkeypatch.setattr(simhash, "_roomy_pairs", counted)
    got = {r.id: r["class"] for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(set(got.values())) == 320 and got[3] == got[320] and got[9] == got[321]
    assert met[0] < 320


def test_own_shingles_leave_no_room(spark):
    """Texts of a crowd whose own shingles lie before all that they share don't meet; those with fewer do."""
    places = [(key, node, node, 100, 15 + key, key) for node in range(20) for key in range(5)]
    places += [(9 + key, node, node, 100, 5 + key, key) for node in (30, 31) for key in range(12)]
    df = spark.createDataFrame(places, "key long, node long, class long, n long, at int, before int")
    # 15 of 100 are their own: 85 can be common, fewer than the 89 that 0.8 needs
    assert [(r.a, r.b) for r in simhash._met(df, 0.8).select("a", "b").collect()] == [(30, 31)] * 12
    assert [(r.a, r.b) for r in simhash._roomy_pairs(df, 0.8).collect()] == [(30, 31)]


def test_common_shingles(spark, monkeypatch):
    """Shingles in more texts than the bound, with their times; the most frequent ones if there are too many; none of nothing."""
    monkeypatch.setattr(simhash, "ESTIMATE", 1)
    monkeypatch.setattr(simhash, "COMMON_LEAST", 2)
    texts = ["a b c d e f", "a b c d e g", "A b c d e h", "a b c d e f i", "b c d e f", "", "x y"]
    df = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "text binary")
    known = simhash._WordHashes()
    five, six = (simhash.shingle_hashes([t.encode()], 5, known)[1][0] for t in ("a b c d e", "b c d e f"))
    hashes, times = simhash.common_shingles(df, 5)
    assert dict(zip(hashes.tolist(), times.tolist(), strict=True)) == {int(five): 4, int(six): 3} and list(hashes) == sorted(hashes)
    monkeypatch.setattr(simhash, "COMMON_SHINGLES", 1)
    assert simhash.common_shingles(df, 5)[1].tolist() == [4]
    assert [len(x) for x in simhash.common_shingles(df.limit(0), 5)] == [0, 0]


def test_pairs_are_compared_in_rounds(spark):
    """Many pairs of few texts move their sets a round at a time, and all are compared."""
    texts = sorted(set(edited_copies(8)))[::9][:24]
    texts += [t.replace(t.split()[4], "changed", 1) for t in texts[:8]] + ["one two", "ONE two"]
    source, table = sketched(spark, texts)
    compare = simhash._Comparison(source, table, 5, 0.8)
    every = [(a, b) for a in range(len(texts)) for b in range(a)]
    got = {(r.a, r.b) for r in compare(spark.createDataFrame(every, "a long, b long")).collect()}
    sets = [plain_shingles(t) for t in texts]
    assert got == {(a, b) for a, b in every if jaccard(sets[a], sets[b]) >= 0.8} and len(got) > 5
    assert len(compare.used) > 5
    compare.clear()
    assert not compare.used


def test_sieve_loses_no_text(spark, monkeypatch):
    """Named texts all come through and few others, more of them if the bitmaps are too small; none of none."""
    texts = spark.range(20000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id")
    named = texts.filter("id % 10 = 0").withColumnRenamed("id", "node")
    for bitmaps in (simhash.BITMAPS, 1):
        monkeypatch.setattr(simhash, "BITMAPS", bitmaps)
        through = {r.id for r in simhash.sieved(texts, named).collect()}
        assert through >= set(range(0, 20000, 10)) and len(through) < (3000 if bitmaps > 1 else 5000)
    assert simhash.sieved(texts, named.limit(0)).count() == 0


def test_texts_without_candidates_stay(spark):
    """Texts that no pair needs aren't shuffled to find those that are compared."""
    import random

    r = random.Random(11)
    texts = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=40)) for _ in range(400)) for _ in range(300)]
    texts += [t + " more" for t in texts[:4]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    size = docs.selectExpr("sum(length(text))").first()[0]
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = {x.id: x["class"] for x in simhash.similar_documents(docs).collect()}
        most = max(n for k, n in written().items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(set(got.values())) == 300 and all(got[i] == got[300 + i] for i in range(4))
    assert most < 0.3 * size


def test_prefixes_meet():
    """Sets at the threshold share a hash of their prefixes, whichever hashes come last; most sets don't."""
    import numpy as np

    r = np.random.default_rng(3)
    for n in [1, 2, 4, 5, 9, 10, 50, 400]:
        for late in (0, 3, n):
            a = np.unique(r.integers(0, 2**64, n, np.uint64))
            b = np.unique(np.concatenate([a[r.permutation(n)[: n - n // 10]], r.integers(0, 2**64, n // 10, np.uint64)]))
            both = len(np.intersect1d(a, b))
            assert both >= 0.8 * (len(a) + len(b) - both)
            rows, hashes = np.repeat([0, 2], [len(a), len(b)]), np.concatenate([a, b])
            sizes, lists = simhash.prefixes(rows, hashes, 3, 0.8, np.sort(r.permutation(a)[:late]))
            first, none, second = lists.to_pylist()
            assert sizes.tolist() == [len(a), 0, len(b)] and none == [] and set(first) & set(second)
            assert len(first) == n - -(-4 * n // 5) + 1


def test_similar_documents(docs, rows):
    """All awkward rows; texts of one 64-bit fingerprint, or full of one shingle, aren't alike for that."""
    got = simhash.similar_documents(docs).collect()
    assert sum(r.n_rows for r in got) == len(rows) and len(got) == len({(r[0], r[1] or "") for r in rows})
    text_of = {hashlib.sha256((r[1] or "").encode()).digest(): r[1] or "" for r in rows}
    found = {text_of[bytes(r.digest)]: r["class"] for r in got}
    texts = sorted(found)
    sets = {t: plain_shingles(t) for t in texts}
    items = [(i, t) for i, t in enumerate(texts)]
    exact = plain_classes(items, lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert len(set(exact)) <= len(set(found.values())) <= len(set(exact)) + 2
    assert all(len({exact[i] for i, t in items if found[t] == c}) == 1 for c in set(found.values()))


def test_filler_links_nothing(spark):
    rows = [(i, "0 0 0 0 0 0 0 0 0 0 0 0 " * 40 + " ".join(f"{chr(97 + i)}{k}" for k in range(60))) for i in range(6)]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["class"] for r in got}) == 6
    assert len({plain_simhash(t, 5) for _, t in rows}) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 8), (8, 7), (3, 3)] + [(500, i) for i in range(501, 540)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7, 8: 7, 9: 7} | {i: 500 for i in range(500, 540)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("least", [1, 4, 10, 25])
def test_lines(spark, rows, schema, least):
    distinct = [r for r in rows if r[0] is None or r[0] != 5 or r is rows[5]]
    docs = spark.createDataFrame(distinct, schema).repartition(3)
    got = line_dedup.line_dedup(docs, least).select("doc_id", F.coalesce("text", F.lit("")), "n_deleted").collect()
    left = plain_line_dedup(distinct, least)
    wanted = [(r[0], left[i]) for i, r in enumerate(distinct)]
    assert sorted_rows((r[0], r[1]) for r in got) == sorted_rows(wanted)


def run_documents(seed):
    """Documents of few different lines, so that runs overlap, with long shared runs and whole copies."""
    import random

    r = random.Random(seed)
    vocabulary = [" ".join(f"{chr(97 + k)}{j}" for j in range(r.randint(1, 6))) for k in range(12)]
    long = [f"long line {k} of the shared run" for k in range(50)]
    texts = ["\n".join(r.choice(vocabulary) for _ in range(r.randint(1, 25))) for _ in range(25)]
    texts += ["\n".join([f"own {i}", *long[r.randint(0, 3) : r.randint(40, 50)], r.choice(vocabulary)]) for i in range(8)]
    texts += [texts[3], texts[27], texts[27], "\n".join(long), "\n\n".join(long)]
    return list(enumerate(texts))


def plain_runs(docs, least):
    """Maximal runs by trying every earlier place; whole copies apart."""
    import itertools

    copies, originals, first = [], [], {}
    for doc_id, text in docs:
        lines = [x for x in text.split("\n") if x.split()]
        if text in first:
            copies.append((doc_id, 0, len(lines), sum(len(x.split()) for x in lines), first[text], 0))
        else:
            first[text] = doc_id
            originals.append((doc_id, lines))
    lines_of = dict(originals)
    places = [(d, i) for d, own in originals for i in range(len(own))]

    def common(a, b):
        x, y = lines_of[a[0]][a[1] :], lines_of[b[0]][b[1] :]
        return sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(x, y, strict=False)))

    by_line = {}
    for p in places:
        by_line.setdefault(lines_of[p[0]][p[1]], []).append(p)
    partner = {}
    for p in places:
        shared = [(common(p, q), q) for q in by_line[lines_of[p[0]][p[1]]] if q < p]
        if shared:
            top = max(n for n, _ in shared).bit_length() - 1
            n, q = next((n, q) for n, q in sorted(shared, key=lambda x: x[1]) if n >= 1 << top)
            partner[p] = (q, n)
    out = []
    for (d, i), (q, n) in partner.items():
        before = partner.get((d, i - 1))
        words = sum(len(x.split()) for x in lines_of[d][i : i + n])
        if (before is None or before[0] != (q[0], q[1] - 1)) and words >= least:
            out.append((d, i, n, words, *q))
    return out + [c for c in copies if c[3] >= least]


@pytest.mark.parametrize(("seed", "least"), [(1, 1), (2, 10), (3, 20)])
def test_maximal_runs(spark, seed, least):
    docs = run_documents(seed)
    got = line_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), least).collect()
    wanted = plain_runs(docs, least)
    assert sorted_rows(got) == sorted_rows(wanted)
    assert max(r.n_lines for r in got) >= 40
    left = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), least).collect()
    plain = plain_line_dedup([(d, t) for d, t in docs], least)
    assert {r.doc_id: r.text for r in left} == {d: plain[k] for k, (d, _) in enumerate(docs)}


def test_runs_of_a_hot_line(spark, monkeypatch):
    """Common classes are broadcast and the rest shuffled; both give the same."""
    docs = run_documents(4) + [(1000 + i, f"hot line of ten words or so that all have {'x ' * 5}\nown {i}") for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    plain = {d: plain_line_dedup(docs, 10)[k] for k, (d, _) in enumerate(docs)}
    for share in (1, 10, 10**9):
        monkeypatch.setattr(line_dedup, "counted_join", lambda large, classes, on, share=share: joins.counted_join(large, classes, on, share))
        assert {r.doc_id: r.text for r in line_dedup.line_dedup(table).collect()} == plain


def test_plans_stay_small(spark, monkeypatch):
    """However many rounds a long run takes, no plan has the joins of more than a few, as the driver holds plans whole."""
    joins, plain = [], line_dedup.materialize

    def counted(df, name):
        joins.append(df._jdf.queryExecution().analyzed().toString().count("Join "))
        return plain(df, name)

    monkeypatch.setattr(line_dedup, "materialize", counted)
    text = "\n".join(f"line {i} of a passage" for i in range(300))
    docs = spark.createDataFrame([(1, text), (2, "before\n" + text), (3, text + "\nafter")], "doc_id long, text string")
    levels, later = line_dedup._array(docs, "doc_id", "text")[1:]
    assert len(levels) > 8
    joins.clear()
    assert sorted(r.n_lines for r in line_dedup._runs(levels, later, 0).collect()) == [300, 300]
    assert max(joins) <= 2


def test_lines_columns(docs, rows, none):
    got = line_dedup.line_dedup(docs)
    assert set(got.columns) == {*docs.columns, "n_deleted"} and got.count() == len(rows)
    assert got.filter("text IS NULL").count() == 2 and got.filter("doc_id = 5").count() == 2
    assert line_dedup.line_dedup(none).count() == line_dedup.repeated_runs(none).count() == 0
    clash = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in ("__lines", "__key", "__gone", "text_", "rest", "all", "left", "whole", "first", "total")])
    again = line_dedup.line_dedup(clash)
    assert set(again.columns) == {*clash.columns, "n_deleted"} and {tuple(r) for r in again.select("__lines", "__key", "__gone", "rest", "whole").collect()} == {("own __lines", "own __key", "own __gone", "own rest", "own whole")}


def test_long_passage_across_documents(spark):
    """A passage of several lines stays once; the lines around it stay everywhere."""
    passage = "\n".join(f"line {k} " + " ".join(f"w{k}{j}" for j in range(14)) for k in range(4)) + "\nend"
    rows = [(i, f"own start {i}\n{passage}\nown finish {i}", "en", "s", 1) for i in range(30)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own start {i}\nown finish {i}" for i in range(1, 30))


