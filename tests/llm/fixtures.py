"""Documents with every awkward case, and brute-force versions of the operators."""

import collections
import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_documents(seed=1, n=120):
    """Rows of ``documents`` with nulls, blanks, long texts, copies, near copies and repeated rows."""
    r = random.Random(seed)
    vocabulary = {lang: ["".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(400)] for lang, letters in (("en", "etaoinshr"), ("de", "enirstaüö"), ("fr", "esaitnéèu"))}
    line = lambda lang, k: " ".join(r.choice(vocabulary[lang]) for _ in range(k))
    shared = [line("en", 12) for _ in range(5)]
    rows = []
    for i in range(n):
        lang = r.choice(["en", "de", "fr"])
        lines = [line(lang, r.randint(1, 30)) for _ in range(r.randint(1, 8))]
        if r.random() < 0.4:
            at = r.randrange(3)
            lines[r.randint(0, len(lines)) :] = shared[at : at + r.randint(1, 3)]
        rows.append((i, "\n".join(lines), lang if r.random() < 0.9 else None, r.choice(["s1", "s2", "s3", None])))
    for i in range(n, n + 40):
        _, text, lang, source = rows[r.randrange(n)]
        words = text.split(" ")
        if i % 2 and len(words) > 40:
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), lang, source))
    rows += [
        (900, None, None, None), (901, "", "en", "s1"), (902, " \t\n ", "en", "s1"), (903, "12 34 !!", "en", "s2"), (904, "x", "en", "s2"), (905, "\n\nhello\x0bworld\n\nhello\x0bworld\n", "en", "s2"),
        (906, line("en", 30_000), "en", "hot"), (907, "\n".join([line("de", 3)] * 2_000), "de", "hot"), (908, "z" * 50_000, None, "hot"), (909, "tab\tand  double  spaces\r\n\x1cunit\xa0nbsp <|endoftext|> 中文", "en", "s1"),
        (5, rows[5][1], "en", "s1"), (None, rows[6][1], "en", "s1"), (None, None, "de", None),
    ]
    return [(*x, None if x[1] is None else len(x[1])) for x in rows]


def frame(spark, rows, extra=True):
    """The rows as a table, with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    clash = ["id", "key", "size", "hash", "ids", "piece", "length", "n_words", "rank", "digest", "n_lines", "score", "file", "start", "n", "words", "lines"]
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in clash]) if extra else df


def plain_measures(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def plain_line_dedup(rows, least):
    """{index of row: remaining text} by trying every window of lines."""
    docs = {}
    for at, (doc_id, text, *_) in enumerate(rows):
        lines = (text or "").split("\n")
        docs[at] = ((doc_id is not None, doc_id or 0, text or ""), lines, [(x, k, len(WORD.findall(x))) for k, x in enumerate(lines) if WORD.search(x)])

    def windows(found):
        for a in range(len(found)):
            words = 0
            for b in range(a, min(len(found), a + least)):
                words += found[b][2]
                if words >= least:
                    yield a, b, tuple(x[0] for x in found[a : b + 1])
                    # longer windows are unions of such, but for the one that ends a run
                    if words - found[a][2] >= least:
                        break

    first = {}
    for key, _, found in docs.values():
        for a, _, run in windows(found):
            # order of documents that share an id is the operator's own, so only ids and lines decide here
            first[run] = min(first.get(run, (key[:2], a)), (key[:2], a))
    out = {}
    for at, (key, lines, found) in docs.items():
        gone = set()
        for a, b, run in windows(found):
            if first[run] != (key[:2], a):
                gone |= {x[1] for x in found[a : b + 1]}
        out[at] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def plain_profile(text):
    """A text's vector by the definition: bound and bundled n-grams of letters, other runs one blank."""
    import numpy as np

    from quire.llm import langid

    letters, last = [0], 0
    for c in (text or "").lower() + " ":
        point = ord(c) if c.isalpha() else 0
        if point or last:
            letters.append(point)
        last = point
    grams = collections.Counter(zip(*[letters[k:] for k in range(langid.NGRAM)], strict=False))
    out = np.zeros(langid.DIMENSIONS, np.int64)
    for gram, n in grams.items():
        vector = np.ones(langid.DIMENSIONS, np.int64)
        for k, point in enumerate(gram):
            vector *= np.roll(langid._letter_vector(point), k)
        out += n * vector
    return out


def plain_languages(learned, texts):
    """(language, score) of each text from profiles of (text, language) pairs."""
    import numpy as np

    prototypes = {}
    for text, lang in learned:
        if text is not None and lang is not None:
            prototypes[lang] = prototypes.get(lang, 0) + plain_profile(text)
    out = []
    for text in texts:
        own = plain_profile(text)
        if not prototypes or not any(c.isalpha() for c in (text or "").lower()):
            out.append(("und", 0.0))
            continue
        cosine = {lang: own @ p / max(np.linalg.norm(own.astype(float)) * np.linalg.norm(p.astype(float)), 1e-12) for lang, p in prototypes.items()}
        best = min(cosine, key=lambda lang: (-cosine[lang], lang))
        out.append((best, min(1.0, max(0.0, float(cosine[best])))))
    return out


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1
