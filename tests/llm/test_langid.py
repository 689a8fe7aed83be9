import random
import zlib

import numpy as np

from gleanery.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, i int"
SYLLABLES = {"xa": ["the", "ing", "er", "and", "wh"], "xb": ["éau", "ent", "oi", "le", "ç"], "xc": ["sch", "ung", "ü", "en", "ß"]}


def documents(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(words), lang, "x", 1))
    return rows


def test_held_out_accuracy(spark):
    rows = documents(300, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.predict_language(docs, langid.learn_prototypes(docs)).collect()}
    held = [got[r[0]].lang_pred == r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 40 and np.mean(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_bundle_is_the_sum_of_gram_vectors():
    text = "Ab, äb 12 c"
    padded = [0, *map(ord, "ab"), 0, *map(ord, "äb"), 0, ord("c"), 0]
    expected = sum(langid.gram_vector(*padded[i : i + 3]).astype(int) for i in range(len(padded) - 2))
    got = langid.Encoder().bundle(["", text, "1 2"])
    assert (got[1] == expected).all() and not got[0].any() and not got[2].any()


def test_odd_rows(spark):
    rows = [(1, None, "xa", None, None), (2, "", None, None, None), (3, "12 !?", "xb", None, None), (None, "the thing", "xa", None, None), (5, "theing " * 30000, "xa", None, None), (5, "theing " * 30000, "xa", None, None), (6, "schung enü", "xc", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.learn_prototypes(docs, folds=1000, held_out=999)
    assert set(model) == {"xa", "xc"}
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in langid.predict_language(docs, model).collect()))
    assert got == [(0, "xa"), (1, "und"), (2, "und"), (3, "und"), (5, "xa"), (5, "xa"), (6, "xc")]
    assert {r.lang_pred for r in langid.predict_language(docs, {}).collect()} == {"und"}
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.learn_prototypes(empty) == {} and langid.predict_language(empty, {}).count() == 0


def test_against_brute_force(spark):
    """Learning and prediction written out with loops over letters, on rows that share ids and languages."""
    rows = documents(60, 3) + [(7, "the ing", "xa", None, None), (900, "une étoile", None, None, None), (901, None, "xb", None, None)]

    def vector(text):
        out, last = np.zeros(langid.DIMENSIONS), [0]
        for c in (text or "").lower() + " ":
            code = ord(c) if c.isalpha() else 0
            if code or last[-1]:
                last.append(code)
        for a, b, c in zip(last, last[1:], last[2:]):
            bound = [langid.letter_vector(a)[(k - 2) % langid.DIMENSIONS] * langid.letter_vector(b)[k - 1] * langid.letter_vector(c)[k] for k in range(langid.DIMENSIONS)]
            out += bound
        return out

    unit = lambda v: v / np.linalg.norm(v) if v.any() else v
    vectors = [vector(r[1]) for r in rows]
    sums = {}
    for r, v in zip(rows, vectors):
        if r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2:
            sums[r[2]] = sums.get(r[2], 0) + unit(v)
    expected = []
    for r, v in zip(rows, vectors):
        best = max(sorted(sums), key=lambda name: unit(v) @ unit(sums[name])) if v.any() else "und"
        expected.append((r[0], best, (1 + unit(v) @ unit(sums[best])) / 2 if v.any() else 0.0))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict_language(docs, langid.learn_prototypes(docs)).collect())
    assert [g[:2] for g in got] == [e[:2] for e in sorted(expected)]
    assert np.allclose([g[2] for g in got], [e[2] for e in sorted(expected)], atol=1e-4)
