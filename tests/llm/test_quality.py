import random
import zlib

import numpy as np

from gleanery.llm import gam, quality

SCHEMA = "doc_id long, text string, score string, y int"


def documents(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 200))]
        good = i % 3 > 0
        kind = rng.randrange(3)
        if not good:
            words = [[w + "###", w.upper() + "!!", words[0]][kind] for w in words]
        rows.append((i, " ".join(words) + ".", "x", 1))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = documents(600, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    held = [(scores[i] >= 0.3) == bool(q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean(held) > 0.97


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x, y)
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    got = model.score(x)
    for k in range(50):
        total = model.bias
        for i in range(4):
            total += model.tables[i][sum(e <= x[k, i] for e in model.edges[i])]
        for i, j, table in model.pairs:
            total += table[sum(e <= x[k, i] for e in model.pair_edges[i]), sum(e <= x[k, j] for e in model.pair_edges[j])]
        assert abs(got[k] - 1 / (1 + np.exp(-total))) < 1e-12
    assert np.mean((got > 0.5) == (y > 0.5)) > 0.9


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, "", "x", 1), (1, " \n ", "x", 1), (2, "word " * 40000, None, None), (2, "word " * 40000, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(docs, none)
    assert [r.score for r in quality.score_quality(docs, model).collect()] == [0.5] * 5
    model = quality.fit_quality(docs, spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 1)], "doc_id long, quality int"))
    got = quality.score_quality(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_quality(docs, model, 0.0)
    assert kept.count() == 5 and kept.columns == docs.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.score_quality(empty, quality.fit_quality(empty, none)).count() == 0


def test_blank_text_has_no_measures():
    assert quality.measures(b" \t") == [0.0] * len(quality.FEATURES)
    assert len(quality.measures("Ein Wort ß".encode())) == len(quality.FEATURES)


def test_against_brute_force(spark):
    """The rows learnt from, chosen by hand, and every score as a sum over the tables that they give."""
    rows, labels = documents(300, 4)
    labels += [(5, 0, 0), (5, 0, 0), (None, 1, 0), (8, None, 0), (9999, 1, 0)]
    votes = {}
    for i, q, _ in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5:
            votes.setdefault(i, []).append(q)
    texts = dict((r[0], r[1]) for r in rows)
    chosen = sorted((i, quality.measures(texts[i].encode()), float(np.mean(v) >= 0.5)) for i, v in votes.items() if i in texts)
    model = gam.fit(np.array([x for _, x, _ in chosen]), np.array([y for *_, y in chosen]))
    docs = spark.createDataFrame(rows, SCHEMA)
    fitted = quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in quality.score_quality(docs, fitted).collect()}
    for i, text in texts.items():
        x = quality.measures(text.encode())
        total = model.bias + sum(t[sum(e <= x[k] for e in edges)] for k, (edges, t) in enumerate(zip(model.edges, model.tables)))
        total += sum(t[sum(e <= x[a] for e in model.pair_edges[a]), sum(e <= x[b] for e in model.pair_edges[b])] for a, b, t in model.pairs)
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) < 1e-9
