import random

import numpy as np
import pytest

import corpus_pipeline
from gleanery.llm import pii, quality, setjoin, simhash
from tests.llm import test_decontaminate, test_setjoin, test_simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    letters = "abcdefghijklmnop"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(25))) for k in range(6)]
    rows, labels = [], []
    for i in range(240):
        words = text(rng.randrange(60, 200))
        good = True
        if i % 6 == 1:
            words, good = [w.upper() + "!!" for w in words], False
        elif i % 6 == 2 and i > 10:
            words = rows[rng.randrange(len(rows))][1].split()
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif i % 12 == 3:
            words[10:10] = items[rng.randrange(6)][1].split()
        elif i % 12 == 4:
            words[5:5] = ["mail", f"{words[0]}@example.org", "or", "4242424242424242."]
        rows.append((i, " ".join(words), "en", rng.choice(["a", "a", "a", "b", "c"]), 0))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    for name, data, schema in (
        ("documents", rows, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return path, rows, items


def brute(spark, path, rows, items):
    model = quality.fit_quality(spark.createDataFrame(rows, DOCS), spark.read.parquet(f"{path}/labels.parquet"))
    x = np.array([quality.measures((r[1] or "").encode()) for r in rows])
    rows = [r for r, s in zip(rows, model.score(x)) if s >= 0.3]
    grams = [simhash.shingles((r[1] or "").encode()) for r in rows]
    prints = [simhash.fingerprint(g) for g in grams]
    sets = [set(setjoin.shingle_set((r[1] or "").encode()).tolist()) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if grams[i] and grams[j] and (bin(prints[i] ^ prints[j]).count("1") <= 2 or test_setjoin.similar(sets[i], sets[j], setjoin.JACCARD)):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    rows = [r for k, r in enumerate(rows) if group[k] == k]
    leaks = {i for i, _ in test_decontaminate.brute([(r[0], r[1]) for r in rows], items)}
    rows = [r for r in rows if r[0] not in leaks]
    rows = [(r[0], r[1] and pii.pseudonymise(r[1], pii.session_key(spark))[0], *r[2:]) for r in rows]
    return rows


def test_run_against_brute_force(spark, folder):
    path, rows, items = folder
    got = corpus_pipeline.run(spark, path).collect()
    expected = brute(spark, path, rows, items)
    texts = {r[0]: r[1] for r in expected}
    assert 100 < len(texts) < 200
    assert {r.doc_id: r.text for r in got}.items() <= texts.items()
    # what is taken is within half a document of each source's target
    for source in "abc":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine) / 2
        assert mine[0].source_size == sum(len((r[1] or "").split()) for r in expected if r[3] == source)
    assert all(r.taken == r.copies * r["size"] and 1 <= r.copies <= 3 for r in got)


def test_stages_keep_the_columns(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), path).count() == 0
    assert corpus_pipeline.mix(spark, docs.limit(0), path).count() == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_near_duplicates_do_not_broadcast_keys(spark, folder, monkeypatch):
    """There are some forty keys a fingerprint, and the driver would hold those of all documents."""
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    found = test_simhash.plans(monkeypatch, lambda: corpus_pipeline.near_duplicates(spark, docs, path))
    assert "MapInArrow" in found["links"]
    assert not any(map(test_simhash.broadcast_python, found.values()))
