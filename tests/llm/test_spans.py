import random
import re
import time
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import queries_spans, spans
from gleanery.storage import shared_dir

SCHEMA = "doc_id long, text string, x string, places int, h int"


def split(text):
    """Sentences with what stands behind them, one character after the other."""
    out, last = [], 0
    for m in re.finditer(r"(?<=[.!?])[ \t\n\r\f\v]+|(?<=[。！？।])[ \t\n\r\f\v]*|[ \t\r\f\v]*\n[ \t\n\r\f\v]*", text):
        if m.end() > last:
            out.append(text[last : m.end()])
            last = m.end()
    out += [text[last:]] * (last < len(text))
    return [q for p in out for q in (re.split(r"(?<=[,;:] )(?! )", p) if len(p.split()) >= 30 else [p]) if q]


def brute(spark, rows, least):
    """From all runs of all texts, kept whole in order of id, Spark's hash of the text, and place."""
    frame = spark.createDataFrame([(r[1],) for r in rows], "t string").selectExpr("t", "coalesce(xxhash64(t), 0) x")
    hashes = {r.t: r.x for r in frame.collect()}
    seen, result = set(), {}
    for none, i, _, text in sorted({(r[0] is None, r[0] or 0, hashes[r[1]], r[1]) for r in rows if r[1]}, key=lambda d: d[:3]):
        parts = split(text)
        full = [k for k, p in enumerate(parts) if p.strip()]
        found = [parts[k].strip() for k in full]
        words = [max(len(s.split()), len(s.encode()) // 12) for s in found]
        gone = set()
        for a in range(len(found)):
            for b in range(a + 2, len(found) + 1):
                if sum(words[a:b]) >= least:
                    if tuple(found[a:b]) in seen:
                        gone.update(full[a:b])
                    seen.add(tuple(found[a:b]))
        result[none, i, text] = "".join(p for k, p in enumerate(parts) if k not in gone), len(found), len(gone)
    out = [(r[0], *(result[r[0] is None, r[0] or 0, r[1]] if r[1] else (r[1], 0, 0))) for r in rows]
    return sorted(out, key=str)


def check(spark, rows, least=0):
    got = spans.drop_repeated_runs(spark.createDataFrame(rows, SCHEMA), least_words=least).collect()
    assert sorted(((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in got), key=str) == brute(spark, rows, least)
    return got


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(8)
    word = lambda: "w" + str(rng.randrange(400))
    sentence = lambda: ", ".join(" ".join(word() for _ in range(rng.choice([1, 3, 6, 9]))) for _ in range(rng.choice([1, 1, 1, 6]))) + rng.choice(".!?")
    passage = lambda: rng.choice([" ", "\n", "\n\n "]).join(sentence() for _ in range(rng.randrange(2, 8)))
    shared = [passage() for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [passage() for _ in range(rng.randrange(4))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        rows.append((i * 7 % 1000, "\n".join(parts), "x", 1, 1))
    return rows


@pytest.mark.parametrize("least", [0, 16])
def test_against_brute_force(spark, passages, least):
    assert sum(r.n_removed > 0 for r in check(spark, passages, least)) > 40


def test_sql_gives_the_same(spark, passages, tmp_path):
    spark.createDataFrame(passages, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries_spans.op2_substring_dedup(spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        expected = db.execute(queries_spans.ORACLES["op2_substring_dedup"]).fetchall()
    assert sorted((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in got) == sorted(expected)


def test_two_short_sentences_are_a_run(spark):
    rows = [(1, "Alpha. Beta. Gamma.", None, None, None), (2, "Delta. Beta. Gamma.", None, None, None), (3, "Beta. Delta.", None, None, None)]
    got = {r.doc_id: r.text for r in check(spark, rows)}
    assert got == {1: "Alpha. Beta. Gamma.", 2: "Delta. ", 3: "Beta. Delta."}
    assert all(r.n_removed == 0 for r in check(spark, rows, least=16))


def test_odd_rows(spark):
    a = "one two three four five six seven eight nine. ten eleven twelve thirteen fourteen fifteen sixteen. end of it"
    rows = [(5, a, None, None, None), (5, a, "again", 1, 1), (None, a, None, None, None), (None, a + "!", None, None, None), (1, None, None, None, None)]
    rows += [(2, "", None, None, None), (3, " \n ", None, None, None), (6, a + "\n" + a, None, None, None), (7, "x. " * 40_000, None, None, None), (8, "\n" + a, None, None, None)]
    rows += [(9, "今日は晴れです。明日は雨でしょう。それでは。", None, None, None), (10, "はい。今日は晴れです。明日は雨でしょう。", None, None, None)]
    small = [r for r in rows if r[0] != 7]
    got = check(spark, small)
    assert [r.text for r in got if r.doc_id == 10] == ["はい。"] and [r.text for r in got if r.doc_id == 5] == [a, a]
    long = [r for r in spans.drop_repeated_runs(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id == 7]
    assert [(r.n_sentences, r.text) for r in long] == [(40_000, "x. ")]  # the run that begins with the second sentence repeats the first


def test_bytes_that_are_no_utf8_stay(spark):
    rows = spark.sql("select 1L doc_id, cast(unhex('FF2E20612E20622E') as string) text union all select 2L, cast(unhex('612E20622EFE') as string)")
    got = spans.drop_repeated_runs(rows).selectExpr("doc_id", "hex(text) h").collect()
    assert {r.doc_id: r.h for r in got} == {1: "FF2E20612E20622E", 2: "612E20622EFE"}


def test_empty_table(spark):
    assert spans.drop_repeated_runs(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "n_sentences", "n_removed"]
    assert spans.drop_repeated_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def written(spark):
    """Bytes of all shuffles so far and of the shared folder's tables."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    tables = Path(shared_dir(spark).removeprefix("file://")).rglob("*.parquet")
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size())) + sum(p.stat().st_size for p in tables)


def test_a_run_is_written_once(spark):
    """16 of its bytes are a hash, that of the text has 8, and id and place have few."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.randrange(10**6)} and some more." for _ in range(60)), "x", 1, 1) for i in range(2_000)]
    n = sum(len(spans.runs([spans.words_in(p) for p in spans.pieces(r[1].encode())], 16)) for r in rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    before = written(spark)
    assert n > 100_000 and spans.repeated_runs(docs, least_words=16).collect() == []
    time.sleep(1)  # for the last stage's figures
    assert written(spark) - before < 40 * n


@pytest.mark.parametrize("kind", ["string", "decimal(20,0)", "double", "int"])
def test_the_first_id_keeps_a_passage(spark, kind):
    """In the order of Spark, where the copies are of one batch and where they are not."""
    rows = [(i, f"{i} alone. Alpha beta gamma. Delta epsilon. Alpha beta gamma. Delta epsilon.", None, None, None) for i in [100, 9, 20, None, 3, 3, 1000]]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
    for parts in (1, 5):
        got = spans.drop_repeated_runs(docs.repartition(parts)).selectExpr("cast(cast(doc_id as int) as string) i", "text").collect()
        first = "100" if kind == "string" else "3"
        assert len(got) == 7
        for r in got:
            assert r.text == f"{r.i or 'None'} alone. " + ("Alpha beta gamma. Delta epsilon. " if r.i == first else "")


@pytest.mark.parametrize("ordered", [True, False])
def test_runs_that_repeat_one_of_their_batch(ordered):
    rng = np.random.default_rng(5)
    ids, hashes = [4, None, 2, 2, 7, None, 2], np.array([1, 5, 9, 9, -3, 2, -8])
    docs = np.sort(rng.integers(0, 7, 200))
    starts = rng.integers(0, 40, 200)
    digests = rng.integers(0, 6, (200, 2))
    place = lambda k: (ids[docs[k]] is None, ids[docs[k]] or 0, hashes[docs[k]], starts[k])
    near = lambda k, j: (digests[k] == digests[j]).all() and (ordered or docs[k] == docs[j])
    expected = [any(near(k, j) and place(j) < place(k) for j in range(200)) for k in range(200)]
    assert spans._again(pa.array(ids) if ordered else None, hashes, docs, starts, digests).tolist() == expected and 20 < sum(expected) < 180
