import math

import pytest
from pyspark.sql import functions as F

from gleanery import cli, engine
from gleanery.functions import scoring
from gleanery.operators import boolean, evaluation, index, numbering, search, vectors
from gleanery.streaming import segments

TOY = list(enumerate(["cat", "dog", "mouse", "cat dog", "dog mouse", "cat mouse", "cat mouse cat"]))


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY, "doc_id long, text string")


@pytest.fixture(scope="module")
def memory(spark, toy):
    made = engine.LexicalEngine.create_in_memory(spark)
    made.index_docs(toy)
    return made


@pytest.mark.parametrize(
    ("query", "limit", "ids"), [("cat", 10, [0, 6, 3, 5]), ("cat", 2, [0, 6]), ("cat mouse", 10, [6, 5, 0, 2, 3, 4]), ("unknown", 10, []), ("Cat! the", 2, [0, 6])]
)
def test_toy_rankings(memory, toy, spark, query, limit, ids):
    assert memory.search(query, limit) == ids
    one = spark.createDataFrame([(1, query)], "query_id int, text string")
    direct = search.search_documents(toy, one, limit).orderBy("rank").collect()
    assert [r.doc_id for r in direct] == ids


def test_search_before_indexing(spark):
    with pytest.raises(engine.NotIndexedError):
        engine.LexicalEngine.create_in_memory(spark).search("cat")


def test_repeated_words_count_repeatedly(spark, toy):
    asked = spark.createDataFrame([(1, "cat"), (2, "cat cat")], "query_id int, text string")
    scores = {(r.query_id, r.doc_id): r.score for r in search.search_documents(toy, asked).collect()}
    assert all(abs(scores[2, d] - 2 * scores[1, d]) < 2e-6 for d in (0, 3, 5, 6))


def test_statistics_and_segments(toy):
    whole = index.build_index(toy).stats.collect()
    assert [tuple(r) for r in whole] == [(0, 7, 4, 12 / 7)]
    parts = index.build_index(toy, 4)
    assert sorted(tuple(r) for r in parts.stats.collect()) == [(0, 4, 2, 5 / 4), (1, 3, 3, 7 / 3)]
    assert sorted(tuple(r) for r in parts.docs.select("segment_id", "seg_doc_id", "doc_id").collect()) == [(i // 4, i % 4, i) for i in range(7)]
    cats = index.build_index(toy).postings_for("cat").orderBy("seg_doc_id")
    assert [(r.seg_doc_id, r.tf) for r in cats.collect()] == [(0, 1), (3, 1), (5, 1), (6, 2)]
    with pytest.raises(ValueError):
        index.segmented(toy, 0)


def test_disk_index(spark, toy, tmp_path):
    path = str(tmp_path / "index_bm25")
    made = engine.LexicalEngine.create_on_disk(spark, path, max_segment_docs=4)
    made.index_docs(toy)
    opened = engine.LexicalEngine.open_from_disk(spark, path)
    assert opened.search("cat mouse") == [6, 5, 0, 2, 3, 4]
    plan = opened.index.postings_for("cat")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,cat)]" in plan
    made.index_docs(spark.createDataFrame([(100, "cat")], "doc_id long, text string"))
    assert engine.LexicalEngine.open_from_disk(spark, path).search("cat", 2) == [0, 100]
    assert sorted(r.segment_id for r in made.index.stats.collect()) == [0, 1, 2]
    assert engine.directory_size(spark, path) > 1000
    again = engine.LexicalEngine.create_on_disk(spark, path)
    again.index_docs(toy.limit(1))
    assert again.index.docs.count() == 1


def test_zero_term_and_repeated_documents(spark):
    docs = spark.createDataFrame([(1, "12 !"), (2, None), (3, "cat"), (3, "cat")], "doc_id long, text string")
    made = index.build_index(docs)
    assert [tuple(r) for r in made.stats.collect()] == [(0, 4, 2, 0.5)]
    asked = spark.createDataFrame([(1, "cat")], "query_id int, text string")
    assert [r.doc_id for r in search.search_index(made, asked).collect()] == [3, 3]
    assert index.build_index(docs.limit(0)).stats.count() == 0


def test_scores(spark):
    row = spark.range(1).select(
        scoring.tfidf(*map(F.lit, (2, 100, 5, 1000))).alias("t"), scoring.bm25(*map(F.lit, (2, 100, 5, 1000)), F.lit(150.0)).alias("b")
    )
    found = row.first()
    assert math.isclose(found.t, 0.10596634733096073, rel_tol=1e-15) and math.isclose(found.b, 7.895734283840656, rel_tol=1e-15)


def test_segment_statistics(spark, toy):
    asked = spark.createDataFrame([(1, "cat")], "query_id int, text string")
    one, parts = index.build_index(toy), index.build_index(toy, 4)
    same = [search.search_index(i, asked).orderBy("rank").collect() for i in (one, parts)]
    assert same[0] == same[1]
    assert search.search_index(one, asked, stats="segment").orderBy("rank").collect() == same[0]
    assert search.search_index(parts, asked, stats="segment").orderBy("rank").collect() != same[0]
    with pytest.raises(ValueError):
        search.search_index(one, asked, stats="other")


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("cat", {0, 3, 5, 6}), ("cat AND mouse", {5, 6}), ("cat OR dog", {0, 1, 3, 4, 5, 6}), ("cat AND NOT mouse", {0, 3}), ("cat AND NOT mouse AND NOT dog", {0}),
        ("(cat AND mouse) OR dog", {1, 3, 4, 5, 6}), ("unknown", set()), ("cat AND unknown", set()), ("cat cat", {0, 3, 5, 6}),
    ],
)
def test_boolean_matches(toy, query, ids):
    found = boolean.boolean_search(toy, query)
    assert {r.doc_id for r in found.collect()} == ids
    assert boolean.collect_count(boolean.boolean_search(toy, query, scored=False)).first().matches == len(ids)


def test_boolean_scores(toy):
    score = lambda q: {r.doc_id: r.score for r in boolean.boolean_search(toy, q).collect()}
    cat, dog, mouse = map(score, ("cat", "dog", "mouse"))
    assert abs(score("cat AND mouse")[5] - cat[5] - mouse[5]) < 2e-6
    assert score("cat AND NOT mouse")[3] == cat[3]
    assert score("(cat AND mouse) OR dog")[3] == dog[3]  # the unmatched part adds nothing
    assert abs(score("cat cat")[0] - 2 * cat[0]) < 2e-6


@pytest.mark.parametrize(("limit", "ids"), [(0, []), (1, [0]), (3, [0, 6, 3]), (99, [0, 6, 3, 5])])
def test_top(toy, limit, ids):
    assert [r.doc_id for r in boolean.collect_top(boolean.boolean_search(toy, "cat"), limit).collect()] == ids


def test_numbers_follow_the_key(spark):
    for values in ([], [5], [9, 3, 7, 3, None, 1 << 62], list(range(500, 0, -1))):
        df = spark.createDataFrame([(v,) for v in values], "k long")
        rows = numbering.with_row_number(df, "k").orderBy("row").collect()
        assert [r.row for r in rows] == list(range(len(values)))
        assert [r.k for r in rows] == sorted(values, key=lambda v: (v is not None, v or 0))


# ---------------------------------------------------------------- evaluation
def quality(spark, found, qrels, queries=(1,), limit=10, **options):
    f = spark.createDataFrame([(q, n + 1, d) for q, ids in found.items() for n, d in enumerate(ids)], "query_id int, rank int, doc_id int")
    r = spark.createDataFrame([(q, d, v) for q, rel in qrels.items() for d, v in rel.items()], "query_id int, doc_id int, relevance double")
    return evaluation.query_quality(f, r, spark.createDataFrame([(q,) for q in queries], "query_id int"), limit, **options)


def test_metrics(spark):
    row = quality(spark, {1: [1, 2, 3]}, {1: {2: 0.5, 3: 0.8, 4: 0.9, 5: 1.0}}, limit=3).first()
    assert abs(row.ndcg - 0.33) < 0.0033 and (row.hits, row.precision, row.recall) == (2, 2 / 3, 0.5)
    raw = quality(spark, {1: [1, 2, 3, 4, 5, 6]}, {1: dict(zip(range(1, 9), [3.0, 2.0, 3.0, 0.0, 1.0, 2.0, 3.0, 2.0]))}, limit=6, scheme="jarvelin").first()
    assert abs(raw.ndcg - 0.785) < 0.00785
    edge = {r.query_id: r for r in quality(spark, {1: [1], 3: [7]}, {3: {7: 0.5}, 4: {9: 1.0}}, (1, 2, 3, 4)).collect()}
    assert [(edge[q].precision, edge[q].recall, edge[q].ndcg) for q in (1, 2, 3, 4)] == [(0, 1, 0), (1, 1, 1), (1, 1, 1), (0, 0, 0)]
    for wrong in ({"limit": 0}, {"limit": 10}):
        with pytest.raises(Exception, match="ideal gain is zero"):
            quality(spark, {1: [1]}, {1: {1: 1.0 if wrong["limit"] == 0 else 0.0}}, **wrong).collect()
    with pytest.raises(ValueError):
        evaluation.gain(F.lit(1.0), "other")


def test_summary(spark):
    got = evaluation.summary(quality(spark, {1: [1], 2: [5]}, {1: {1: 1.0}, 2: {6: 1.0}}, (1, 2))).first()
    assert (got.queries, got.precision_avg, got.precision_p50, got.precision_p90, got.precision_p100) == (2, 0.5, 0.5, 0.9, 1.0)
    with pytest.raises(Exception, match="there are no queries"):
        evaluation.summary(quality(spark, {}, {}, ())).collect()


@pytest.mark.parametrize(
    ("a", "b", "value"), [([], [], 1), ([1], [], 0), ([1], [2], 0), ([1, 2, 3, 4], [2, 1, 3, 4], 0.75), ([1, 2, 3, 4], [1, 3, 2, 4], 0.875), ([1, 2, 3, 4], [1, 2, 4, 3], 0.9166666666666666)]
)
def test_ranked_overlap(spark, a, b, value):
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    assert abs(df.select(evaluation.ranked_overlap(F.col("a"), F.col("b"))).first()[0] - value) < 1e-12


def test_ranked_overlap_repeats(spark):
    df = spark.createDataFrame([([1, 1], [1, 2])], "a array<int>, b array<int>")
    with pytest.raises(Exception, match="must not repeat"):
        df.select(evaluation.ranked_overlap(F.col("a"), F.col("b"))).collect()


def test_relevance_map(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 6, 2.0)], "query_id int, doc_id int, relevance double")
    assert evaluation.relevance_map(df).first().relevant_docs == {5: 1.0, 6: 2.0}


# ---------------------------------------------------------------- the rest
def test_vector_engine(spark, tmp_path):
    docs = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "doc_id long, embedding array<float>")
    made = engine.VectorEngine.create_on_disk(spark, str(tmp_path / "v"))
    with pytest.raises(engine.NotIndexedError):
        made.search_vector([0.0, 0.0])
    made.index_docs(docs)
    assert made.search_vector([2.2, 0.0], 3) == [2, 3, 1]
    asked = spark.createDataFrame([(1, [5.0, 0.0]), (2, [0.0, 0.0])], "query_id int, embedding array<float>")
    got = sorted(tuple(r) for r in engine.VectorEngine.open_from_disk(spark, str(tmp_path / "v")).search_batch(asked, 2).collect())
    assert got == [(1, 1, 5, 0.0), (1, 2, 4, 1.0), (2, 1, 0, 0.0), (2, 2, 1, 1.0)]
    with pytest.raises(ValueError, match="unique"):
        engine.VectorEngine.create_in_memory(spark).index_docs(docs.unionByName(docs))
    by_length = engine.VectorEngine.create_in_memory(spark, model=lambda texts: [[float(len(t))] for t in texts])
    by_length.index_docs(spark.createDataFrame([(1, "a"), (2, "aaaa")], "doc_id long, text string"))
    assert by_length.search("bbb", 1) == [2]


def test_engine_names():
    assert engine.engine("alnum") is engine.AlphanumericEngine
    with pytest.raises(ValueError):
        engine.engine("none")


def test_stream_of_documents(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "index")
    for part in (TOY[:4], TOY[4:]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        docs = spark.readStream.schema("doc_id long, text string").parquet(source)
        segments.index_stream(docs, out, str(tmp_path / "checkpoint")).awaitTermination()
    found = segments.open_stream_index(spark, out)
    assert sorted(tuple(r)[1:] for r in found.stats.collect()) == [(3, 3, 7 / 3), (4, 2, 5 / 4)]
    asked = spark.createDataFrame([(1, "cat mouse")], "query_id int, text string")
    assert [r.doc_id for r in search.search_index(found, asked).orderBy("rank").collect()] == [6, 5, 0, 2, 3, 4]


def test_command_line(spark, tmp_path):
    data = tmp_path / "d"
    (data / "qrels").mkdir(parents=True)
    (data / "corpus.jsonl").write_text("\n".join(f'{{"_id": "{i}", "title": "t", "text": "{t}"}}' for i, t in TOY))
    (data / "queries.jsonl").write_text('{"_id": "1", "text": "cat"}\n{"_id": "2", "text": "dog"}')
    (data / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\n1\t0\t1\n1\t6\t1\n2\t1\t1\n")
    base = ["--dataset", "scifact", "--data-dir", str(data), "--parent-index-dir", str(tmp_path)]
    assert "7.00 docs" in cli.main([*base, "index"], spark)[1]
    lines = cli.main([*base, "eval"], spark)
    assert lines[1] == "queries count: 2" and lines[3].startswith("Recall    @10:  avg=1.000")
    assert cli.main([*base, "search", "--query-number", "1"], spark)[-1] == "found: [1, 3, 4]"


def test_vectors_without_an_embedding_are_near_nothing(spark):
    rows = [(2, None), (1, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [5.0, 5.0]), (5, [None, 1.0]), (6, [5.0]), (7, [5.0, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([("a", [5.0, 5.0]), ("b", None), ("c", [4.0])], "query_id string, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in vectors.nearest_batch(table, queries, 4).collect())
    assert got == [("a", 1, 4, 0.0), ("a", 2, 7, 0.0), ("a", 3, 3, 5.656854), ("a", 4, 1, 7.071068), ("c", 1, 6, 1.0)]
    assert sorted(got) == sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in vectors.nearest_batch(table, queries, 4, block_bytes=8).collect())
    assert [r.vec_id for r in vectors.nearest(table, [5.0, 5.0], 10).collect()] == [4, 7, 3, 1]


def test_indexing_again_adds_vectors(spark, tmp_path):
    made = engine.VectorEngine.create_on_disk(spark, str(tmp_path / "v"))
    for ids in ((1, 2), (3,)):
        made.index_docs(spark.createDataFrame([(i, [float(i)]) for i in ids], "doc_id long, embedding array<float>"))
    assert engine.VectorEngine.open_from_disk(spark, str(tmp_path / "v")).search_vector([0.0]) == [1, 2, 3]
    with pytest.raises(ValueError, match="unique"):
        made.index_docs(spark.createDataFrame([(3, [3.0])], "doc_id long, embedding array<float>"))


def test_boolean_search_over_an_index(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "red hen", "fox hen", "red fox hen"])], "doc_id long, text string")
    for query in ("red AND NOT hen", "fox OR hen", "red AND (fox OR hen)"):
        expected = sorted(boolean.boolean_search(docs, query).collect())
        assert sorted(boolean.boolean_search(index.build_index(docs, 2), query).collect()) == expected and expected


def test_ties_of_a_segment_go_by_place_and_of_segments_by_id(spark):
    docs = spark.createDataFrame([(10 * i, "red fox" if i % 2 else "red") for i in range(9)], "doc_id long, text string")
    found = boolean.boolean_search(index.build_index(docs, 4), "fox", with_places=True)
    assert [r.doc_id for r in boolean.collect_top_segments(found, 1).collect()] == [10]
    assert [r.doc_id for r in boolean.collect_top_segments(found, 3).collect()] == [10, 30, 50]
    moved = found.withColumn("seg_doc_id", -F.col("seg_doc_id"))
    assert [r.doc_id for r in boolean.collect_top_segments(moved, 1).collect()] == [30]
