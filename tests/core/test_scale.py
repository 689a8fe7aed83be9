"""What tasks hold and what is shuffled do not grow out of proportion."""

import pyarrow as pa

from gleanery import queries
from gleanery.functions import wikitext
from gleanery.operators import codec, index, numbering, search


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def toy(spark, n=40):
    return spark.createDataFrame([(i, f"cat dog w{i} w{i % 7} cat") for i in range(n)], "doc_id long, text string")


def test_files_of_a_stored_index_do_not_follow_its_segments(spark, tmp_path):
    made = index.build_index(toy(spark), 1)
    made.write(str(tmp_path))
    made.write(str(tmp_path), "append")
    assert sorted(p.name for p in (tmp_path / "postings").iterdir() if p.is_dir()) == ["first=0", "first=40"]
    assert len([*(tmp_path / "postings").rglob("*.parquet")]) <= 2 * spark.sparkContext.defaultParallelism
    opened = index.Index.open(spark, str(tmp_path))
    once = {(r.segment_id, r.term, r.df) for r in made.terms.collect()}
    assert {tuple(r) for r in opened.terms.collect()} == once | {(s + 40, t, n) for s, t, n in once}
    assert opened.stats.count() == 80 and opened.postings.count() == 2 * made.postings.count()


def test_postings_are_counted_where_documents_are_numbered(spark):
    assert "hashpartitioning" not in plan(index.build_index(toy(spark), 3).postings)


def test_ranges_have_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(numbering, "RANGE_ROWS", 5)
    found = numbering.with_row_number(toy(spark, 200), "doc_id", "row", "part")
    assert max(r["count"] for r in found.groupBy("part").count().collect()) <= 10
    assert [r.row for r in found.orderBy("doc_id").collect()] == list(range(200))


def test_scores_are_added_up_where_the_documents_are(spark):
    asked = spark.createDataFrame([(k, "cat w1 w2") for k in range(5)], "query_id int, text string")
    assert "hashpartitioning(query_id" not in plan(search.score_documents(toy(spark), asked, search.SCORERS))
    assert "hashpartitioning(query_id#" not in plan(search.search_index(index.build_index(toy(spark)), asked)).split("WindowGroupLimit")[-1]


def test_tasks_follow_the_scores(spark, monkeypatch):
    asked = spark.createDataFrame([(k, "cat w1 w2") for k in range(5)], "query_id int, text string")
    expected = sorted(search.search_documents(toy(spark), asked).collect())
    monkeypatch.setattr(search, "TASK_PARTS", 10)
    many = search.score_documents(toy(spark), asked, ("bm25",))
    assert "REPARTITION_BY_NUM" in plan(many)
    assert many.rdd.getNumPartitions() > 4
    assert sorted(search.search_documents(toy(spark), asked).collect()) == expected and len(expected) == 50


def test_judgments_analyse_a_text_once(spark, tmp_path):
    docs = [(1, "A b, c d e f g"), (2, "b c d e f g"), (3, "a b c d e"), (4, "x a b c d e f"), (5, "xa b c d e f"), (6, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "a b c d e f zz"), (1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = queries._qrels(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 2.0), (0, 4, 1.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 3  # two are of the benchmark


class Streamed:
    """Stands for a sorted table; the function of mapInArrow is kept."""

    def select(self, *_):
        return self

    repartition = sortWithinPartitions = select

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_lists_are_coded_across_batches_and_unpacked_in_parts(monkeypatch):
    monkeypatch.setattr(codec, "UNPACKED", 300)
    lists = {(0, "a"): 1, (0, "b"): 700, (1, "b"): 129, (1, "c"): 128, (2, "d"): 2}
    lists = {k: [(3 * i + 7 * n, i % 9) for i in range(n)] for k, n in lists.items()}
    rows = [(*k, *p) for k, v in lists.items() for p in v]
    for size in (1, 50, 2000):
        parts = [pa.RecordBatch.from_pylist([dict(zip("stdf", r)) for r in rows[i : i + size]], pa.schema([("s", pa.int32()), ("t", pa.string()), ("d", pa.int32()), ("f", pa.int32())])) for i in range(0, len(rows), size)]
        encoded = [*codec.encode_lists(Streamed())(iter(parts))]
        got = {(r["segment_id"], r["term"]): (r["postings"], r["data"]) for b in encoded for r in b.to_pylist()}
        assert got == {k: (len(v), codec.encode_postings(v)) for k, v in lists.items()}
        decoded = [*codec.decode_lists(Streamed())(iter(encoded))]
        assert sorted(tuple(r.values()) for b in decoded for r in b.to_pylist()) == sorted(rows)
        assert max(b.num_rows for b in decoded) < 1000


def test_markup_is_stripped_in_parts():
    texts = [None, *["[[a|b]]"] * 299]
    parts = [*wikitext.strip_wikitext_column.func(iter([pa.array(texts)]))]
    assert max(map(len, parts)) <= 128
    assert [x for p in parts for x in p.to_pylist()] == [None, *["b"] * 299]
