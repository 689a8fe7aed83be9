import pytest

from gleanery import cli
from gleanery.operators import index, sets


def scored(spark, *ids, score=None):
    return spark.createDataFrame([(i, float(i if score is None else score)) for i in ids], "doc_id int, score double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_intersect(spark):
    assert rows(sets.intersect(scored(spark, 1, 2, 3), scored(spark, 2, 3, 4))) == [(2, 4.0), (3, 6.0)]
    assert rows(sets.intersect(scored(spark, 1, 2), scored(spark, 2), scored(spark, 2, 5))) == [(2, 6.0)]
    assert rows(sets.intersect(scored(spark, 1), scored(spark))) == [] and rows(sets.intersect(scored(spark, 1))) == [(1, 1.0)]
    with pytest.raises(ValueError):
        sets.intersect()


def test_union(spark):
    assert rows(sets.union(scored(spark, 1, 2), scored(spark, 2, 3), scored(spark, 2, 4))) == [(1, 1.0), (2, 6.0), (3, 3.0), (4, 4.0)]
    assert rows(sets.union(scored(spark), scored(spark))) == []
    with pytest.raises(ValueError):
        sets.union()


def test_exclude(spark):
    four = scored(spark, 1, 2, 3, 4)
    assert rows(sets.exclude(four, scored(spark, 2, 3, score=9))) == [(1, 1.0), (4, 4.0)]
    assert rows(sets.exclude(four, scored(spark, 1), scored(spark, 4))) == [(2, 2.0), (3, 3.0)]
    assert rows(sets.exclude(four)) == rows(four) and rows(sets.exclude(scored(spark), four)) == []


def test_seek_and_accessors(spark):
    assert rows(sets.seek(scored(spark, 1, 5, 9), 5)) == [(5, 5.0), (9, 9.0)]
    made = index.build_index(spark.createDataFrame([(7, "cat dog"), (8, "cat")], "doc_id long, text string"))
    assert [tuple(r) for r in made.stored_docs(0, 1).collect()] == [(0, 1, 8, 1)]
    assert made.postings_for("none").count() == 0


def test_progress():
    assert cli.progress_line(5000, 2_500_000, 10.0, 10_000) == "5.00 Kdocs (500.00 docs/sec) 2.50 MB (250.00 KB/sec) ETA ~0 minutes"
    assert "ETA" not in cli.progress_line(5000, 10, 10.0, None)
