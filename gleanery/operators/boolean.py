"""Boolean queries in one aggregation, and the collectors over their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions.scoring import bm25
from gleanery.operators.index import Index, analysed, postings_of
from gleanery.operators.search import with_totals
from gleanery.plans import boolean
from gleanery.plans.language import parse


def boolean_search(docs: DataFrame | Index, query: str, scored: bool = True, analyser: str = "alphabetic", with_places: bool = False) -> DataFrame:
    """(doc_id, score) of the documents, or of those of an index, that match; without ``scored`` only
    doc_id, with ``with_places`` also segment_id and seg_doc_id of an index.

    The postings of the query's terms are brought together by document once, whatever the shape
    of the query; the plan becomes one expression for the match and one for the score. Stop
    words are terms like any other here.
    """
    node = boolean.plan(parse(query))
    terms = boolean.leaf_terms(node)
    if isinstance(docs, Index):
        found, key = docs.docs, ["segment_id", "seg_doc_id"]
        postings = docs.postings_for(*terms)
    else:
        found, key = analysed(docs, analyser).withColumn("key", F.monotonically_increasing_id()), ["key", "doc_id"]
        postings = postings_of(found, key, F.col("term").isin(*terms))
    places = {t: f"_t{i}" for i, t in enumerate(terms)}
    if scored:
        df = postings.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # the same shuffle, used again
        totals = found.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avgdl"))
        postings = with_totals(postings.join(F.broadcast(df), "term"), totals)  # a row per query term
        part = bm25(*(F.col(c) for c in ("tf", "doc_len", "df", "n", "avgdl")))
    else:
        part = F.lit(0.0)
    columns = []
    for t, name in places.items():
        columns += [F.max(F.col("term") == t).alias(name), F.max(F.when(F.col("term") == t, part)).alias(f"{name}s")]
    rows = postings.groupBy(*key).agg(*columns)
    has = {t: F.col(n) for t, n in places.items()}
    matching = rows.where(boolean.matched(node, has))
    if isinstance(docs, Index):
        matching = matching.join(docs.docs.select(*key, "doc_id"), key)
    shown = ["doc_id", *(key if with_places else ())]
    if not scored:
        return matching.select(*shown)
    return matching.select(*shown, F.round(boolean.score(node, has, {t: F.col(f"{n}s") for t, n in places.items()}), 6).alias("score"))


def collect_count(matching: DataFrame) -> DataFrame:
    """The number of matches; the score, if any, is pruned from the plan."""
    return matching.agg(F.count(F.lit(1)).alias("matches"))


def collect_top(matching: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` matches: by score, then by id."""
    return matching.orderBy(F.col("score").desc(), "doc_id").limit(limit)


def collect_top_segments(matching: DataFrame, limit: int) -> DataFrame:
    """(doc_id, score): the best ``limit`` of every segment, by score and then by place, and of these the
    best ``limit``, by score and then by id; from matches with their places."""
    best = Window.partitionBy("segment_id").orderBy(F.col("score").desc(), "seg_doc_id")
    kept = matching.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= limit)
    return collect_top(kept.select("doc_id", "score"), limit)
