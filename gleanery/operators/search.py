"""Ranked search: one query or many in one job, over documents or a stored index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions.scoring import bm25, tfidf
from gleanery.functions.text import ANALYSERS, not_stop_word
from gleanery.operators.index import Index, analysed
from gleanery.storage import discard, materialize

SCORERS = ("bm25", "tfidf")


def query_terms(queries: DataFrame, analyser: str = "alphabetic", stop_words: bool = True) -> DataFrame:
    """(query_id, term, times): the terms of (query_id, text) without stop words, and how often each
    was asked for, since a repeated word counts repeatedly."""
    exploded = queries.select("query_id", F.explode(ANALYSERS[analyser](F.col("text"))).alias("term"))
    if stop_words:
        exploded = exploded.where(not_stop_word(F.col("term")))
    return exploded.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _score(scorer: str) -> Column:
    c = F.col
    if scorer == "bm25":
        return bm25(c("tf"), c("doc_len"), c("df"), c("n"), c("avgdl"))
    if scorer == "tfidf":
        return tfidf(c("tf"), c("doc_len"), c("df"), c("n"))
    raise ValueError(f"unknown scorer {scorer!r}; there are {', '.join(SCORERS)}")


def rank(scored: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best of every query: by score rounded to six digits, then by id, so that sums
    in another order rank alike. Spark keeps no more than the limit per query and partition."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id", "key")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "score")


#: Parts of scores that one task adds up: a posting has one for each query that asks for its term.
TASK_PARTS = 2_000_000


@dataclass
class Asked:
    """What queries ask for, with its statistics. weights: query_id, term, times, df, written to the shared folder,
    so that the planner knows its size; parts: the postings, each as often as it is asked for; n and avgdl: the
    number of documents and their average length."""

    weights: DataFrame
    parts: int
    n: int
    avgdl: float

    def postings(self, postings: DataFrame) -> DataFrame:
        return postings.join(self.weights.select("term").distinct(), "term", "left_semi")

    def scores(self, postings: DataFrame, keys: tuple[str, ...], scorers: tuple[str, ...]) -> DataFrame:
        """(query_id, keys, a column per scorer) of the postings that are asked for; without a column tf, of
        single terms, which are counted.

        They are shuffled by document, once and before they are multiplied by the queries, into as many partitions
        as keep the scores of each in bounds; the sums are made there.
        """
        spark = postings.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, -(-self.parts // TASK_PARTS))
        placed = self.postings(postings).repartition(tasks, *keys)
        if "tf" not in placed.columns:
            placed = placed.groupBy(*keys, "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
        joined = placed.join(self.weights, "term")
        joined = joined.withColumns({"n": F.lit(self.n), "avgdl": F.lit(self.avgdl)})
        return joined.groupBy("query_id", *keys).agg(*(F.round(F.sum(_score(s) * F.col("times")), 6).alias(s) for s in scorers))


def _asked(words: DataFrame, counts: DataFrame, totals: Callable[[DataFrame], tuple[int, float]]) -> Asked:
    """``words``: query_id, term, times; ``counts``: term, df and what ``totals`` takes the number of documents and
    their average length from."""
    counts = materialize(counts, "counts")
    weights = materialize(words.join(counts.select("term", "df"), "term").select("query_id", "term", "times", "df"), "weights")
    n, avgdl = totals(counts)
    discard(counts)
    return Asked(weights, weights.agg(F.sum("df")).first()[0] or 0, n, avgdl)


def score_documents(docs: DataFrame, queries: DataFrame, scorers: tuple[str, ...], analyser: str = "alphabetic", stop_words: bool = True) -> DataFrame:
    """(query_id, key, doc_id, a column per scorer): the scores of all documents that hold a term of a
    query, by several scorers in one pass over the documents, with statistics of all of them.

    A first pass counts, at once, the documents of every term that is asked for and, under the empty term, which is
    none, all documents and their terms. Terms are matched with the queries' terms as soon as they are
    split off, so that only those that some query asks for are shuffled and then counted; a document's
    length travels with them. For an inner explode the planner would add a filter that analyses texts again.
    """
    words = query_terms(queries, analyser, stop_words)
    found = analysed(docs, analyser)
    distinct = F.array_append(F.array_distinct("doc_terms"), F.lit(""))
    terms = words.select("term").union(words.sparkSession.range(1).select(F.lit(""))).distinct()
    held = found.select("doc_len", F.explode_outer(distinct).alias("term")).join(terms, "term", "left_semi")
    counts = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("doc_len").alias("terms"))

    def totals(counts: DataFrame) -> tuple[int, float]:
        row = counts.where("term = ''").first()
        return (row.df, row.terms / row.df) if row else (0, 0.0)

    asked = _asked(words, counts, totals)
    keys = ("key", "doc_id")
    found = found.withColumn("key", F.monotonically_increasing_id())
    return asked.scores(found.select(*keys, "doc_len", F.explode_outer("doc_terms").alias("term")), keys, scorers)


def search_documents(
    docs: DataFrame, queries: DataFrame, limit: int = 10, scorer: str = "bm25", analyser: str = "alphabetic", stop_words: bool = True
) -> DataFrame:
    """(query_id, rank, doc_id, score) over documents that are not indexed (:func:`score_documents`)."""
    return rank(score_documents(docs, queries, (scorer,), analyser, stop_words).withColumnRenamed(scorer, "score"), limit)


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """``df`` with the columns of the one row of ``totals``, as scalar subqueries."""
    return df.withColumns({c: totals.select(c).scalar() for c in totals.columns})


def search_index(index: Index, queries: DataFrame, limit: int = 10, scorer: str = "bm25", stats: str = "global", stop_words: bool = True, analyser: str = "alphabetic") -> DataFrame:
    """(query_id, rank, doc_id, score) over an index.

    A posting has its document's length, so documents are looked up for the best only.
    ``stats="segment"`` scores each segment by its own statistics, so scores depend on how the
    documents were split; "global" uses those of the whole index.
    """
    words = query_terms(queries, analyser, stop_words)
    keys = ("segment_id", "seg_doc_id")
    postings = index.postings.join(words.select("term").distinct(), "term", "left_semi")
    if stats == "segment":
        totals = index.docs.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avgdl"))
        df = postings.groupBy("segment_id", "term").agg(F.count(F.lit(1)).alias("df"))
        parts = postings.join(df, ["segment_id", "term"]).join(totals, "segment_id").withColumn("score", _score(scorer)).join(words, "term")
        summed = parts.groupBy("query_id", *keys).agg(F.round(F.sum(F.col("score") * F.col("times")), 6).alias("score"))
    elif stats == "global":
        # the postings that are asked for hold all of a term's
        counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        asked = _asked(words, counts, lambda _: tuple(index.docs.agg(F.count(F.lit(1)), F.avg("doc_len")).first()))
        summed = asked.scores(index.postings, keys, (scorer,)).withColumnRenamed(scorer, "score")
    else:
        raise ValueError("stats is 'global' or 'segment'")
    summed = summed.withColumn("key", F.struct(*keys))
    # the best of every query and those that tie with the last, by score alone, so that few documents are looked up
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    near = summed.withColumn("at", F.rank().over(best)).where(F.col("at") <= limit).select("query_id", "score", "key", *keys)
    return rank(near.join(index.docs.select(*keys, "doc_id"), [*keys]), limit)
