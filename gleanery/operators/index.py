"""The inverted index: postings, term dictionary, documents and statistics, in segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import ANALYSERS
from gleanery.operators.numbering import with_row_number

DEFAULT_SEGMENT_DOCS = 25_000
POSTING = ("segment_id", "term", "seg_doc_id", "doc_len", "tf")
TABLES = ("postings", "docs", "terms", "stats")


def analysed(docs: DataFrame, analyser: str = "alphabetic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_terms, doc_len): the terms of every document in order, and how many there are."""
    found = docs.select(F.col(id_col).alias("doc_id"), ANALYSERS[analyser](F.col(text_col)).alias("doc_terms"))
    return found.withColumn("doc_len", F.size("doc_terms"))


def segmented(docs: DataFrame, max_segment_docs: int | None = DEFAULT_SEGMENT_DOCS, analyser: str = "alphabetic") -> DataFrame:
    """(part, segment_id, seg_doc_id, doc_id, doc_terms, doc_len): documents in the order of their ids, cut
    into segments of ``max_segment_docs`` and numbered from 0 in each; None: one segment. Texts are analysed
    before they are moved, so that where only lengths are asked for nothing else is. ``part`` is
    the partition, which has a bounded number of documents."""
    if max_segment_docs is not None and max_segment_docs < 1:
        raise ValueError("a segment holds one document at least")
    numbered = with_row_number(analysed(docs, analyser), "doc_id", "_row", "part")
    size = F.lit(max_segment_docs) if max_segment_docs else F.lit((1 << 31) - 1)
    return numbered.select(
        "part",
        F.floor(F.col("_row") / size).cast("int").alias("segment_id"),
        (F.col("_row") % size).cast("int").alias("seg_doc_id"),
        "doc_id",
        "doc_terms",
        "doc_len",
    )


def postings_of(docs: DataFrame, keys: list[str], wanted: Column | None = None) -> DataFrame:
    """(keys, doc_len, term, tf) of analysed documents; ``wanted`` filters terms before the shuffle. For an
    inner explode the planner would add a filter that analyses texts again."""
    exploded = docs.select(*keys, "doc_len", F.explode_outer("doc_terms").alias("term")).where(F.col("term").isNotNull())
    if wanted is not None:
        exploded = exploded.where(wanted)
    return exploded.groupBy(*keys, "doc_len", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


@dataclass
class Index:
    """The tables of an index.

    postings: segment_id, term, seg_doc_id, doc_len, tf; docs: segment_id, seg_doc_id, doc_id, doc_len (rows
    without a term too); terms: segment_id, term, df; stats: segment_id, indexed_docs,
    max_posting_list, terms_per_doc_avg.
    """

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    stats: DataFrame

    def postings_for(self, *terms: str) -> DataFrame:
        """The posting lists of some terms; the filter reaches the scan of a stored index."""
        return self.postings.where(F.col("term").isin(*terms))

    def stored_docs(self, segment_id: int, *seg_doc_ids: int) -> DataFrame:
        """The documents at some places of a segment, with their ids and lengths."""
        return self.docs.where((F.col("segment_id") == segment_id) & F.col("seg_doc_id").isin(*seg_doc_ids))

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Parquet below ``path``, a directory of postings for each call. Each task sorts the postings of its
        documents by term and writes one file, however many segments there are, so that row groups
        can be left out by their bounds. Terms and statistics are counted from what was written."""
        spark, first = self.postings.sparkSession, 0
        if mode == "append":
            last = spark.read.parquet(f"{path}/stats").agg(F.max("segment_id")).first()[0]
            first = 0 if last is None else last + 1
        moved = lambda df: df.withColumn("segment_id", (F.col("segment_id") + F.lit(first)).cast("int"))
        ordered = moved(self.postings).withColumn("first", F.lit(first)).sortWithinPartitions("first", "term", "segment_id", "seg_doc_id")
        ordered.write.mode(mode).option("parquet.bloom.filter.enabled#term", "true").partitionBy("first").parquet(f"{path}/postings")
        moved(self.docs).write.mode(mode).parquet(f"{path}/docs")
        own = F.col("segment_id") >= first
        written = Index.open_postings(spark, path).where((F.col("first") == first) & own)
        term_dictionary(written).write.mode(mode).parquet(f"{path}/terms")
        docs, terms = (spark.read.parquet(f"{path}/{n}").where(own) for n in ("docs", "terms"))
        segment_stats(docs, terms).write.mode(mode).parquet(f"{path}/stats")

    def cache(self) -> Index:
        for name in TABLES:
            getattr(self, name).cache()
        return self

    @staticmethod
    def open_postings(spark: SparkSession, path: str) -> DataFrame:
        schema = "term string, seg_doc_id int, doc_len int, tf int, segment_id int, first int"
        return spark.read.schema(schema).parquet(f"{path}/postings")

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        return Index(Index.open_postings(spark, path).select(*POSTING), *(spark.read.parquet(f"{path}/{n}") for n in TABLES[1:]))


def build_index(docs: DataFrame, max_segment_docs: int | None = DEFAULT_SEGMENT_DOCS, analyser: str = "alphabetic") -> Index:
    """An index over (doc_id, text). Rows that share an id stay separate documents."""
    found = segmented(docs, max_segment_docs, analyser)
    keys = ["segment_id", "seg_doc_id"]
    postings = postings_of(found, ["part", *keys]).select(*POSTING)  # counted where the documents are
    terms = term_dictionary(postings)
    table = found.select(*keys, "doc_id", "doc_len")
    return Index(postings, table, terms, segment_stats(table, terms))


def term_dictionary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("segment_id", "term").agg(F.count(F.lit(1)).alias("df"))


def segment_stats(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per segment; the average length is not-a-number where there is no document."""
    sizes = docs.groupBy("segment_id").agg(F.count(F.lit(1)).alias("indexed_docs"), F.sum("doc_len").alias("_terms"))
    longest = terms.groupBy("segment_id").agg(F.max("df").alias("max_posting_list"))
    return sizes.join(longest, "segment_id", "left").select(
        "segment_id",
        "indexed_docs",
        F.coalesce("max_posting_list", F.lit(0)).cast("long").alias("max_posting_list"),
        (F.col("_terms") / F.col("indexed_docs")).alias("terms_per_doc_avg"),
    )
