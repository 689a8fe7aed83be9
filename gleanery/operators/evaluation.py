"""Search quality against relevance judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gain(relevance: Column, scheme: str = "burges") -> Column:
    """burges: 2 ** relevance - 1; jarvelin: the relevance itself."""
    if scheme == "jarvelin":
        return relevance
    if scheme == "burges":
        return F.pow(F.lit(2.0), relevance) - 1
    raise ValueError("scheme is 'burges' or 'jarvelin'")


def query_quality(found: DataFrame, qrels: DataFrame, queries: DataFrame, limit: int = 10, scheme: str = "burges") -> DataFrame:
    """(query_id, found, relevant, hits, precision, recall, ndcg): one row per query.

    ``found``: query_id, rank from 1, doc_id; ``qrels``: query_id, doc_id, relevance. A query
    without judgments has recall 1, and precision and nDCG 1 only if nothing was found. Judgments
    whose ideal gain is zero are an error.
    """
    top = found.where(F.col("rank") <= limit)
    joined = top.join(qrels, ["query_id", "doc_id"], "left")
    discount = F.log2(F.col("rank") + 1.0)
    got = joined.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("found"),
        F.count("relevance").alias("hits"),
        F.sum(gain(F.coalesce("relevance", F.lit(0.0)), scheme) / discount).alias("dcg"),
    )
    ordered = qrels.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc())))
    ideal = ordered.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("relevant"),
        F.sum(F.when(F.col("rank") <= limit, gain(F.col("relevance"), scheme) / discount)).alias("ideal"),
    )
    rows = queries.select("query_id").join(got, "query_id", "left").join(ideal, "query_id", "left").na.fill(0, ["found", "hits", "relevant", "dcg"])
    none = F.col("relevant") == 0
    empty = F.when(F.col("found") == 0, 1.0).otherwise(0.0)
    zero = F.raise_error(F.lit("ideal gain is zero: no relevant documents, or a limit of zero")).cast("double")
    return rows.select(
        "query_id",
        "found",
        "relevant",
        "hits",
        F.when(F.col("found") == 0, F.when(none, 1.0).otherwise(0.0)).otherwise(F.col("hits") / F.col("found")).alias("precision"),
        F.when(none, 1.0).otherwise(F.col("hits") / F.col("relevant")).alias("recall"),
        F.when(none, empty).when(F.coalesce("ideal", F.lit(0.0)) == 0, zero).otherwise(F.col("dcg") / F.col("ideal")).alias("ndcg"),
    )


def summary(quality: DataFrame) -> DataFrame:
    """One row: queries, the averages, and exact interpolated percentiles 50, 90 and 100 of precision
    and recall; an error without queries."""
    columns = [F.count(F.lit(1)).alias("queries")]
    columns += [F.avg(c).alias(f"{c}_avg") for c in ("precision", "recall", "ndcg")]
    columns += [F.percentile(c, F.lit(p / 100)).alias(f"{c}_p{p}") for c in ("precision", "recall") for p in (50, 90, 100)]
    out = quality.agg(*columns)
    some = F.when(F.col("queries") == 0, F.raise_error(F.lit("there are no queries")).cast("long")).otherwise(F.col("queries"))
    return out.withColumn("queries", some)


def ranked_overlap(a: Column, b: Column) -> Column:
    """Mean share of common items over all prefixes of two rankings; 1 if both are empty, 0 if one
    is. Repeated items are an error."""
    longest = F.greatest(F.size(a), F.size(b))
    total = F.aggregate(
        F.sequence(F.lit(1), longest),
        F.lit(0.0),
        lambda acc, w: acc + F.size(F.array_intersect(F.slice(a, F.lit(1), w), F.slice(b, F.lit(1), w))) / w,
    )
    repeats = (F.size(F.array_distinct(a)) < F.size(a)) | (F.size(F.array_distinct(b)) < F.size(b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .when(repeats, F.raise_error(F.lit("rankings must not repeat an item")).cast("double"))
        .otherwise(total / longest)
    )


def relevance_map(qrels: DataFrame) -> DataFrame:
    """(query_id, relevant_docs): judgments nested as a map, which one query's judgments fit in."""
    pair = F.collect_list(F.struct("doc_id", "relevance"))
    return qrels.groupBy("query_id").agg(F.map_from_entries(pair).alias("relevant_docs"))
