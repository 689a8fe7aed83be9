"""Operators on scored result sets: (doc_id, score), one row per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _together(inputs: tuple[DataFrame, ...]) -> DataFrame:
    marked = (d.select("doc_id", "score", F.lit(i).alias("input")) for i, d in enumerate(inputs))
    return reduce(DataFrame.unionByName, marked)


def intersect(*inputs: DataFrame) -> DataFrame:
    """Documents that every input has, scores added; without inputs an error.

    One shuffle for any number of inputs, with partial sums on the map side.
    """
    if not inputs:
        raise ValueError("an intersection needs an input")
    found = _together(inputs).groupBy("doc_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") == len(inputs)).select("doc_id", "score")


def union(*inputs: DataFrame) -> DataFrame:
    """Documents that any input has, the scores of those inputs added."""
    if not inputs:
        raise ValueError("a union needs an input")
    return _together(inputs).groupBy("doc_id").agg(F.sum("score").alias("score"))


def exclude(include: DataFrame, *excluded: DataFrame) -> DataFrame:
    """Documents of ``include`` that no excluded input has, with their own scores."""
    for other in excluded:
        include = include.join(other.select("doc_id"), "doc_id", "left_anti")
    return include.select("doc_id", "score")


def seek(found: DataFrame, target: int) -> DataFrame:
    """The documents from ``target`` on; the bound reaches the scan of a stored table."""
    return found.where(F.col("doc_id") >= target)
