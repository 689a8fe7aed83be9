"""Query op5: overlaps of all ``documents`` with the ``benchmark`` items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.common import table
from gleanery.llm.decontaminate import find_overlaps


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, overlap, matched: the longest overlap of each pair."""
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}
ORACLES: dict[str, str] = {}
