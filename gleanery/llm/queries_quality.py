"""Query op6: quality of all ``documents``, learnt from ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import crc_remainder, table
from gleanery.llm.quality import fit_quality, predicted, score_quality


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        predicted(F.col("score")).alias("predicted"),
    )


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
