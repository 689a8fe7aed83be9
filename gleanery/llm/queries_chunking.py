"""Query op7: chunk fingerprints of all ``documents`` and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.chunking import edited_fingerprints
from gleanery.llm.common import table


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op7_document_fingerprints": op7_document_fingerprints}
ORACLES: dict[str, str] = {}
