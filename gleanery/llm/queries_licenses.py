"""Query op4: license notices in all ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.common import table
from gleanery.llm.licenses import scan_licenses


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks, found."""
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES: dict[str, str] = {}
