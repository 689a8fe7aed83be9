"""Query op8: all ``documents`` with personal data under format-preserving pseudonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table
from gleanery.llm.pii import KINDS, pseudonymise_texts, session_key


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_<kind> and n_found of every document."""
    changed = pseudonymise_texts(table(spark, sf_dir, "documents"), session_key(spark))
    total = sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}"))
    return changed.withColumn("n_found", total)


QUERIES = {"op8_pii_pseudonyms": op8_pii_pseudonyms}
ORACLES: dict[str, str] = {}
