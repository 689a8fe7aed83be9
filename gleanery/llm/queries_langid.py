"""Query op10: the language of all ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import crc_remainder, table
from gleanery.llm.langid import learn_prototypes, predict_language


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents")
    found = predict_language(docs, learn_prototypes(docs))
    return found.select("doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
