"""Query op3: near-duplicates of ``documents`` by 64-bit SimHash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table
from gleanery.llm.simhash import simhash_groups


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), n_near, component_id of every document."""
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id",
        F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"),
        "n_near",
        "component_id",
    )


QUERIES = {"op3_simhash_near_dedup": op3_simhash_near_dedup}
ORACLES: dict[str, str] = {}
