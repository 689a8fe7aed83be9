"""Query op9: the main text of all ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.common import table
from gleanery.llm.wrappers import extract_articles


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract_articles(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
ORACLES: dict[str, str] = {}
