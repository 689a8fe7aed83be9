"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on every row that the
stage before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import materialize, table
from gleanery.llm.decontaminate import decontaminate
from gleanery.llm.mixing import cyclic_weights, mix_sources
from gleanery.llm.pii import replace_personal_data, session_key
from gleanery.llm.quality import fit_quality, keep_quality, scorer
from gleanery.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more stay; learnt from the labelled ones among ``docs``. Without a
    label all score 0.5. Null and empty texts score as texts without any mark of quality; equal
    texts score alike; other columns are kept as they are, whatever their names."""
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays, in all its rows where
    it has several. Texts without a word and rows without an id stay; no other column is read."""
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go, all rows of an id together (a null id is
    one); null and empty texts hold none; no other column is read."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets format-preserving pseudonyms, equal ones for equal values; n_chars follows the
    new text (null for a null text); other columns stay."""
    return replace_personal_data(docs, session_key(spark)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies: doc_id, source, text, lang,
    n_chars, size, source_size, target, copies, taken. The keys that order the documents of a source
    are scaled by quality, as learnt from the labelled ones of ``docs``; texts without a word are
    taken or not by their keys like any other; a null source is a source; further columns are
    left behind."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    mixed = mix_sources(docs, cyclic_weights(docs), keep=("text", "lang", "n_chars"), weigh=scorer(model))
    return mixed.where("copies > 0")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("PII pseudonyms", personal_data),
    ("mix of sources", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Boosted trees, code-word keys and keyed permutations are beyond SQL; tests/llm/test_pipeline.py
#: holds the rows against a brute-force version instead.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
