"""Registered queries of the readers: tables written in the format of a collection, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import ids, wikitext
from gleanery.sources import tables
from gleanery.storage import read_table, shared_dir


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}"


def _lines(rows: DataFrame, value: Column, order: str, path: str, **options: str) -> str:
    """A text file of one line per row, in order."""
    rows.orderBy(order).select(value).coalesce(1).write.options(**options).text(path)
    return path


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    title, text = (F.coalesce(c, F.lit("")) for c in ("source", "text"))
    return docs.select(F.concat(F.lit("MED-"), F.col("doc_id")).alias("_id"), title.alias("title"), text.alias("text"))


def _judgments(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Item k judges the document of that number with k mod 3; then item 1 again with 2."""
    rows = read_table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") + 1).alias("at"), F.concat_ws("\t", F.concat(F.lit("PLAIN-"), "item_id"), F.concat(F.lit("MED-"), "item_id"), F.col("item_id") % 3).alias("value")
    )
    ends = spark.createDataFrame([(-1, "query-id\tcorpus-id\tscore"), (1 << 40, "PLAIN-1\tMED-1\t2")], "at long, value string")
    return _lines(rows.unionByName(ends), F.col("value"), "at", path)


def _plain(df: DataFrame) -> DataFrame:
    """Ids as 64-bit numbers, which those written here are."""
    return df.withColumns({c: F.col(c).cast("long") for c in df.columns if c.endswith("_id")})


def read_beir_json(spark, sf_dir):
    path = f"{_folder(spark)}/corpus.jsonl"
    _corpus(spark, sf_dir).write.json(path)
    return _plain(tables.beir_docs_json(spark, path))


def read_beir_parquet(spark, sf_dir):
    path = f"{_folder(spark)}/corpus"
    _corpus(spark, sf_dir).write.parquet(path)
    return _plain(tables.beir_docs_parquet(spark, path))


def read_beir_qrels(spark, sf_dir):
    return _plain(tables.beir_qrels(spark, _judgments(spark, sf_dir, f"{_folder(spark)}/test.tsv")))


def read_beir_queries(spark, sf_dir):
    """The items with a judgment above zero."""
    folder = _folder(spark)
    items = read_table(spark, sf_dir, "benchmark").select(F.concat(F.lit("PLAIN-"), "item_id").alias("_id"), "text")
    items.write.json(f"{folder}/queries.jsonl")
    return _plain(tables.beir_queries_json(spark, f"{folder}/queries.jsonl", tables.beir_qrels(spark, _judgments(spark, sf_dir, f"{folder}/test.tsv"))))


def _cisi(spark, sf_dir, sections: Column, path: str) -> str:
    items = read_table(spark, sf_dir, "benchmark")
    return _lines(items, F.concat(F.lit(".I "), F.col("item_id"), F.lit("\n"), sections), "item_id", path)


def read_cisi_docs(spark, sf_dir):
    first, rest = F.split("text", " ", 2)[0], F.split("text", " ", 2)[1]
    sections = F.concat(F.lit(".T\n"), first, F.lit("\n.A\nSome One\nOther\n.W\n"), rest, F.lit("\nlast line\n.X\n1\t2"))
    return tables.cisi_docs(spark, _cisi(spark, sf_dir, sections, f"{_folder(spark)}/CISI.ALL"))


def read_cisi_queries(spark, sf_dir):
    return tables.cisi_queries(spark, _cisi(spark, sf_dir, F.concat(F.lit(".W\n"), "text", F.lit("\nsecond line")), f"{_folder(spark)}/CISI.QRY"))


def read_cisi_qrels(spark, sf_dir):
    items = read_table(spark, sf_dir, "benchmark")
    line = F.concat(F.lit("    "), F.col("item_id"), F.lit("     "), F.col("item_id") * 3, F.lit("\t0\t0.000000"))
    return tables.cisi_qrels(spark, _lines(items, line, "item_id", f"{_folder(spark)}/CISI.REL"))


def parse_id_numbers(spark, sf_dir):
    """Ids that hold a number: as such, behind a sign, behind the only hyphen."""
    doc = F.col("doc_id")
    form = F.when(doc % 3 == 0, doc.cast("string")).when(doc % 3 == 1, F.concat(F.lit("+"), doc)).otherwise(F.concat(F.lit("MED-"), doc))
    return read_table(spark, sf_dir, "documents").select("doc_id", form.alias("form"), ids.parse_id_column(form).cast("long").alias("id"))


MARKUP = (
    ("link", "[[Link|shown]] and [[plain]]", "shown and plain"),
    ("template", "{{infobox|a=b}} text", "text"),
    ("site", "[http://x.org site]", "site"),
)


def wikitext_cases(spark, sf_dir):
    rows = spark.createDataFrame([r[:2] for r in MARKUP], "name string, markup string")
    return rows.select("name", wikitext.strip_wikitext_column(F.col("markup")).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        read_beir_json, read_beir_parquet, read_beir_qrels, read_beir_queries, read_cisi_docs, read_cisi_queries, read_cisi_qrels, parse_id_numbers,
        wikitext_cases,
    )
}

_DOCS = "select doc_id, coalesce(source, '') || ' ' || coalesce(text, '') as text from documents"
_WIKI = ", ".join(f"('{name}', '{text}')" for name, _, text in MARKUP)
ORACLES = {
    "read_beir_json": _DOCS,
    "read_beir_parquet": _DOCS,
    "read_beir_qrels": """select item_id as query_id, item_id as doc_id, (case when item_id = 1 then 2 else item_id % 3 end)::double as relevance
      from benchmark where item_id % 3 > 0""",
    "read_beir_queries": "select item_id as query_id, text from benchmark where item_id % 3 > 0",
    "read_cisi_docs": """select item_id as doc_id,
      replace(split_part(text, ' ', 1) || ' Some One Other ' || substr(text, instr(text, ' ') + 1) || ' last line', chr(10), ' ') as text from benchmark""",
    "read_cisi_queries": "select item_id as query_id, replace(text, chr(10), ' ') || ' second line ' as text from benchmark",
    "read_cisi_qrels": "select item_id as query_id, item_id * 3 as doc_id, 1::double as relevance from benchmark",
    "parse_id_numbers": """select doc_id, case doc_id % 3 when 0 then doc_id::varchar when 1 then '+' || doc_id else 'MED-' || doc_id end as form, doc_id as id
      from documents""",
    "wikitext_cases": f"select * from (values {_WIKI}) as t(name, text)",
}
