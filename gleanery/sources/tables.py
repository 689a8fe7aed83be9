"""Readers of document collections, queries and relevance judgments."""

from __future__ import annotations

import gzip
import os
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gleanery.functions.ids import parse_id_column
from gleanery.functions.wikitext import strip_wikitext_column


@dataclass
class Dataset:
    """docs: doc_id, text; queries: query_id, text; qrels: query_id, doc_id, relevance. Collections
    without queries raise NotImplementedError when asked for them."""

    docs: DataFrame
    _queries: DataFrame | None = None
    _qrels: DataFrame | None = None

    @property
    def queries(self) -> DataFrame:
        if self._queries is None:
            raise NotImplementedError("this collection has no queries")
        return self._queries

    @property
    def qrels(self) -> DataFrame:
        if self._qrels is None:
            raise NotImplementedError("this collection has no judgments")
        return self._qrels


def required(name: str) -> Column:
    """The column, or an error where it is null."""
    problem = F.raise_error(F.lit(f"field {name!r} should be a string")).cast("string")
    return F.when(F.col(name).isNull(), problem).otherwise(F.col(name))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a text file, compressed or not by its extension, which it must have."""
    if not os.path.splitext(path)[1]:
        raise ValueError(f"the file should have an extension: {path}")
    if path.endswith(".gzip"):  # no codec goes by this suffix
        content = spark.read.format("binaryFile").load(path).select(_unzipped("content").alias("t"))
        lines = content.select(F.explode(F.split("t", "\r?\n")).alias("value"))
        return lines.where(F.col("value") != "")
    return spark.read.text(path)


@F.pandas_udf(T.StringType())
def _unzipped(content: pd.Series) -> pd.Series:
    return content.map(lambda x: gzip.decompress(x).decode("utf-8"))


def beir_docs_json(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): title, a space and text of every line; a bad line or a missing field is an error."""
    schema = "_id string, title string, text string"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.select(parse_id_column(required("_id")).alias("doc_id"), F.concat(required("title"), F.lit(" "), required("text")).alias("text"))


def _only(df: DataFrame, allowed: set[str]) -> DataFrame:
    unknown = set(df.columns) - allowed
    if unknown:
        raise ValueError(f"unexpected columns: {', '.join(sorted(unknown))}")
    return df


def beir_docs_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    rows = _only(spark.read.parquet(*paths), {"_id", "title", "text"})
    return rows.select(parse_id_column(required("_id")).alias("doc_id"), F.concat(required("title"), F.lit(" "), required("text")).alias("text"))


def _first_per_id(rows: DataFrame) -> DataFrame:
    """Of queries that share an id the first in file order."""
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    return numbered.groupBy("query_id").agg(F.min_by("text", "_at").alias("text"))


def beir_queries_json(spark: SparkSession, path: str, qrels: DataFrame) -> DataFrame:
    """(query_id, text) of the queries that have a judgment."""
    rows = spark.read.schema("_id string, text string").option("mode", "FAILFAST").json(path)
    found = rows.select(parse_id_column(required("_id")).alias("query_id"), required("text").alias("text"))
    return _first_per_id(found).join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def beir_queries_parquet(spark: SparkSession, qrels: DataFrame, *paths: str) -> DataFrame:
    rows = _only(spark.read.parquet(*paths), {"_id", "title", "text"})
    found = rows.select(parse_id_column(required("_id")).alias("query_id"), required("text").alias("text"))
    return _first_per_id(found).join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def beir_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, relevance): header left out, relevance above zero, the last of repeats. A line
    with fewer than three fields, or whose relevance is no number, is an error."""
    rows = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).withColumn("p", F.split(F.trim("value"), r"\s+"))
    rows = rows.where((F.col("_at") > 0) & (F.trim("value") != ""))
    grade = F.get("p", F.lit(2)).try_cast("double")
    problem = F.raise_error(F.concat(F.lit("a judgment should have a query, a document and a number: "), F.col("value"))).cast("double")
    found = rows.select(parse_id_column(F.col("p")[0]).alias("query_id"), parse_id_column(F.col("p")[1]).alias("doc_id"), F.coalesce(grade, problem).alias("relevance"), "_at")
    return found.where("relevance > 0").groupBy("query_id", "doc_id").agg(F.max_by("relevance", "_at").alias("relevance"))


def beir(spark: SparkSession, folder: str, parquet: bool = False) -> Dataset:
    qrels = beir_qrels(spark, f"{folder}/qrels/test.tsv")
    if parquet:
        return Dataset(beir_docs_parquet(spark, f"{folder}/corpus"), beir_queries_parquet(spark, qrels, f"{folder}/queries"), qrels)
    return Dataset(beir_docs_json(spark, f"{folder}/corpus.jsonl"), beir_queries_json(spark, f"{folder}/queries.jsonl", qrels), qrels)


# ---------------------------------------------------------------- CISI
def _records(spark: SparkSession, path: str) -> DataFrame:
    """(at, id, sections): the records of a file of dotted sections; each section as (name, lines)."""
    rows = spark.read.option("lineSep", "\n.I ").text(path).withColumn("at", F.monotonically_increasing_id())
    body = F.regexp_replace("value", r"^\.I ", "")
    rows = rows.select("at", F.trim(F.regexp_extract(body, r"^[ ]*([0-9]+)", 1)).alias("n"), F.regexp_replace(body, r"^[^\n]*\n?", "").alias("body"))
    bad = F.raise_error(F.lit("id should be a whole number")).cast("long")
    return rows.select("at", F.when(F.col("n") == "", bad).otherwise(F.col("n").cast("long")).alias("id"), F.split("body", r"(?m)^(?=\.[A-Z])").alias("sections"))


def _section_lines(section: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(section, r"^\.[A-Z][^\n]*\n?", ""), r"\r?\n$", ""), "\n")


def cisi_docs(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """(doc_id, text): title, author and abstract lines of every record, joined by spaces.

    ``compat``: joined without anything, and without the last record, as the collection's published
    figures were measured.
    """
    rows = _records(spark, path)
    wanted = F.filter("sections", lambda s: s.rlike(r"^\.[TAW]"))
    lines = F.flatten(F.transform(wanted, _section_lines))
    found = rows.select("at", F.col("id").alias("doc_id"), F.array_join(lines, "" if compat else " ").alias("text"))
    if compat:
        found = found.join(F.broadcast(found.agg(F.max("at").alias("_last"))), F.col("at") != F.col("_last"))  # one row
    return found.select("doc_id", "text")


def cisi_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text): the lines of the text section, a space behind each; the last of repeats."""
    rows = _records(spark, path)
    wanted = F.filter("sections", lambda s: s.rlike(r"^\.W"))
    text = F.array_join(F.transform(F.flatten(F.transform(wanted, _section_lines)), lambda x: F.concat(x, F.lit(" "))), "")
    return rows.select("at", F.col("id").alias("query_id"), text.alias("text")).groupBy("query_id").agg(F.max_by("text", "at").alias("text"))


def cisi_qrels(spark: SparkSession, path: str, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, relevance 1.0); a judgment of a query that is not there is an error."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    found = rows.select(p[0].cast("long").alias("query_id"), p[1].cast("long").alias("doc_id"), F.lit(1.0).alias("relevance")).distinct()
    if queries is None:
        return found
    known = queries.select("query_id", F.lit(True).alias("_known"))
    problem = F.raise_error(F.lit("query should exist")).cast("long")
    checked = found.join(known, "query_id", "left").withColumn("query_id", F.when(F.col("_known"), F.col("query_id")).otherwise(problem))
    return checked.select("query_id", "doc_id", "relevance")


def cisi(spark: SparkSession, folder: str, compat: bool = False) -> Dataset:
    queries = cisi_queries(spark, f"{folder}/CISI.QRY")
    return Dataset(cisi_docs(spark, f"{folder}/CISI.ALL", compat), queries, cisi_qrels(spark, f"{folder}/CISI.REL", queries))


# ---------------------------------------------------------------- encyclopedias
def json_docs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): the body of every line, ids by line from 0; a bad line is an error."""
    rows = spark.read.schema("url string, title string, body string").option("mode", "FAILFAST").json(path)
    placed = rows.select(required("body").alias("text"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    counts = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}  # one row a file split
    starts, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    if not starts:
        return placed.select(F.lit(0).cast("long").alias("doc_id"), "text")
    offset = F.element_at(F.array(*map(F.lit, starts)), F.col("part") + 1)
    return placed.select((offset + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("doc_id"), "text")


PAGE = "title string, ns string, revision array<struct<timestamp: string, text: string>>"


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, revisions): articles (namespace 0) of a dump, compressed or not, as plain text, revisions
    without text left out and the others by time."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path).where(F.col("ns") == "0")
    pages = pages.withColumn("page", F.monotonically_increasing_id())
    rows = pages.select("page", "title", F.explode("revision").alias("r")).select("page", "title", "r.timestamp", strip_wikitext_column(F.coalesce("r.text", F.lit(""))).alias("text"))
    found = rows.where(F.col("text") != "").groupBy("page", "title").agg(F.sort_array(F.collect_list(F.struct("timestamp", "text"))).alias("revisions"))
    return found.select("page", "title", "revisions")


def wiki_docs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): the latest text of every article, numbered from 0 in the order of the dump."""
    from gleanery.operators.numbering import with_row_number

    pages = wiki_pages(spark, path).select("page", F.element_at("revisions", -1)["text"].alias("text"))
    return with_row_number(pages, "page", "doc_id").select("doc_id", "text")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def dataset(spark: SparkSession, name: str, folder: str) -> Dataset:
    """A collection by name: cisi, enwiki, simplewiki, enwiki_json, nfcorpus, scifact, beir_*; the
    files lie in ``folder``."""
    if name == "cisi":
        return cisi(spark, folder)
    if name in ("enwiki", "simplewiki"):
        return Dataset(wiki_docs(spark, folder))
    if name == "enwiki_json":
        return Dataset(json_docs(spark, folder))
    if name in ("nfcorpus", "scifact") or name.startswith("beir_"):
        return beir(spark, folder, parquet=not _exists(spark, f"{folder}/corpus.jsonl"))
    raise ValueError(f"unknown dataset {name!r}")


def nth_query(queries: DataFrame, n: int = 10) -> DataFrame:
    """The query at place ``n`` from 0, by id."""
    return queries.withColumn("_n", F.row_number().over(Window.orderBy("query_id"))).where(F.col("_n") == n + 1).drop("_n")
