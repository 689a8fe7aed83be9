"""Search engines: index documents, then search them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import evaluation, index, search, vectors


class NotIndexedError(RuntimeError):
    """A search before anything was indexed."""


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def directory_size(spark: SparkSession, path: str) -> int:
    """Bytes below a folder, on any file system."""
    fs, target = _fs_path(spark, path)
    return fs.getContentSummary(target).getLength()


def engine_dir(parent: str, name: str) -> str:
    return f"{parent.rstrip('/')}/index_{name}"


class LexicalEngine:
    """Ranked search over an inverted index in memory (cached tables) or on disk (Parquet)."""

    analyser = "alphabetic"
    scorer = "bm25"
    name = "bm25"

    def __init__(self, spark: SparkSession, path: str | None = None, max_segment_docs: int | None = index.DEFAULT_SEGMENT_DOCS, stats: str = "global") -> None:
        self.spark, self.path, self.max_segment_docs, self.stats = spark, path, max_segment_docs, stats
        self.index: index.Index | None = None

    @classmethod
    def create_in_memory(cls, spark: SparkSession, **options) -> LexicalEngine:
        return cls(spark, None, None, **options)

    @classmethod
    def create_on_disk(cls, spark: SparkSession, path: str, **options) -> LexicalEngine:
        """A new index at ``path``; one that is there already is deleted."""
        fs, target = _fs_path(spark, path)
        fs.delete(target, True)
        return cls(spark, path, **options)

    @classmethod
    def open_from_disk(cls, spark: SparkSession, path: str, **options) -> LexicalEngine:
        engine = cls(spark, path, **options)
        engine.index = index.Index.open(spark, path)
        return engine

    def index_docs(self, docs: DataFrame) -> None:
        """Index (doc_id, text). On disk the documents become further segments of the index; in
        memory they replace what was there."""
        built = index.build_index(docs, self.max_segment_docs, self.analyser)
        if self.path is None:
            self.index = built.cache()
        else:
            built.write(self.path, "overwrite" if self.index is None else "append")
            self.index = index.Index.open(self.spark, self.path)

    def search_batch(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score) of all queries in one job."""
        if self.index is None:
            raise NotIndexedError("index should be built or opened before searching")
        return search.search_index(self.index, queries, limit, self.scorer, self.stats, analyser=self.analyser)

    def search(self, query: str, limit: int = 10) -> list[int]:
        """The ids of the best documents, in order."""
        one = self.spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("text"))
        return [int(r.doc_id) for r in self.search_batch(one, limit).orderBy("rank").collect()]


class AlphanumericEngine(LexicalEngine):
    """The same with an analyser that splits at everything but letters and digits."""

    analyser = "alphanumeric"
    name = "alnum"


class VectorEngine:
    """Exact nearest neighbours of embeddings that a model gives, or that the documents bring."""

    name = "vector"

    def __init__(self, spark: SparkSession, path: str | None = None, model: Callable | None = None) -> None:
        self.spark, self.path, self.model = spark, path, model
        self.table: DataFrame | None = None

    @classmethod
    def create_in_memory(cls, spark: SparkSession, **options) -> VectorEngine:
        return cls(spark, **options)

    @classmethod
    def create_on_disk(cls, spark: SparkSession, path: str, **options) -> VectorEngine:
        fs, target = _fs_path(spark, path)
        fs.delete(target, True)
        return cls(spark, path, **options)

    @classmethod
    def open_from_disk(cls, spark: SparkSession, path: str, **options) -> VectorEngine:
        engine = cls(spark, path, **options)
        engine.table = spark.read.parquet(path)
        return engine

    def index_docs(self, docs: DataFrame) -> None:
        """Index (doc_id, embedding), or (doc_id, text) with a model; a repeated id is an error. On disk
        the documents are added to those of the index; in memory they replace what was there."""
        if "embedding" in docs.columns:
            found = docs.select("doc_id", "embedding")
        elif self.model is not None:
            found = vectors.embed(docs, self.model)
        else:
            raise ValueError("documents need an embedding column, or the engine a model")
        if self.path is not None and self.table is not None:
            ids = self.table.select("doc_id").unionByName(found.select("doc_id"))
        else:
            ids = found
        if ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
            raise ValueError("document ids should be unique")
        if self.path is None:
            self.table = found.cache()
        else:
            found.write.mode("overwrite" if self.table is None else "append").parquet(self.path)
            self.table = self.spark.read.parquet(self.path)

    def search_vector(self, query: list[float], limit: int = 10) -> list[int]:
        if self.table is None:
            raise NotIndexedError("index should be built or opened before searching")
        return [r.doc_id for r in vectors.nearest(self.table, query, limit, "doc_id").collect()]

    def search(self, query: str, limit: int = 10) -> list[int]:
        if self.model is None:
            raise ValueError("searching by text needs a model")
        return self.search_vector(list(map(float, self.model([query])[0])), limit)

    def search_batch(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        if self.table is None:
            raise NotIndexedError("index should be built or opened before searching")
        if "embedding" not in queries.columns:
            if self.model is None:
                raise ValueError("queries need an embedding column, or the engine a model")
            queries = vectors.embed(queries, self.model, "query_id")
        return vectors.nearest_batch(self.table, queries, limit, "doc_id")


ENGINES = {e.name: e for e in (LexicalEngine, AlphanumericEngine, VectorEngine)}


def engine(name: str):
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r}; there are {', '.join(ENGINES)}")
    return ENGINES[name]


def evaluate(searcher, queries: DataFrame, qrels: DataFrame, limit: int = 10) -> DataFrame:
    """One row of search quality over all queries, which are searched in one job."""
    found = searcher.search_batch(queries, limit)
    return evaluation.summary(evaluation.query_quality(found, qrels, queries, limit))
