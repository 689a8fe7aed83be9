"""Exact nearest neighbours over embedding columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, in doubles."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def nearest(vectors: DataFrame, query: list[float], limit: int = 10, id_col: str = "vec_id") -> DataFrame:
    """(id, distance) of the ``limit`` nearest to one vector, by distance and id; a top-k per
    partition, then one of those. Embeddings that are null, hold a null or have another width
    than the query are near nothing."""
    point = F.array(*(F.lit(float(x)) for x in query))
    measured = vectors.where(F.size("embedding") == len(query)).select(id_col, F.round(l2(F.col("embedding"), point), 6).alias("distance"))
    return measured.where("distance is not null").orderBy("distance", id_col).limit(limit)


def nearest_batch(vectors: DataFrame, queries: DataFrame, limit: int = 10, id_col: str = "vec_id", block_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, rank, id, distance): the ``limit`` nearest of every query (query_id, embedding).

    The queries are taken to the executors in blocks of ``block_bytes`` at most, one scan of the
    vectors for each block (so one for half a million queries of 16 numbers); each task keeps the
    best of its rows for each query, so a query sends a limit's worth of rows per partition, and
    all vectors are compared with all queries. Embeddings that are null, hold a null or have
    another width than the query are near nothing, and queries without an embedding have no row.
    """
    if limit < 1:
        raise ValueError("limit is one at least")
    full = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    source = vectors.where(full).select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = (queries.schema["query_id"].dataType.simpleString(), source.schema["id"].dataType.simpleString())
    name_kind = to_arrow_type(queries.schema["query_id"].dataType)
    parts = []
    asked = queries.where(full).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    for width in sorted(r[0] for r in asked.select(F.size("embedding")).distinct().collect()):
        rows = asked.where(F.size("embedding") == width).toLocalIterator()
        while taken := list(islice(rows, max(1, block_bytes // (8 * max(1, width))))):
            matrix = vectors.sparkSession.sparkContext.broadcast(np.array([r.embedding for r in taken], np.float64).reshape(len(taken), width))
            best = _best_of([r.query_id for r in taken], name_kind, matrix, limit)
            parts.append(source.where(F.size("embedding") == width).mapInArrow(best, f"query_id {kinds[0]}, id {kinds[1]}, distance double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"query_id {kinds[0]}, rank int, {id_col} {kinds[1]}, distance double")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "distance")


def _best_of(names: list, name_kind: pa.DataType, shared, limit: int, tile: int = 64) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        best: list[list] = [[] for _ in names]
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            ids = np.array(batch.column(0).to_pylist(), object)
            points = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), matrix.shape[1])
            for low in range(0, len(points), 512):
                part = points[low : low + 512]
                for first in range(0, len(matrix), tile):
                    gaps = np.round(np.sqrt(((part[None] - matrix[first : first + tile, None]) ** 2).sum(-1)), 6)
                    edges = np.partition(gaps, min(limit, len(part)) - 1, axis=1)[:, min(limit, len(part)) - 1]
                    for q, row in enumerate(gaps, first):
                        edge = edges[q - first]
                        if len(best[q]) == limit:
                            edge = min(edge, best[q][-1][0])
                        near = np.nonzero(row <= edge)[0]
                        if len(near):
                            best[q] = sorted(best[q] + [(float(row[k]), ids[low + k]) for k in near])[:limit]
        rows = [(names[q], i, d) for q, found in enumerate(best) for d, i in found]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], name_kind), pa.array(columns[1], kind), pa.array(columns[2], pa.float64())], ["query_id", "id", "distance"])

    return run


def embed(docs: DataFrame, model: Callable[[list[str]], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, embedding) by a model that turns texts into rows of numbers, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = model(frame["t"].fillna("").tolist())
            yield pd.DataFrame({id_col: frame["i"], "embedding": [list(map(float, x)) for x in found]})

    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return source.mapInPandas(run, f"{id_col} {source.schema['i'].dataType.simpleString()}, embedding array<float>")
