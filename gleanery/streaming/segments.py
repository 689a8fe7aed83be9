"""Incremental indexing: every micro-batch of a document stream becomes segments of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators.index import DEFAULT_SEGMENT_DOCS, TABLES, build_index

STRIDE = 1 << 32


def index_stream(docs: DataFrame, path: str, checkpoint: str, max_segment_docs: int = DEFAULT_SEGMENT_DOCS, trigger: dict | None = None) -> StreamingQuery:
    """Index a stream of (doc_id, text) into the tables below ``path``.

    A batch writes the directories ``batch=<number>`` of each table and replaces them when it is
    run again after a failure, so every document is indexed once. Its segments are numbered
    from the batch's number times STRIDE. :func:`open_stream_index` reads the result.
    """

    def write(batch: DataFrame, number: int) -> None:
        built = build_index(batch, max_segment_docs)
        for name in TABLES:
            table = getattr(built, name).withColumn("segment_id", F.col("segment_id").cast("long") + F.lit(number * STRIDE).cast("long"))
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def open_stream_index(spark, path: str):
    from gleanery.operators.index import Index

    return Index(*(spark.read.parquet(f"{path}/{name}").drop("batch") for name in TABLES))
