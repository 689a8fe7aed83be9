"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.storage import discard, materialize, read_table, shared_dir, spread

__all__ = ["crc_remainder", "discard", "materialize", "same", "shared_dir", "slices", "strings", "table", "texts"]


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The texts of a column as UTF-8, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that few texts are in memory at once."""
    for whole in batches:
        for low in range(0, whole.num_rows, size):
            yield whole.slice(low, size)


def strings(values: list[bytes | None]) -> pa.Array:
    """Texts from their bytes, which need not be valid UTF-8."""
    return pa.array(values, pa.binary()).view(pa.string())


def same(a: Column, b: Column) -> Column:
    """Equality under which nulls match."""
    return a.eqNullSafe(b)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; those of whole texts over all cores, however few files they have."""
    found = read_table(spark, sf_dir, name)
    return spread(found) if name in ("documents", "pages") else found


def crc_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; 0 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus), F.lit(0)).cast("int")
