"""A quality classifier over whole texts: surface measures scored by a boosted additive model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import crc_remainder, slices, texts
from gleanery.llm.gam import Gam, fit

_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_ENDS = b".,;:?"
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c not in b".,;:?'-")
FEATURES = (
    "log_words", "word_length", "upper", "marks", "digits", "distinct", "commonest",
    "again", "bare", "short", "lines", "line_repeats", "ends",
)


def measures(text: bytes) -> list[float]:
    """One number per entry of FEATURES; all zero for a text without a word."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    without = lambda chars: (size - len(text.translate(None, chars))) / size
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    bare = sum(k for w, k in counts.items() if not w.translate(None, _MARKS + _ENDS + _DIGITS))
    return [
        float(np.log1p(n)),
        size / n,
        without(_UPPER),
        without(_MARKS),
        without(_DIGITS),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        bare / n,
        sum(k for w, k in counts.items() if len(w) < 4) / n,
        len(lines) / n,
        1.0 - len(set(lines)) / len(lines),
        without(_ENDS),
    ]


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array([measures(t) for t in texts(batch, name)], np.float64).reshape(-1, len(FEATURES))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    max_rows: int = 20000,
) -> Gam:
    """A model of ``label_col`` from at most ``max_rows`` labelled documents.

    Of the labelled ids whose crc32 (as text) modulo ``folds`` is not 0, the ``max_rows`` with
    the smallest hash are learnt from; rows with a null id or label are not, and where an id is
    labelled repeatedly the majority counts (a draw: 1), and of documents that share an id the
    smallest text is learnt from. Only this sample's measures, a row per id, come to the driver. No usable label gives a constant score of 0.5.
    """
    label = (
        labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("double").alias("y"))
        .where("i is not null and y is not null")
        .where(crc_remainder(F.col("i"), folds) != 0)
        .groupBy("i")
        .agg((F.avg("y") >= 0.5).alias("y"))
        .orderBy(F.xxhash64("i"), "i")
        .limit(max_rows)
    )
    sample = (
        docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
        .join(F.broadcast(label), "i")  # max_rows rows at most
        .groupBy("i")
        .agg(F.min("t").alias("t"), F.first("y").cast("int").alias("y"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = _matrix(batch, "t")
            columns = [pa.array(x[:, k]) for k in range(x.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], ["i", *FEATURES, "y"])

    kind = sample.schema["i"].dataType.simpleString()
    rows = sample.mapInArrow(run, f"i {kind}, " + ", ".join(f"{f} double" for f in FEATURES) + ", y int").toPandas()
    rows = rows.sort_values(["i", *FEATURES])
    return fit(rows[list(FEATURES)].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score): probability of label 1 of every row; null, empty and blank texts score as
    a text whose measures are all zero. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch, "t")))], [id_col, "score"])

    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema['i'].dataType.simpleString()}, score double")


def keep_quality(docs: DataFrame, model: Gam, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(model.score(_matrix(batch, text_col)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def scorer(model: Gam) -> Callable[[list[bytes]], np.ndarray]:
    """The scores of some texts, as a function for the tasks of other operators."""
    return lambda found: model.score(np.array([measures(t) for t in found], np.float64).reshape(-1, len(FEATURES)))


def predicted(score: Column, threshold: float = 0.3) -> Column:
    return (score >= threshold).cast("int")
