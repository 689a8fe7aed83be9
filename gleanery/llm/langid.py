"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.common import crc_remainder, texts

DIMENSIONS = 1024
_KEPT = 12_000


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=4096)
def letter_vector(code: int) -> np.ndarray:
    """The random vector of +1 and -1 of a letter (0: a gap between words)."""
    return np.random.default_rng(code).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)


def gram_vector(a: int, b: int, c: int) -> np.ndarray:
    """Letters bound by position: the first rotated twice, the second once, and multiplied."""
    return np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)


class Encoder:
    """Turns texts into bundled trigram vectors; keeps the vectors of the trigrams it has met."""

    def __init__(self) -> None:
        self._row: dict[int, int] = {}
        self._vectors = np.zeros((256, DIMENSIONS), np.float32)

    def _rows(self, grams: list[int]) -> list[int]:
        if len(self._row) + len(grams) > _KEPT:
            self._row.clear()
        rows = []
        for g in grams:
            row = self._row.get(g)
            if row is None:
                row = self._row[g] = len(self._row)
                if row >= len(self._vectors):
                    self._vectors = np.concatenate([self._vectors, np.zeros_like(self._vectors)])
                self._vectors[row] = gram_vector(g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF)
            rows.append(row)
        return rows

    def bundle(self, found: list[str]) -> np.ndarray:
        """One row per text: the sum of its trigram vectors, letters lower-cased and each run of
        other characters (and each end of the text) a gap; zero where there is no letter."""
        codes, owner = [], []
        for k, text in enumerate(found):
            at = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
            at = np.where(_is_letter()[at], at, 0).astype(np.int64)
            at = np.concatenate([[0], at, [0]])
            at = at[np.concatenate([[True], (at[1:] != 0) | (at[:-1] != 0)])]
            if len(at) > 2:
                codes.append(at)
                owner.append(np.full(len(at) - 2, k))
        if not codes:
            return np.zeros((len(found), DIMENSIONS), np.float32)
        grams = np.concatenate([c[:-2] << 42 | c[1:-1] << 21 | c[2:] for c in codes])
        distinct, which = np.unique(grams, return_inverse=True)
        out = np.zeros((len(found), DIMENSIONS), np.float32)
        docs = np.concatenate(owner)
        for low in range(0, len(distinct), _KEPT // 2):
            part = distinct[low : low + _KEPT // 2]
            mine = (which >= low) & (which < low + len(part))
            counts = np.bincount(docs[mine] * len(part) + which[mine] - low, minlength=len(found) * len(part))
            out += counts.reshape(len(found), len(part)).astype(np.float32) @ self._vectors_of(part.tolist())
        return out

    def _vectors_of(self, grams: list[int]) -> np.ndarray:
        rows = self._rows(grams)
        return self._vectors[rows]


def _chunks(batch: pa.RecordBatch, name: str, rows: int = 64, size: int = 400_000) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch, null as empty and bytes that are not UTF-8 replaced, in pieces of bounded length, with their offsets."""
    for low in range(0, batch.num_rows, rows):
        start, piece, total = low, [], 0
        for k, raw in enumerate(texts(batch.slice(low, rows), name), low):
            text = raw.decode("utf-8", "replace")
            if piece and total + len(text) > size:
                yield start, piece
                start, piece, total = k, [], 0
            piece.append(text)
            total += len(text)
        if piece:
            yield start, piece


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def learn_prototypes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    held_out: int = 2,
    max_per_language: int = 3000,
) -> dict[str, np.ndarray]:
    """Per language the sum of its documents' unit vectors.

    Learnt from the rows with a language and an id whose crc32 (as text) modulo ``folds`` is not
    ``held_out``; of each language the ``max_per_language`` ids with the smallest hash. The sums
    are made by the executors; the driver gets one vector per language. Null and empty texts add
    nothing; a language without a letter in its texts is not learnt.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "i"))
    learnt = (
        docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
        .where("i is not null and lang is not null")
        .where(crc_remainder(F.col("i"), folds) != held_out)
        .withColumn("h", F.xxhash64("i"))
    )
    # where each language's sample ends: one row per language, as there is one prototype each
    ends = (
        learnt.select("lang", "h", "i")
        .withColumn("rank", rank)
        .where(F.col("rank") <= max_per_language)
        .groupBy(F.col("lang").alias("_lang"))
        .agg(F.max(F.struct("h", "i")).alias("end"))
    )
    sample = learnt.join(F.broadcast(ends), learnt["lang"] == ends["_lang"]).where(F.struct("h", "i") <= F.col("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(), {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, piece in _chunks(batch, "t"):
                for lang, vector in zip(langs[start:], _unit(encoder.bundle(piece))):
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([list(np.round(v, 6)) for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"]
        )

    partial = sample.select("t", "lang").mapInArrow(run, "lang string, v array<double>")
    # whole numbers, so that the order of addition doesn't matter
    summed = (
        partial.select("lang", F.posexplode("v"))
        .groupBy("lang", "pos")
        .agg(F.sum(F.round(F.col("col") * 1e6).cast("long")).alias("v"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("v"))  # DIMENSIONS entries
        .collect()
    )
    found = {r.lang: np.array([x.v for x in r.v], np.float64) for r in summed}
    return {k: _unit(v).astype(np.float32) for k, v in sorted(found.items()) if np.any(v)}


def predict_language(
    docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, lang_pred, score): the language whose prototype has the largest cosine, the first by
    name of equals; the score is (1 + cosine) / 2. Texts that are null or have no letter, and all
    texts if no language was learnt, are ``und`` with score 0. Other columns are not read."""
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(-1, DIMENSIONS).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            langs, scores = [], []
            for _, piece in _chunks(batch, "t"):
                vectors = encoder.bundle(piece)
                cosine = _unit(vectors) @ matrix
                for vector, row in zip(vectors, cosine):
                    if names and vector.any():
                        best = int(np.argmax(row))
                        langs.append(names[best])
                        scores.append(min(1.0, max(0.0, (1.0 + float(row[best])) / 2)))
                    else:
                        langs.append("und")
                        scores.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema['i'].dataType.simpleString()}, lang_pred string, score double")
