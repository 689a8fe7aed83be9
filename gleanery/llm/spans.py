"""Substring deduplication over sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import materialize, same, strings, texts

#: The words of a run of the query. Shorter runs ("Yes. No.") recur between unrelated texts.
LEAST_WORDS = 16
_BREAK = re.compile(
    rb"[.!?][ \t-\r]+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xe0\xa5\xa4)[ \t-\r]*|[ \t\x0b-\r]*\n[ \t-\r]*"  # 。 ！ ？ ।
)
_CLAUSE = re.compile(rb"[,;:][ \t-\r]+")


def _cut(text: bytes, at: re.Pattern) -> list[bytes]:
    ends = [m.end() for m in at.finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)]) if b > a]


def pieces(text: bytes, long_words: int = 30) -> list[bytes]:
    """The text in sentences, each with the white space behind it: cut behind full stops, exclamation
    and question marks that white space follows, behind those of scripts without spaces, and at
    line ends. A sentence of ``long_words`` words and more counts as several, cut behind commas,
    semicolons and colons that white space follows."""
    out = []
    for piece in _cut(text, _BREAK):
        if piece.count(b" ") + 1 >= long_words and len(piece.split()) >= long_words:
            out += _cut(piece, _CLAUSE)
        else:
            out.append(piece)
    return out


def words_in(sentence: bytes) -> int:
    """Words by white space, but one per twelve bytes at least, for scripts without spaces."""
    return max(len(sentence.split()), len(sentence) // 12)


def runs(counts: list[int], least_words: int, least_sentences: int = 2) -> np.ndarray:
    """Rows (start, end), in order: for every sentence the shortest run that begins with it, and the
    shortest that ends with it, of ``least_sentences`` and more sentences with ``least_words`` words
    and more. Every longer run is a union of such ones."""
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    n = len(counts)
    at = np.arange(n)
    ends = np.maximum(np.searchsorted(total, total[:n] + least_words), at + least_sentences)
    starts = np.minimum(np.searchsorted(total, total[1:] - least_words, "right") - 1, at + 1 - least_sentences)
    ahead, back = ends <= n, starts >= 0
    both = np.concatenate([at[ahead] * (n + 1) + ends[ahead], starts[back] * (n + 1) + at[back] + 1])
    return np.stack(np.divmod(np.unique(both), n + 1), axis=1)


def _again(ids: pa.Array | None, hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Whether each run repeats an earlier one of the batch, or of its document if the documents have
    no ids that can be ordered here. ids, hashes: of the documents; docs: the runs' documents."""
    ranks = pc.rank(ids, null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64) if ids is not None else np.arange(len(hashes))
    rank, x = ranks[docs], hashes[docs]
    keys = [digests[:, 0], digests[:, 1], *([rank] if ids is None else [])]
    order = np.lexsort((starts, x, rank, *reversed(keys)))
    changes = lambda columns: np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)])
    number = np.cumsum(changes([*keys, rank, x, starts]))  # of the place, one for rows that are alike
    first = number[np.maximum.accumulate(np.where(changes(keys), np.arange(len(order)), 0))]
    out = np.zeros(len(order), bool)
    out[order] = number != first
    return out


def repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 0, least_sentences: int = 2, long_words: int = 30
) -> DataFrame:
    """(i, x, places): per document (id and hash of the text) that has some, the runs that repeat an
    earlier one, as (start, end) among its sentences that are not blank.

    Every run of ``least_sentences`` consecutive sentences and more with ``least_words`` words is
    hashed to 128 bits (:func:`runs`); equal hashes are copies: among 10 ** 12 runs two different
    ones agree with a probability under 10 ** -14. The first by id (null ids last), text hash and
    place is the original. Runs are hashed once and shuffled once, to where those of a hash are
    ranked. Those that repeat one of their own batch need no rank and go elsewhere, by document: a
    passage in very many documents, or very often in one, makes a row per batch for its hash; per
    document, where ids are of a type other than integers, decimals, strings and dates.
    """
    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).select(
        "i", F.coalesce(F.xxhash64("t"), F.lit(0)).alias("x"), "t"
    )
    kind = source.schema["i"].dataType.simpleString()
    #: Other ids Arrow may order otherwise than Spark.
    ordered = kind in ("tinyint", "smallint", "int", "bigint", "string", "date") or kind.startswith("decimal")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, join = xxhash.xxh3_128_digest, b"\x1f".join
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                places, hashes = [], []
                for text in texts(batch, "t"):
                    found = [u for u in (p.strip() for p in pieces(text, long_words)) if u]
                    places.append(runs([words_in(u) for u in found], least_words, least_sentences))
                    hashes += [digest(join(found[a:b])) for a, b in places[-1].tolist()]
                if not hashes:
                    continue
                rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
                numbers = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                at = np.concatenate(places).astype(np.int32)
                x = batch.column(1).to_numpy()
                again = _again(batch.column(0) if ordered else None, x, rows, at[:, 0], numbers)
                key = np.where(again[:, None], np.stack([x[rows] ^ rows, rows], axis=1), numbers)  # the row, since texts have copies
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(again), batch.column(0).take(pa.array(rows)), pa.array(x[rows]), pa.array(at[:, 0]), pa.array(at[:, 1])],
                    ["h", "g", "again", "i", "x", "start", "end"],
                )

    every = source.mapInArrow(emit, f"h long, g long, again boolean, i {kind}, x long, start int, end int")
    place = Window.partitionBy("h", "g", "again").orderBy(F.col("i").asc_nulls_last(), "x", "start")
    copies = every.withColumn("n", F.rank().over(place)).where("n > 1 or again")  # rows of one place share a rank
    return copies.groupBy("i", "x").agg(F.collect_set(F.struct("start", "end")).alias("places"))  # one text's runs


def drop_repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 0, least_sentences: int = 2, long_words: int = 30
) -> DataFrame:
    """(id_col, text_col, n_sentences, n_removed): one row per row of ``docs``, sentences that any
    repeating run covers (:func:`repeated_runs`) taken out with the white space behind them.

    Without a floor (``least_words`` 0) that is every repeated run of two sentences and more.
    Texts without such a run stay as they are, byte for byte. Null texts stay null and empty and
    blank ones as they are, with no sentences; rows that share id and text count as one document
    and stay alike, while a run that two rows of one id share goes from the one with the larger
    text hash; an empty table gives an empty table; other columns are not read.
    """
    flags = materialize(repeated_runs(docs, id_col, text_col, least_words, least_sentences, long_words), "flags")
    flags = flags.select(F.col("i").alias("_i"), F.col("x").alias("_x"), "places")
    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).select(
        "i", F.coalesce(F.xxhash64("t"), F.lit(0)).alias("x"), "t"
    )
    marked = source.join(flags, same(F.col("i"), F.col("_i")) & (F.col("x") == F.col("_x")), "left").select("i", "t", "places")

    def clean(text: bytes, places: list | None) -> tuple[bytes, int, int]:
        found = pieces(text, long_words)
        full = [k for k, p in enumerate(found) if p.strip()]
        if not places:
            return text, len(full), 0
        gone = {full[k] for p in places for k in range(p["start"], p["end"])}
        return b"".join(p for k, p in enumerate(found) if k not in gone), len(full), len(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                null = batch.column(1).is_null().to_pylist()
                rows = [clean(t, p) for t, p in zip(texts(batch, "t"), batch.column(2).to_pylist())]
                kept = strings([None if n else r[0] for n, r in zip(null, rows)])
                counts = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), kept, *counts], [id_col, text_col, "n_sentences", "n_removed"])

    kind = source.schema["i"].dataType.simpleString()
    return marked.mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string, n_sentences long, n_removed long")
