"""Content-defined chunking and fingerprints that survive shifts."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import slices, texts

LEAST, NORMAL, MOST = 32, 64, 255
_GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_HARD, _EASY = np.uint32(0xFE000000), np.uint32(0xF0000000)  # 7 and 4 bits
_WIDTH = 14  # hexadecimal digits of a chunk in a fingerprint: 12 of the digest, 2 of the length


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of it and those before: h = (h << 1) + gear[byte], in 32 bits.

    A byte's share is shifted out after 32 steps, so the recurrence is five doublings.
    """
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    return h


def cuts(text: bytes) -> list[int]:
    """Chunk ends. Normalised: below NORMAL bytes an end needs seven zero bits, beyond it four; no
    chunk is shorter than LEAST (but the last) or longer than MOST."""
    size = len(text)
    if size <= LEAST:
        return [size] if size else []
    h = gear_hashes(np.frombuffer(text, np.uint8))
    easy = np.nonzero((h & _EASY) == 0)[0]
    hard = (easy[(h[easy] & _HARD) == 0] + 1).tolist()
    easy = (easy + 1).tolist()
    out, start = [], 0
    while size - start > LEAST:
        k = bisect_left(hard, start + LEAST)
        if k < len(hard) and hard[k] < start + NORMAL:
            end = hard[k]
        else:
            k = bisect_left(easy, start + NORMAL)
            end = min(easy[k] if k < len(easy) else size, start + MOST, size)
        out.append(end)
        start = end
    if start < size:
        out.append(size)
    return out


def chunk_set(text: bytes) -> set[str]:
    """The distinct chunks, each as 12 digits of its digest and 2 of its length."""
    digest, start, out = xxhash.xxh64_hexdigest, 0, set()
    for end in cuts(text):
        out.add(f"{digest(text[start:end])[:12]}{end - start:02x}")
        start = end
    return out


def weight(chunks: set[str]) -> int:
    return sum(int(c[12:], 16) for c in chunks)


def containment(a: set[str], b: set[str]) -> float:
    """The share, by length, of a's chunks that b has; 1 if both are empty, 0 if only a is."""
    if not a:
        return 0.0 if b else 1.0
    return weight(a & b) / weight(a)


def as_text(chunks: set[str]) -> str:
    return "".join(sorted(chunks))


def from_text(fingerprint: str) -> set[str]:
    return {fingerprint[i : i + _WIDTH] for i in range(0, len(fingerprint), _WIDTH)}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint): the sorted distinct chunks of every whole text; empty for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [as_text(chunk_set(t)) for t in texts(batch, "t")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], [id_col, "fingerprint"])

    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema['i'].dataType.simpleString()}, fingerprint string")


# ---------------------------------------------------------------- each document beside the next
def _part(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below ``key``, by a tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key > F.lit(bounds[middle]), tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(bounds))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text is the text with its last third (rounded down) of code points replaced by the
    first as many, or all, of the next document's; the next document is that with the next
    smaller id, after the last the first. near_edited and near_next are the shares of the
    document's chunks, by length, that the edited text and the next document have.

    Ids are whole numbers; null ids come after all others. Rows that share an id follow each
    other by text, null as empty. Null texts count as empty; a lone document is its own next; an
    empty table gives an empty result; other columns are not read. A byte that is not UTF-8 counts
    as a code point and stays as it is.

    The rows are split by id ranges and travel once, with their text; the first row of each range
    travels also to the range before it, so no task needs more than its own range in order.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_col).alias("i"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    quantiles = source.agg(F.percentile_approx("k", shares, 10 * max(1000, parts)).alias("q")).first().q or []
    bounds = sorted(set(quantiles))
    placed = source.withColumn("part", F.lit(len(bounds)) - _part(F.col("k"), bounds))
    heads = sorted((r.part, r.k) for r in placed.groupBy("part").agg(F.max("k").alias("k")).collect())  # one row a range
    if not heads:
        heads = [(0, 0)]
    also = [(k, heads[n - 1][0]) for n, (_, k) in enumerate(heads)]  # the head of the first range goes to the last
    head = F.broadcast(spark.createDataFrame(also, "hk long, other int"))
    sent = placed.join(head, placed["k"] == head["hk"], "left").select(
        "i", "k", "t", F.explode(F.when(F.col("other").isNull(), F.array(F.struct(F.col("part").cast("int").alias("p"), F.lit(0).alias("extra")))).otherwise(
            F.array(F.struct(F.col("part").cast("int").alias("p"), F.lit(0).alias("extra")), F.struct(F.col("other").alias("p"), F.lit(1).alias("extra")))
        )).alias("to")
    )
    ordered = (
        sent.select("i", "k", "t", F.col("to.p").alias("p"), F.col("to.extra").alias("extra"))
        .repartitionById(len(bounds) + 1, F.col("p"))
        .sortWithinPartitions("extra", F.col("k").desc(), "t")
        .select("i", "t", "extra")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # id, text, chunks
        ended = False
        kind = None

        def result(one: tuple, following: tuple) -> tuple:
            i, text, chunks = one
            n = len(text)
            third = n // 3
            edited = (text[: n - third] + following[1][:third]).encode("utf-8", "surrogateescape")
            new = chunk_set(edited)
            return i, n, sha256(edited).hexdigest(), as_text(chunks), as_text(new), containment(chunks, new), containment(chunks, following[2])

        for batch in slices(batches, 500):
            kind = batch.schema.field(0).type
            rows = []
            for i, raw, extra in zip(batch.column(0).to_pylist(), texts(batch, "t"), batch.column(2).to_pylist()):
                if ended:
                    continue
                now = (i, raw.decode("utf-8", "surrogateescape"), chunk_set(raw))
                if last is not None:
                    rows.append(result(last, now))
                last = now
                ended = bool(extra)
            columns = list(zip(*rows)) if rows else [[] for _ in range(7)]
            kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = source.schema["i"].dataType.simpleString()
    return ordered.mapInArrow(
        run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
