"""The compressed posting format: bit packing, deltas, blocks of 128; and what it would take."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 128


class CodecError(ValueError):
    pass


def bit_width(largest: int) -> int:
    return max(1, largest.bit_length())


def pack(numbers: list[int], width: int) -> bytes:
    """Numbers of ``width`` bits, lowest bits first, filled up to a whole byte."""
    if not 1 <= width <= 32:
        raise CodecError("bit width should be between 1 and 32")
    bits = 0
    for i, x in enumerate(numbers):
        if x < 0 or x >> width:
            raise CodecError("number does not fit the bit width")
        bits |= x << (i * width)
    return bits.to_bytes((len(numbers) * width + 7) // 8, "little")


def unpack(data: bytes, width: int, count: int) -> list[int]:
    if not 1 <= width <= 32:
        raise CodecError("bit width should be between 1 and 32")
    size = (count * width + 7) // 8
    if len(data) < size:
        raise CodecError("input is truncated")
    bits = int.from_bytes(data[:size], "little")
    return [bits >> (i * width) & (1 << width) - 1 for i in range(count)]


def encode_unsorted(numbers: list[int]) -> bytes:
    if not numbers:
        return b""
    width = bit_width(max(numbers))
    return bytes([width]) + pack(numbers, width)


def decode_unsorted(data: bytes, count: int) -> tuple[list[int], bytes]:
    """The numbers, and what follows them."""
    if not count:
        return [], data
    if not data:
        raise CodecError("input is truncated")
    width = data[0]
    found = unpack(data[1:], width, count)
    return found, data[1 + (count * width + 7) // 8 :]


def encode_sorted(numbers: list[int]) -> bytes:
    """The first number in four bytes, then the gaps."""
    if not numbers:
        return b""
    gaps = [b - a for a, b in zip(numbers, numbers[1:])]
    if min(gaps, default=0) < 0:
        raise CodecError("input should be sorted")
    width = bit_width(max(gaps, default=0))
    return struct.pack("<IB", numbers[0], width) + pack(gaps, width)


def decode_sorted(data: bytes, count: int) -> tuple[list[int], bytes]:
    if not count:
        return [], data
    if len(data) < 5:
        raise CodecError("input is truncated")
    first, width = struct.unpack("<IB", data[:5])
    out = [first]
    for gap in unpack(data[5:], width, count - 1):
        out.append(out[-1] + gap)
    return out, data[5 + ((count - 1) * width + 7) // 8 :]


def encode_postings(postings: list[tuple[int, int]]) -> bytes:
    """(document, frequency) pairs by document, in blocks: documents as gaps, then frequencies."""
    out = b""
    for i in range(0, len(postings), BLOCK):
        docs, tfs = zip(*postings[i : i + BLOCK])
        out += encode_sorted(list(docs)) + encode_unsorted(list(tfs))
    return out


def decode_postings(data: bytes, count: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    while len(out) < count:
        size = min(BLOCK, count - len(out))
        docs, data = decode_sorted(data, size)
        tfs, data = decode_unsorted(data, size)
        out += zip(docs, tfs)
    return out


def encode_lists(postings: DataFrame) -> DataFrame:
    """(segment_id, term, postings, data): every posting list encoded. Lists are put together from
    sorted partitions as they stream by, so a task holds one batch and the list that is not yet over; all blocks
    of a batch are packed at once."""
    keys = ["segment_id", "term"]
    ordered = postings.select(*keys, "seg_doc_id", "tf").repartition(*keys).sortWithinPartitions(*keys, "seg_doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the last list
        for batch in batches:
            starts = _starts(batch, held[-1] if held else None)
            if not len(starts):
                held.append(batch)
                continue
            last = int(starts[-1])
            yield _encoded([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        yield _encoded(held)

    return ordered.mapInArrow(run, "segment_id int, term string, postings long, data binary")


def _starts(batch: pa.RecordBatch, before: pa.RecordBatch | None) -> np.ndarray:
    """Rows at which a list begins, given the rows before."""
    if not batch.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(batch.num_rows, bool)
    for column in batch.columns[:2]:
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    new[0] = before is None or any(batch.column(i)[0] != before.column(i)[before.num_rows - 1] for i in (0, 1))
    return np.flatnonzero(new)


def _bits(largest: np.ndarray) -> np.ndarray:
    """``bit_width`` of numbers below 2 ** 53."""
    return np.maximum(1, np.frexp(largest.astype(np.float64))[1]).astype(np.int64)


def _put(out: np.ndarray, at: np.ndarray, numbers: np.ndarray) -> None:
    """Adds numbers below 2 ** 32 at bit positions of ``out``, lowest bits first. Those of different numbers
    do not overlap, so that sums of bytes are their unions."""
    moved = numbers.astype(np.uint64) << (at & 7).astype(np.uint64)
    for k in range(5):
        part = (moved >> np.uint64(8 * k)) & np.uint64(255)
        if part.any():
            out += np.bincount((at >> 3) + k, part.astype(np.float64), len(out))[: len(out)].astype(np.uint8)


def _taken(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The numbers of ``width`` bits at bit positions of ``data``, behind which there are four bytes more."""
    found = np.zeros(len(at), np.uint64)
    for k in range(5):
        found |= data[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((found >> (at & 7).astype(np.uint64)) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def _encoded(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The lists of whole batches of (segment_id, term, seg_doc_id, tf), as by :func:`encode_postings`."""
    names = ["segment_id", "term", "postings", "data"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.binary()]
    rows = pa.Table.from_batches(parts).combine_chunks() if parts else None
    if not rows:
        return pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)
    whole = rows.to_batches()[0]
    docs, tfs = (whole.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
    starts = _starts(whole, None)
    sizes = np.diff(starts, append=len(docs))
    place = np.arange(len(docs)) - np.repeat(starts, sizes)
    first = np.flatnonzero(place % BLOCK == 0)
    counts = np.diff(first, append=len(docs))
    gaps = np.diff(docs, prepend=docs[:1])
    gaps[first] = 0
    if gaps.min() < 0:
        raise CodecError("input should be sorted")
    if min(docs.min(), tfs.min()) < 0:
        raise CodecError("number does not fit the bit width")
    dw, tw = _bits(np.maximum.reduceat(gaps, first)), _bits(np.maximum.reduceat(tfs, first))
    packed = (dw * (counts - 1) + 7) // 8
    lengths = 6 + packed + (tw * counts + 7) // 8
    ends = np.cumsum(lengths)
    at = ends - lengths
    out = np.zeros(int(ends[-1]), np.uint8)
    block = np.repeat(np.arange(len(first)), counts)
    k = np.arange(len(docs)) - first[block]
    later = k > 0
    _put(out, ((at + 5)[block] * 8 + (k - 1) * dw[block])[later], gaps[later])
    _put(out, (at + 6 + packed)[block] * 8 + k * tw[block], tfs)
    for i in range(4):
        out[at + i] = docs[first] >> 8 * i & 255
    out[at + 4], out[at + 5 + packed] = dw, tw
    offsets = np.append(at[np.searchsorted(first, starts)], ends[-1])
    if offsets[-1] >= 1 << 31:
        raise CodecError("a list of 2 GB")
    data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays([*(whole.column(i).take(pa.array(starts)) for i in (0, 1)), pa.array(sizes), data], names)


#: Postings that are unpacked at once, at least.
UNPACKED = 1 << 17


def decode_lists(encoded: DataFrame) -> DataFrame:
    """The postings back from (segment_id, term, postings, data), as by :func:`decode_postings`. The blocks of all lists
    of a batch are found side by side, since each begins where the one before ends, and unpacked many at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3).cast(pa.large_binary())
            buffers = lists.buffers()
            bounds = np.frombuffer(buffers[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
            low = int(bounds[0]) if len(lists) else 0
            data = np.zeros(int(bounds[-1]) - low + 8 if len(lists) else 8, np.uint8)
            if len(data) > 8:
                data[:-8] = np.frombuffer(buffers[2], np.uint8)[low : int(bounds[-1])]
            at, ends = bounds[:-1] - low, bounds[1:] - low
            left, row = batch.column(2).to_numpy(zero_copy_only=False), np.arange(len(lists))
            blocks: list[tuple] = []
            waiting = 0
            while True:
                some = left > 0
                if not some.all():
                    at, ends, left, row = at[some], ends[some], left[some], row[some]
                if not len(at):
                    break
                counts = np.minimum(left, BLOCK)
                if (at + 5 > ends).any():
                    raise CodecError("input is truncated")
                dw = data[at + 4].astype(np.int64)
                middle = at + 5 + (dw * (counts - 1) + 7) // 8
                if (middle >= ends).any():
                    raise CodecError("input is truncated")
                tw = data[middle].astype(np.int64)
                after = middle + 1 + (tw * counts + 7) // 8
                if min(dw.min(), tw.min()) < 1 or max(dw.max(), tw.max()) > 32:
                    raise CodecError("bit width should be between 1 and 32")
                if (after > ends).any():
                    raise CodecError("input is truncated")
                blocks.append((row, at, middle, counts, dw, tw))
                waiting += int(counts.sum())
                if waiting >= UNPACKED:
                    yield _decoded(batch, data, blocks)
                    blocks, waiting = [], 0
                at, left = after, left - counts
            if blocks:
                yield _decoded(batch, data, blocks)

    return encoded.mapInArrow(run, "segment_id int, term string, seg_doc_id int, tf int")


def _decoded(batch: pa.RecordBatch, data: np.ndarray, blocks: list[tuple]) -> pa.RecordBatch:
    """The postings of blocks: row of their list, begin, begin of the frequencies, number, and both widths."""
    row, at, middle, counts, dw, tw = (np.concatenate(x) for x in zip(*blocks))
    first = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(row)), counts)
    k = np.arange(len(block)) - first[block]
    gaps = np.zeros(len(block), np.int64)
    later = k > 0
    gaps[later] = _taken(data, ((at + 5)[block] * 8 + (k - 1) * dw[block])[later], dw[block][later])
    total = np.cumsum(gaps)
    begin = sum(data[at + i].astype(np.int64) << 8 * i for i in range(4))
    docs = total + (begin - total[first])[block]
    tfs = _taken(data, (middle + 1)[block] * 8 + k * tw[block], tw[block])
    own = pa.array(row[block])
    columns = [batch.column(0).take(own), batch.column(1).take(own), pa.array(docs.astype(np.int32)), pa.array(tfs.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["segment_id", "term", "seg_doc_id", "tf"])


def _width(largest: Column) -> Column:
    """Bits of the largest number, one at least."""
    return F.greatest(F.lit(1), F.length(F.bin(largest))).cast("long")


def posting_block_stats(postings: DataFrame) -> DataFrame:
    """(segment_id, term, blocks, postings, doc_bits, tf_bits, bytes) of every term: how many blocks
    its list takes, the widest gap and frequency, and the encoded size."""
    by_term = Window.partitionBy("segment_id", "term").orderBy("seg_doc_id")
    numbered = postings.withColumn("block", F.floor((F.row_number().over(by_term) - 1) / BLOCK))
    in_block = Window.partitionBy("segment_id", "term", "block").orderBy("seg_doc_id")
    gaps = numbered.withColumn("gap", F.col("seg_doc_id") - F.lag("seg_doc_id").over(in_block))
    blocks = gaps.groupBy("segment_id", "term", "block").agg(
        F.count(F.lit(1)).alias("n"), _width(F.coalesce(F.max("gap"), F.lit(0))).alias("dw"), _width(F.max("tf")).alias("tw")
    )
    size = 5 + F.ceil(F.col("dw") * (F.col("n") - 1) / 8) + 1 + F.ceil(F.col("tw") * F.col("n") / 8)
    return blocks.groupBy("segment_id", "term").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum("n").alias("postings"),
        F.max("dw").alias("doc_bits"),
        F.max("tw").alias("tf_bits"),
        F.sum(size).cast("long").alias("bytes"),
    )
