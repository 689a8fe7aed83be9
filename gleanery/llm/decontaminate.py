"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import materialize, same, texts

#: 1: the token counts; 0: it may differ. Chosen by enumeration: every pattern of 10 to 23 tokens of
#: which a quarter at most differs is hit, and longer ones hold such a part of 12 to 23 tokens.
MASKS = ("111011", "1100001011", "11010011", "1001111", "11111")
SPAN = 10
SHORTEST = 5
_DELETED = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_FACTORS = np.random.default_rng(7).integers(1, 1 << 62, SPAN, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def tokens(text: bytes, memo: _Memo | None = None) -> np.ndarray:
    """Hashes of the words: A-Z lower-cased, ASCII punctuation deleted, cut at ASCII white space."""
    words = text.lower().translate(None, _DELETED).split()
    return np.fromiter(map((_Memo() if memo is None else memo).__getitem__, words), np.uint64, len(words))


def _masks(lengths: list[int]) -> list[str]:
    """The spaced masks, and a full mask for every item length below the span."""
    return [*MASKS, *("1" * n for n in sorted(set(lengths)) if 0 < n < SPAN)]


def _seeds(hashes: np.ndarray, masks: list[str]) -> Iterator[tuple[int, str, np.ndarray]]:
    """For each mask its number, itself and the key of the window that begins at each token; shorter at the end."""
    products = [hashes * f for f in _FACTORS]
    for number, mask in enumerate(masks):
        n = len(hashes) - len(mask) + 1
        if n <= 0:
            continue
        total = np.full(n, (number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                total += products[j][j : j + n]
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
        yield number, mask, total


def _bits(key: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64((1 << log_bits) - 1)
    return key & top, (key >> np.uint64(64 - log_bits)) & top


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_overlap: int = 12,
    identity: float = 0.75,
    context: int | None = None,
    log_bits: int = 25,
) -> DataFrame:
    """(id_col, item_col, doc_start, item_start, overlap, matched): overlaps of documents and items.

    Every window of ``SPAN`` tokens of every text is hashed under masks that leave some positions
    out, on both sides; equal hashes are joined and the tokens around each hit compared. The masks
    hit every stretch of ten tokens and more of which three quarters match. An overlap is the
    stretch around a hit (each hit is tried), at most ``context`` tokens beyond the windows (none
    given: as many as the longest item has, so that none is cut), in which matches most outweigh
    mismatches (+1, -2); it counts with at least ``min_overlap`` tokens (or
    the whole item, if that is shorter), of which a share of ``identity`` or more match. Per
    document and item the longest overlap is returned, the earliest of equals.

    The item hashes also fill a bit table of 2 ** ``log_bits`` bits, whatever their number, that
    spares the join nearly all windows of other texts; it drops none that could match. Documents
    send only the tokens near hits, never their text.

    Null and empty texts overlap nothing; items of fewer than ``SPAN`` tokens are found without
    substitutions only, and those of fewer than ``SHORTEST``, which stand by chance in many texts,
    where a text is the item and nothing else. Rows that share an id give
    the overlaps of all of them; a null id is an id. Empty tables give an empty result; other
    columns are not read.
    """
    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("t"))
    id_kind, item_kind = (f.schema[0].dataType.simpleString() for f in (source, items))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [tokens(t).astype(np.int64) for t in texts(batch, "t")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["item", "tokens"])

    items = materialize(
        items.mapInArrow(tokenise, f"item {item_kind}, tokens array<long>").withColumn("row", F.monotonically_increasing_id()), "items"
    )
    lengths = [r.n for r in items.select(F.size("tokens").alias("n")).where(F.col("n") < SPAN).distinct().collect()]  # below SPAN rows
    masks = _masks(lengths)
    reach = context if context is not None else items.agg(F.max(F.size("tokens"))).first()[0] or 0

    def item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for row, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = np.array(values, np.int64).astype(np.uint64)
                for number, mask, keys in _seeds(hashes, masks):
                    if len(hashes) >= SPAN if number < len(MASKS) else len(mask) == len(hashes):
                        out.append((keys.astype(np.int64), np.arange(len(keys)), np.full(len(keys), row)))
            columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k", "item_at", "row"])

    keys = materialize(items.select("row", "tokens").mapInArrow(item_keys, "k long, item_at long, row long"), "item-keys")
    bit = lambda shift: F.shiftrightunsigned("k", shift).bitwiseAND(F.lit((1 << log_bits) - 1))
    at = keys.select(F.explode(F.array(bit(0), bit(64 - log_bits))).alias("b"))
    words = (  # 2 ** (log_bits - 6) rows at most
        at.groupBy(F.shiftright("b", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m"))
        .toPandas()
    )
    bitmap = np.zeros(1 << (log_bits - 6), np.int64)
    bitmap[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        memo = _Memo()

        def found(group: list[tuple[object, np.ndarray]]) -> pa.RecordBatch:
            hashes = np.concatenate([h for _, h in group])
            ends = np.cumsum([len(h) for _, h in group])
            hits: list[tuple[int, int]] = []
            for _, mask, key in _seeds(hashes, masks):
                one, two = _bits(key, log_bits)
                maybe = np.nonzero(table[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8) & 1)[0]
                two = two[maybe]
                maybe = maybe[(table[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8) & 1) > 0]
                owner = np.searchsorted(ends, maybe, "right")
                inside = owner == np.searchsorted(ends, maybe + len(mask) - 1, "right")
                if len(mask) < SHORTEST:
                    inside &= (ends - np.append(0, ends[:-1]))[owner] == len(mask)
                hits += zip(maybe[inside].tolist(), key[maybe[inside]].astype(np.int64).tolist())
            hits.sort()
            rows: list[tuple] = []
            for position, key in hits:
                doc = int(np.searchsorted(ends, position, "right"))
                first = int(ends[doc]) - len(group[doc][1])
                if rows and rows[-1][0] == doc and position <= rows[-1][2][-1][0] + max(SPAN, reach):
                    rows[-1][2].append((position, key))
                else:
                    rows.append((doc, first, [(position, key)]))
            ids, starts, cut, places, found_keys = [], [], [], [], []
            for doc, first, hit in rows:
                low = max(first, hit[0][0] - reach)
                high = min(int(ends[doc]), hit[-1][0] + SPAN + reach)
                ids.append(group[doc][0])
                starts.append(low - first)
                cut.append(hashes[low:high].astype(np.int64))
                places.append([p - low for p, _ in hit])
                found_keys.append([k for _, k in hit])
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kinds[0]), pa.array(starts, pa.int64()), pa.array(cut, longs), pa.array(places, longs), pa.array(found_keys, longs)],
                ["i", "start", "tokens", "places", "ks"],
            )

        for batch in batches:
            kinds = [batch.schema.field(0).type]
            group, size = [], 0
            for i, t in zip(batch.column(0).to_pylist(), texts(batch, "t")):
                group.append((i, tokens(t, memo)))
                size += len(group[-1][1])
                if size > 100_000:
                    yield found(group)
                    group, size = [], 0
            if group:
                yield found(group)

    region = materialize(
        source.mapInArrow(regions, f"i {id_kind}, start long, tokens array<long>, places array<long>, ks array<long>").withColumn(
            "r", F.monotonically_increasing_id()
        ),
        "regions",
    )
    hit = region.select("r", F.explode(F.arrays_zip("places", "ks")).alias("z")).select("r", F.col("z.places").alias("place"), F.col("z.ks").alias("k"))
    candidate = (
        hit.join(keys, "k")
        .groupBy("r", "row", (F.col("place") - F.col("item_at")).alias("shift"))
        .agg(F.collect_set("place").alias("at"))
    )
    paired = candidate.join(region.select("r", "i", "start", F.col("tokens").alias("near")), "r").join(items, "row")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, start, near, shift, places, item, values in zip(*(c.to_pylist() for c in batch.columns)):
                low, high = max(0, shift), min(len(near), shift + len(values))
                match = np.array(near[low:high]) == np.array(values[low - shift : high - shift])
                sums = np.concatenate([[0], np.cumsum(np.where(match, 1, -2))])
                at = np.arange(len(sums))
                lowest, highest = np.minimum.accumulate(sums), np.maximum.accumulate(sums[::-1])
                left = np.maximum.accumulate(np.where(np.append(True, sums[1:] < lowest[:-1]), at, 0))
                right = at[-1] - np.maximum.accumulate(np.where(np.append(True, sums[::-1][1:] >= highest[:-1]), at, 0))[::-1]
                total = np.append(0, np.cumsum(match))
                anchors = np.array(places) - low
                left, right = left[anchors], right[anchors]
                length, matched = right - left, total[right] - total[left]
                good = np.nonzero((length >= min(min_overlap, len(values))) & (matched >= identity * length))[0]
                if len(good):
                    g = good[np.lexsort((left[good], -matched[good], -length[good]))[0]]
                    at = int(left[g])
                    out.append((i, item, start + low + at, low - shift + at, int(length[g]), int(matched[g])))
            columns = list(zip(*out)) if out else [[] for _ in range(6)]
            kinds = [batch.schema.field(0).type, batch.schema.field(5).type, *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["i", "item", "doc_start", "item_start", "overlap", "matched"])

    checked = paired.select("i", "start", "near", "shift", "at", "item", "tokens").mapInArrow(
        verify, f"i {id_kind}, item {item_kind}, doc_start long, item_start long, overlap long, matched long"
    )
    best = checked.groupBy("i", "item").agg(
        F.max_by(F.struct("doc_start", "item_start", "overlap", "matched"), F.struct("overlap", "matched", -F.col("doc_start"), -F.col("item_start"))).alias("b")
    )
    return best.select(
        F.col("i").alias(id_col), F.col("item").alias(item_col), "b.doc_start", "b.item_start", "b.overlap", "b.matched"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id has an overlap with a benchmark item; all columns kept.
    Rows with a null id go if any of them has one."""
    gone = find_overlaps(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, same(docs[id_col], gone["_gone"]), "left_anti")
