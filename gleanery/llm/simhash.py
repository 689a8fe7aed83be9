"""SimHash near-duplicates found by Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import golay
from gleanery.llm.common import discard, materialize, same, texts
from gleanery.llm.components import connected_components
from gleanery.llm.setjoin import Memo, level_of, linked_sets, release, select, set_number, shingle_set


# ---------------------------------------------------------------- fingerprints
def shingles(text: bytes, size: int = 3) -> list[bytes]:
    """Word shingles, repeats included: A-Z lower-cased, words cut at ASCII white space; all
    words as one shingle where there are fewer than ``size``, none where there is no word."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    line = b" ".join(words)
    return [line[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]


def fingerprint(features: list[bytes], seed: int = 42) -> int:
    """An unsigned 64-bit number; a bit is 1 if over half the features' XXH64 have it. No features: zero."""
    if not features:
        return 0
    hashed = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in features), np.uint64, len(features))
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 8192):
        part = hashed[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashed), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    features: Callable[[bytes], list[bytes]] = shingles,
    with_sets: bool = False,
) -> DataFrame:
    """(id, f0): one row per row of ``docs``, the fingerprint as a signed 64-bit number; ``with_sets``:
    and c, n, s: number, size and selected shingles (:mod:`setjoin`) of its set of shingles.

    A null text counts as empty and has the fingerprint zero. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = texts(batch, "t")
                prints = np.array([fingerprint(features(t)) for t in found], np.uint64).astype(np.int64)
                columns = [batch.column(0), pa.array(prints)]
                if with_sets:
                    sets = [shingle_set(t, memo) for t in found]
                    columns += [pa.array([set_number(x) for x in sets], pa.int64()), pa.array(map(len, sets), pa.int32(), size=len(sets))]
                    columns.append(pa.array([select(x, level_of(len(x))) for x in sets], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["id", "f0", "c", "n", "s"][: len(columns)])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, f0 long" + ", c long, n int, s array<long>" * with_sets)


# ---------------------------------------------------------------- keys
@dataclass(frozen=True)
class KeySpec:
    """Bits that must agree exactly, and up to 23 bits decoded to codewords; as bit numbers."""

    exact: tuple[int, ...]
    fuzzy: tuple[int, ...]


def guaranteed_specs() -> tuple[KeySpec, ...]:
    """Six keys that together catch every pair of 64-bit fingerprints at 2 or fewer bits.

    The 64 bits are three segments of 22, 21 and 21. By the pigeonhole principle two of the
    segments hold one error at most between them: one agrees exactly, and the other is within
    one bit, for which the Golay keys always meet.
    """
    parts = (tuple(range(0, 22)), tuple(range(22, 43)), tuple(range(43, 64)))
    return tuple(KeySpec(a, b) for a, b in permutations(parts, 2))


def _gather(prints: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The given neighbouring bits of every fingerprint as one number."""
    return ((prints >> np.uint64(bits[0])) & np.uint64((1 << len(bits)) - 1)).astype(np.int64)


def _keys(found: DataFrame, specs: tuple[KeySpec, ...], probe: bool) -> DataFrame:
    """(k, f): one row per key of every fingerprint. Probe: the nearest codeword only; else all
    within 4 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                numbers = whole.column(0).slice(start, 4096).to_numpy(zero_copy_only=False)
                prints = numbers.view(np.uint64)
                rows, keys = [], []
                for i, spec in enumerate(specs):
                    head = (np.int64(i) << np.int64(36)) | (_gather(prints, spec.exact) << np.int64(12))
                    segment = _gather(prints, spec.fuzzy)
                    index = golay.nearest_index(segment)[:, None] if probe else golay.near_indices(segment)
                    row, col = np.nonzero(index >= 0)
                    rows.append(row)
                    keys.append(head[row] | index[row, col])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(numbers[np.concatenate(rows)])], ["k", "f"])

    return found.select("f0").mapInArrow(run, "k long, f long")


def near_pairs(found: DataFrame, radius: int = 2, specs: tuple[KeySpec, ...] | None = None) -> DataFrame:
    """(u, v): pairs of different fingerprints, u < v, that differ in ``radius`` bits or fewer and
    share a key; with the default keys every pair within 2 bits. ``found`` has distinct f0.

    The join carries nothing but keys and fingerprints. A key has 33 bits and more besides the
    number of its kind, so that of n fingerprints it meets some n / 10 ** 9 strangers; nothing is
    capped. It is a merge join whatever the planner's sizes say: the planner sees the fingerprints,
    not the six or some thirty keys of each, and would gather these in the driver to broadcast them.
    """
    specs = specs or guaranteed_specs()
    probe = _keys(found, specs, probe=True).withColumnRenamed("f", "u")
    build = _keys(found, specs, probe=False).withColumnRenamed("f", "v")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    met = probe.hint("merge").join(build, "k").where((F.col("u") != F.col("v")) & near)
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


# ---------------------------------------------------------------- the operator
def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    features: Callable[[bytes], list[bytes]] = shingles,
    radius: int = 2,
    specs: tuple[KeySpec, ...] | None = None,
) -> DataFrame:
    """Near-duplicate groups: (id_col, f0, n_near, component_id), one row per row of ``docs``.

    Rows are linked where their fingerprints differ in ``radius`` bits or fewer; n_near counts
    the other rows linked directly, component_id is the smallest id reachable over links, the
    row's own included. With the default six keys every link at radius 2 is found.

    Equal fingerprints are collapsed before any join, so exact copies cost one row per
    fingerprint whatever their number. Null and empty texts have the fingerprint zero and are
    linked like any other; rows with a null id are counted but name no group (component_id is
    null only if the whole group has no id); repeated rows are rows of their own; an empty table
    gives an empty table; other columns are ignored whatever their names.

    The joins are merge joins whatever the planner's sizes say: it takes a table for as large as its
    compressed file, and where rows are copies or have no id a few MB hold millions of them.
    """
    found = materialize(fingerprints(docs, id_col, text_col, features), "fingerprints")
    classes = materialize(found.groupBy("f0").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")), "classes")
    pairs = materialize(near_pairs(classes, radius, specs), "pairs")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.hint("merge").join(classes.select(F.col("f0").alias("v"), "size"), "v").groupBy(F.col("u").alias("f0")).agg(F.sum("size").alias("others"))
    groups = connected_components(pairs)
    labelled = (
        classes.join(groups.withColumnRenamed("node", "f0").hint("merge"), "f0", "left")
        .join(near.hint("merge"), "f0", "left")
        .withColumn("component", F.coalesce("component", "f0"))
    )
    labelled = materialize(labelled, "labelled")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = labelled.hint("merge").join(least, "component").select(
        "f0", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), "component_id"
    )
    return found.hint("merge").join(per_class, "f0").select(F.col("id").alias(id_col), "f0", "n_near", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each group the row with the smallest id stays.

    Rows are linked where their fingerprints differ in 2 bits or fewer (:func:`near_pairs`), and,
    since a text with one word in ten replaced is farther than that, where one text has at most
    twice as many three-word shingles as the other and those selected have a Jaccard of
    ``setjoin.JACCARD`` or more (:func:`setjoin.linked_sets`; of up to 128 shingles all are
    selected). Both searches are complete. Links are made between different fingerprints and
    different sets, which the rows then belong to; pairs within a group are not worked out.

    Documents without a word (null, empty or blank text) are no copies of each other and stay, and
    so do rows with a null id; of rows that repeat an id all stay or go together; the smallest of
    equal ids is the same row's. An empty table gives an empty one. All columns are kept, whatever
    their names.
    """
    worded = docs.where(F.col(text_col).rlike(r"[^\x20\x09-\x0D]") & F.col(id_col).isNotNull())
    marked = materialize(fingerprints(worded, id_col, text_col, with_sets=True), "marked")
    sets = materialize(marked.groupBy("c").agg(F.first("n").alias("n"), F.first("s").alias("s")), "sets")
    found = materialize(marked.select("id", "f0", "c"), "named")  # without the sets, which are there once now
    discard(marked)
    release(docs)
    prints = found.select("f0", "c").distinct()
    classes = materialize(prints.groupBy("f0").agg(F.min("c").alias("c"), F.max("c").alias("other")), "classes")
    alike = prints.join(classes.where("c < other").select("f0", F.col("c").alias("u")), "f0").where("c <> u").select("u", F.col("c").alias("v"))
    near = near_pairs(classes)
    for end in "uv":
        near = near.join(classes.select(F.col("f0").alias(end), F.col("c").alias(f"{end}c")), end)
    links = materialize(alike.unionByName(near.select(F.col("uc").alias("u"), F.col("vc").alias("v"))), "links")
    release(docs)
    groups = linked_sets(sets, links)
    labelled = found.select("id", "c").join(groups.withColumnRenamed("node", "c"), "c", "left")
    labelled = materialize(labelled.select("id", F.coalesce("component", "c").alias("component")), "labelled")
    for table in (sets, links, classes, found):
        discard(table)
    release(docs)
    least = labelled.groupBy("component").agg(F.min("id").alias("least"))
    gone = labelled.join(least, "component").where("id <> least").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, same(docs[id_col], gone["_gone"]), "left_anti")
