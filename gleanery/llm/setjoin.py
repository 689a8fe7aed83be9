"""Exact similarity join of texts as sets of selected three-word shingles."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.common import materialize
from gleanery.llm.components import connected_components
from gleanery.storage import discard

#: Share of their selected shingles that two texts must have in common.
JACCARD = Fraction(9, 20)
SIZE = 3
#: Shingles that a text may have without any being left out; of more a half, a quarter ... is selected.
TARGET = 128
_FACTORS = np.random.default_rng(11).integers(1, 1 << 62, SIZE, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: bytes, memo: Memo | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``simhash.shingles``."""
    words = text.lower().split()
    hashes = np.fromiter(map((Memo() if memo is None else memo).__getitem__, words), np.uint64, len(words))
    size = min(SIZE, len(words))
    if not size:
        return np.zeros(0, np.int64)
    total = np.full(len(words) - size + 1, size * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for j in range(size):
        total += hashes[j : j + len(total)] * _FACTORS[j]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return np.unique(total.view(np.int64))


def set_number(found: np.ndarray) -> int:
    """A signed 64-bit number for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64))


def level_of(n: int) -> int:
    """How many halvings bring ``n`` shingles to ``TARGET`` or fewer. Sizes that differ by a factor
    of two at most are one level apart at most."""
    return max(0, (n - 1) // TARGET).bit_length()


def select(found: np.ndarray, level: int) -> np.ndarray:
    """The shingles whose hash ends with ``level`` zero bits: the same ones in every text."""
    return found[(found & ((1 << level) - 1)) == 0]


def release(docs: DataFrame) -> None:
    """Files of shuffles that no table here refers to any more are deleted now, not at the next collection."""
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()


def _postings(sets: DataFrame, jaccard: Fraction) -> DataFrame:
    """(k, c, n, w, own, at): for every set, at its own level and at the next, the first
    w - ceil(t w) + 1 of its w selected shingles in one order, rare ones first, with their places;
    without shingles that no other set has. Sets that reach the threshold t have one in common.

    The order, by how many sets have a shingle, decides on the cost only. It is exact, as a shingle
    that a sample has once may be in more sets the more there are, and then pairs that meet by chance
    grow with their square. Shingles are shuffled once to be counted, and those of several sets once to
    be put in order.
    """
    a, b = jaccard.numerator, jaccard.denominator
    by_shingle = Window.partitionBy("k")
    shared = sets.select(F.explode("s").alias("k"), "c").withColumn("often", F.count(F.lit(1)).over(by_shingle)).where("often > 1")
    level = F.expr(f"case when n <= {TARGET} then 0 else length(bin((n - 1) div {TARGET})) end").cast("int")
    sizes = sets.select("c", "n", level.alias("level"), F.size("s").alias("w0"), "s")
    sizes = sizes.select("c", "n", "level", "w0", F.size(F.filter("s", lambda x: _ends(x, F.col("level")))).alias("w1"))
    levels = F.when(_ends(F.col("k"), F.col("level")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = shared.join(sizes, "c").select("k", "c", "n", "level", "w0", "w1", "often", F.explode(levels).alias("up"))
    by_set = Window.partitionBy("c", "up")
    w = F.when(F.col("up") == 0, F.col("w0")).otherwise(F.col("w1"))
    rows = rows.select("k", "c", "n", "level", "up", w.alias("w"), (F.row_number().over(by_set.orderBy("often", "k")) - 1).alias("at"), F.count(F.lit(1)).over(by_set).alias("found"))
    rows = rows.withColumn("at", (F.col("at") + F.col("w") - F.col("found")).cast("int")).where(f"at <= w - ({a}L * w + {b - 1}) div {b}")
    key = F.col("k").bitwiseXOR(F.xxhash64(F.col("level") + F.col("up")))
    out = materialize(rows.select(key.alias("k"), "c", "n", "w", (F.col("up") == 0).alias("own"), "at"), "postings")
    release(sets)
    return out


def _ends(shingle: Column, level: Column) -> Column:
    """Whether a shingle selected at a level is at the next, too."""
    return F.call_function("shiftright", shingle, level).bitwiseAND(F.lit(1)) == 0


def verified(met: DataFrame, sets: DataFrame, jaccard: Fraction) -> DataFrame:
    """(u, v) of ``met`` whose selected sets, at the higher of the two levels, reach the threshold,
    written to the shared folder."""
    a, b = jaccard.numerator, jaccard.denominator
    for end in "uv":
        met = met.join(sets.select(F.col("c").alias(end), F.col("n").alias(f"{end}n"), F.col("s").alias(f"{end}s")), end)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for un, vn, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                level = level_of(max(un, vn))
                x, y = select(x.values.to_numpy(), level), select(y.values.to_numpy(), level)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common > 0 and b * common >= a * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    found = materialize(met.select("u", "v", "un", "vn", "us", "vs").mapInArrow(verify, "u long, v long"), "linked")
    release(sets)
    return found


def linked_sets(sets: DataFrame, links: DataFrame, jaccard: Fraction = JACCARD, stars: int = 4) -> DataFrame:
    """(node, component): the components of sets of shingles under links between similar sets, and
    those given as ``links`` (u, v). Sets without a link have no row.

    ``sets`` has one row per set: its number c, its size n and s, those of its shingles that
    :func:`select` leaves at its level. Two sets are similar if neither is more than twice as
    large as the other and their selected shingles, at the higher of their levels, have a
    Jaccard of ``jaccard`` or more. Every such link counts.

    Sets are compared by the prefix filter (:func:`_postings`), but not all pairs of a group are:
    first each set meets one representative per shingle, and is compared with the ``stars`` ones
    with which it has most in common; links that hold merge groups at a cost in proportion to
    their size. Then only pairs of different components remain. For these the search is
    exhaustive, under length and positional filters: a pair shares at most what is left of either
    set from the first common shingle on, and at most the common ones of both prefixes and, behind
    the last of them, what is left of one set and lies beyond the other's prefix; where that could
    suffice, the sets are compared.
    """
    a, b = jaccard.numerator, jaccard.denominator
    posting = _postings(sets, jaccard)
    links = links.select("u", "v")
    fits = f"(uown or vown) and 2L * least(un, vn) >= greatest(un, vn) and {b}L * least(uw, vw) >= {a}L * greatest(uw, vw)"

    def labelled() -> DataFrame:
        """The postings with the components so far, of shingles in several components only."""
        groups = connected_components(links)
        rows = posting.join(groups.withColumnRenamed("node", "c"), "c", "left").withColumn("g", F.coalesce("component", "c")).drop("component")
        by_shingle = Window.partitionBy("k")
        several = rows.withColumns({"lo": F.min("g").over(by_shingle), "hi": F.max("g").over(by_shingle)}).where("lo < hi")
        found = materialize(several.drop("lo", "hi"), "rows")
        release(sets)
        return found

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.withColumnsRenamed({"c": x, **{y: x + y for y in ("n", "w", "own", "at", "g")}})

    if stars:
        rows = labelled()
        first = rows.groupBy("k").agg(F.min_by(F.struct("c", "n", "w", "own", "at", "g"), F.xxhash64("c")).alias("r")).select("k", "r.*")
        met = side(rows, "v").join(side(first, "u"), "k").where(f"ug <> vg and {fits}").groupBy("u", "v").agg(F.count(F.lit(1)).alias("m"))
        best = met.groupBy("v").agg(F.slice(F.sort_array(F.collect_list(F.struct("m", "u")), False), 1, stars).alias("b"))  # a shingle each
        best = materialize(best.select("v", F.explode("b.u").alias("u")).select("u", "v"), "met")
        release(sets)
        links = materialize(links.unionByName(verified(best, sets, jaccard)), "links")
        discard(best)
        discard(rows)

    rows = labelled()
    group = rows.select("k", "g").distinct()
    across = group.withColumnRenamed("g", "ug").join(group.withColumnRenamed("g", "vg"), "k").where("ug < vg")
    met = across.join(side(rows, "u"), ["k", "ug"]).join(side(rows, "v"), ["k", "vg"]).where(fits)
    swap = F.col("u") > F.col("v")
    met = met.select(*(F.when(swap, F.col(y + z)).otherwise(F.col(x + z)).alias(x + z) for x, y in ("uv", "vu") for z in ("", "w", "at")))
    met = met.groupBy("u", "v", "uw", "vw").agg(F.count(F.lit(1)).alias("m"), *(f(x + "at").alias(x + y) for x in "uv" for f, y in ((F.min, "f"), (F.max, "l"))))
    rest = lambda x, y: f"least(({a}L * {x}w + {b - 1}) div {b} - 1, {y}w - {y}l - 1)"
    most = f"least(uw - uf, vw - vf, m + greatest({rest('u', 'v')}, {rest('v', 'u')}))"
    met = materialize(met.where(f"{a + b}L * {most} >= {a}L * (uw + vw)").select("u", "v"), "met")
    discard(rows)
    discard(posting)
    release(sets)
    return connected_components(links.unionByName(verified(met, sets, jaccard)))
