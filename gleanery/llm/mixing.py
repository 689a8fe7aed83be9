"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gleanery.llm.common import materialize, same, slices, texts

BUCKETS = 4096


_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalpha())


def plainness(data: bytes) -> float:
    """A quality weight from 0.1 to 1: less the more ASCII digits and punctuation a text holds."""
    if not data:
        return 0.1
    marks = len(data) - len(data.translate(None, _MARKS))
    return max(0.1, 1.0 - 2.0 * marks / len(data.decode("utf-8", "surrogateescape")))


def measured(rows: DataFrame, weigh: Callable[[list[bytes]], Iterable[float]] | None = None) -> DataFrame:
    """``rows`` (whose last column is a text) with the text replaced by size and plain: the number of
    runs of characters other than ASCII white space, 0 for null, and a quality weight of the text
    (none given: its :func:`plainness`)."""
    weigh = weigh or (lambda found: map(plainness, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = texts(batch, batch.schema.names[-1])
            size = pa.array([len(t.split()) for t in found], pa.int64())
            plain = pa.array([float(w) for w in weigh(found)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], size, plain], [*batch.schema.names[:-1], "size", "plain"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("size", T.LongType()), T.StructField("plain", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def exponential_key(id_col: Column, weight: Column, seed: str = "mix") -> Column:
    """-ln(u) / weight, with u in (0, 1) from the md5 of the id: the smaller, the earlier taken."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / F.greatest(weight, F.lit(1e-9))


def _bucket(key: Column) -> Column:
    """A number from 0 to BUCKETS - 1 that never falls as the key rises."""
    return F.least(F.lit(BUCKETS - 1), F.floor(key / (key + 1.0) * BUCKETS)).cast("int")


def level(totals: DataFrame, repeats: int) -> float:
    """Words per unit of weight such that min(repeats * size, level * weight) sums to all words.

    ``totals``: s, source_size, weight. Full sources are set aside round by round; each round is
    one aggregation over the sources.
    """
    cap = F.col("source_size") * repeats
    total = totals.agg(F.sum("source_size")).first()[0] or 0
    found, full = 0.0, -1
    while True:
        is_full = (F.col("weight") > 0) & (cap <= F.lit(found) * F.col("weight"))
        row = totals.agg(
            F.count_if(is_full).alias("full"),
            F.coalesce(F.sum(F.when(is_full, cap)), F.lit(0)).alias("used"),
            F.sum(F.when(~is_full & (F.col("weight") > 0), F.col("weight"))).alias("rest"),
        ).first()
        if row.full == full or not row.rest:
            return found
        full = row.full
        found = max(0.0, float(total - row.used)) / float(row.rest)


def mix_plan(sizes: DataFrame, weights: DataFrame, repeats: int = 3) -> DataFrame:
    """Per source: s, source_size, target, epochs, cut_key, cut_id.

    ``sizes``: s, id, size, key, one row per document; ``weights``: s, weight. Every document is
    taken ``epochs`` times and once more if (key, id) comes at or before (cut_key, cut_id).
    Only the one key bucket per source in which the budget ends is sorted; everything else is
    pre-aggregated, so a source with a third of all rows is no one task's load.
    """
    totals = sizes.groupBy("s").agg(F.sum("size").alias("source_size"))
    weights = weights.groupBy("s").agg(F.sum("weight").alias("weight"))
    totals = totals.join(weights.select(F.col("s").alias("_s"), "weight"), same(F.col("s"), F.col("_s")), "left")
    totals = materialize(totals.select("s", "source_size", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).cast("double").alias("weight")), "totals")
    per_weight = level(totals, repeats)
    target = F.round(F.least((F.col("source_size") * repeats).cast("double"), F.lit(per_weight) * F.col("weight")), 6)
    planned = totals.select("s", "source_size", target.alias("target")).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    )
    planned = planned.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    bucketed = sizes.withColumn("bucket", _bucket(F.col("key")))
    sums = bucketed.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    ordered = Window.partitionBy("s").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("words").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    edge = (
        sums.join(planned.select(F.col("s").alias("_s"), "rest"), same(F.col("s"), F.col("_s")))
        .where((F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        .select(F.col("s").alias("_s"), F.col("bucket").alias("_bucket"), (F.col("upto") - F.col("words")).alias("before"), "rest")
    )
    units = (
        bucketed.join(edge, same(F.col("s"), F.col("_s")) & (F.col("bucket") == F.col("_bucket")))
        .groupBy("s", "key", "id")
        .agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    )
    upto = F.sum("words").over(Window.partitionBy("s").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0))
    fits = units.withColumn("upto", F.col("before") + upto).where(2 * F.col("upto") - F.col("words") <= 2 * F.col("rest"))
    cut = fits.groupBy("s").agg(F.max(F.struct("key", "id")).alias("cut"))
    edge = edge.join(cut.withColumnRenamed("s", "_c"), same(F.col("_s"), F.col("_c")), "left").select("_s", "_bucket", "cut")
    return planned.join(edge, same(F.col("s"), F.col("_s")), "left").select(
        "s",
        "source_size",
        "target",
        "epochs",
        # no edge bucket: the rest is the whole source, or the source is empty
        F.when(F.col("_bucket").isNull(), F.lit(BUCKETS)).otherwise(F.col("_bucket")).alias("cut_bucket"),
        F.col("cut.key").alias("cut_key"),
        F.col("cut.id").alias("cut_id"),
    )


def mix_sources(
    docs: DataFrame,
    weights: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality_col: str | None = None,
    repeats: int = 3,
    seed: str = "mix",
    keep: tuple[str, ...] = (),
    weigh: Callable[[list[bytes]], Iterable[float]] | None = None,
) -> DataFrame:
    """id, source, ``keep`` columns, size, source_size, target, copies, taken: one row per document.

    ``weights`` has columns s (source, null allowed) and weight; weights of a source named more
    than once add up, and a source without a positive weight gets nothing. All words together are shared out by weight; a target stops at
    ``repeats`` times its source's size, and what is over goes to the others by weight. A source
    gives complete epochs first; the fractional rest goes to the documents with the smallest
    exponential keys, scaled by the positive weights in ``quality_col`` (null: 1), else by what
    ``weigh`` makes of the texts, else by their :func:`plainness`, as long as the middle of the document is within the budget. So a source misses its target by
    half a document at most.

    Null and empty texts have size 0 and are taken 0 words. Rows that share a source, an id (null
    ids too) and a quality weight are one unit of the fractional part. Ties in the key go by id.
    Columns of ``keep`` must not be called like a column of the result (ValueError). An empty table
    gives an empty table; columns outside those named are ignored. Reruns agree.
    """
    if clash := {id_col, source_col, "size", "source_size", "target", "copies", "taken"} & set(keep):
        raise ValueError(f"kept columns with names of the result: {sorted(clash)}")
    given = F.lit(None).cast("double") if quality_col is None else F.coalesce(F.col(quality_col).cast("double"), F.lit(1.0))
    weighed = measured(
        docs.select(
            F.col(source_col).alias("s"),
            F.col(id_col).alias("id"),
            given.alias("given"),
            *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)),
            F.col(text_col).cast("string").alias("t"),
        ),
        weigh,
    ).withColumn("key", exponential_key(F.col("id"), F.coalesce("given", "plain"), seed))
    sizes = materialize(weighed.select("s", "id", "size", "key"), "sizes")
    plan = materialize(mix_plan(sizes, weights, repeats), "plan").withColumnRenamed("s", "_s")
    rows = (weighed if keep else sizes).join(plan, same(F.col("s"), F.col("_s")), "left")
    bucket = _bucket(F.col("key"))
    extra = (bucket < F.col("cut_bucket")) | (
        (bucket == F.col("cut_bucket"))
        & F.coalesce(
            (F.col("key") < F.col("cut_key"))
            | ((F.col("key") == F.col("cut_key")) & (F.col("id").isNull() | F.coalesce(F.col("id") <= F.col("cut_id"), F.lit(False)))),
            F.lit(False),
        )
    )
    whole = F.col("target") <= F.col("epochs") * F.col("source_size")
    copies = F.col("epochs") + F.when(whole, 0).when(extra, 1).otherwise(0)
    return rows.select(
        F.col("id").alias(id_col),
        F.col("s").alias(source_col),
        *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)),
        "size",
        "source_size",
        "target",
        copies.cast("int").alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def cyclic_weights(docs: DataFrame, source_col: str = "source", cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """s, weight: the distinct sources by code point, null last, weighted by repeating ``cycle``."""
    sources = docs.select(F.col(source_col).alias("s")).distinct()
    rank = F.row_number().over(Window.orderBy(F.col("s").asc_nulls_last())) - 1
    return sources.select("s", F.element_at(F.array(*(F.lit(c) for c in cycle)), (rank % len(cycle) + 1).cast("int")).alias("weight"))
