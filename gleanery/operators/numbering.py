"""Consecutive numbers for rows in the order of a key, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a range; ranges at most, beyond which they have more rows.
RANGE_ROWS, MOST_RANGES = 4096, 4000


def _between(key: Column, bounds: list) -> Column:
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key > F.lit(bounds[middle]), tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(bounds))


def with_row_number(df: DataFrame, key: str, name: str = "row", range_name: str | None = None) -> DataFrame:
    """``df`` with consecutive numbers from 0 in the order of a numeric ``key``; nulls come first and
    equal keys in no fixed order.

    Ranges of the key are cut at its quantiles; each range is sorted by itself, and starts where
    the counts of the ranges before it end. One count per range comes to the driver. A range is a partition
    and has some ``RANGE_ROWS`` rows, however many there are in all; the result keeps these partitions,
    and with ``range_name`` their numbers, by which it can be grouped without a shuffle.
    """
    total = df.count()
    parts = max(df.sparkSession.sparkContext.defaultParallelism, min(-(-total // RANGE_ROWS), MOST_RANGES))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = df.agg(F.percentile_approx(key, shares, 10 * max(1000, parts)).alias("q")).first().q or []
    bounds = sorted(set(found))
    part = F.when(F.col(key).isNull(), F.lit(0)).otherwise(_between(F.col(key), bounds))
    placed = df.withColumn("_part", part)
    start, offsets = 0, {}
    for r in sorted(placed.groupBy("_part").count().collect()):
        offsets[r["_part"]] = start
        start += r["count"]
    by_part = F.element_at(F.array(*(F.lit(offsets.get(i, 0)) for i in range(len(bounds) + 1))), F.col("_part") + 1)
    number = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_first()))
    placed = placed.repartitionById(len(bounds) + 1, F.col("_part")).withColumn(name, (by_part + number - 1).cast("long"))
    return placed.withColumnRenamed("_part", range_name) if range_name else placed.drop("_part")
