"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import materialize
from gleanery.storage import discard


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step: ``edges`` has u, v. Large: both directions; small: from the larger node only."""
    if small:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("lo"))
    joined = near.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("lo").alias("v")).unionByName(least.select("u", F.col("lo").alias("v")))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("lo").alias("v"))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    ``edges``: two orderable columns of one type, named u and v; loops and repeats are ignored,
    and so are edges with a null end. An empty table gives an empty table. Every step is two
    aggregations and a join on the nodes, so a node with very many edges is pre-aggregated on
    the map side and its join partition can be split; each step's table is written to the
    shared folder.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = materialize(edges, "edges")
    mark = None
    for _ in range(max_rounds):
        old, current = current, materialize(_star(_star(current, small=False), small=True), "edges")
        discard(old)
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == mark or now.n == 0:
            break
        mark = (now.n, now.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Each edge now leads from a node to the smallest node of its component.
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
