"""Connected components by alternating large-star and small-star rounds over a table of edges.

Each round shuffles edges by node, takes a minimum that is pre-aggregated in every task, and joins it back; a node with very
many edges only makes a join key large, which adaptive execution splits. Rounds are written to the shared folder, and only a
row count and a sum of hashes reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardframe.llm.store import Scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """``edges`` has two columns of one orderable type; the result has ``node`` and ``component``, the smallest node reachable.

    Nulls and loops are ignored; nodes without an edge to another node do not appear. No edges: an empty result.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = scratch.save(now, f"{tag}-0")
    mark, turn = _mark(now), 0
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        now = scratch.save(small, f"{tag}-{turn}")
        scratch.drop(f"{tag}-{turn - 1}")
        mark, last = _mark(now), mark
        if mark == last:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
