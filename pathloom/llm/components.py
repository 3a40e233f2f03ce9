"""Connected components of a table of links, by alternating large and small stars.

Each round writes its links to shared storage, so that lineage stays short and a
lost executor costs one round at most, and deletes those of the round before.
Minima are combined before a shuffle; the joins have a stored table on either
side, which lets adaptive execution split the partition of a hub.  Nothing is
gathered on the driver but two numbers a round.

Defined cases: links with a null end and links of a node with itself count for
nothing; repeated links and both directions of one are one link; a table without
links gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that occurs in a link; root is the component's least node."""
    e = common.stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links"
    )
    seen = _signature(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        # Large star: every larger neighbour moves to the least one.
        large = common.stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        # Small star: smaller neighbours, and the node itself, move to the least one.
        low = common.stored(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        settled = common.stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        common.discard(e, least, large, low)
        e, now = settled, _signature(settled)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
