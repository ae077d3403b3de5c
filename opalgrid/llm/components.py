"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.llm._store import drop, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for each node of the links (u, v): root is its component's smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014).  A step is an aggregate with
    map-side partial minima and a join, so a hub of any degree is never gathered in one task.
    Null ends and loops are ignored; repeated links count once.  Raises RuntimeError if ``rounds``
    do not suffice; their number grows with the logarithm of the longest path.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    for _ in range(rounds if state[0] else 0):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").where("v <> m").union(least).toDF("u", "v").distinct()
        before, old = state, edges
        edges = stored(small, "stars")
        state = _state(edges)
        drop(old)
        if before == state:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
