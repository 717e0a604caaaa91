"""Connected components of an edge list by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _pointed(pairs: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node's neighbours (larger ones, or smaller ones and itself) point at its least neighbour."""
    if large:
        near = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    moved = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return moved.select("e.u", "e.v").filter("u <> v").distinct()


def components(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``pairs`` (u, v); component is the least node reachable.

    Large-star and small-star contractions in turn, each a minimum by key (combined before the shuffle) and an
    equi-join that adaptive execution can split at a hub; the number of rounds is logarithmic in practice.
    Each round is a table in the shared folder. Null ends, loops and repeated pairs are dropped. An empty table gives an
    empty table.
    """
    now = stored(pairs.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        after = stored(_pointed(_pointed(now, True), False), "links")
        seen = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        dropped(now)
        now = after
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


