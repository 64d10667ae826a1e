"""Connected components of an edge table, on the executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of an edge can reach.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) turn each component into a star around
    its smallest node in a logarithmic number of rounds. A hub's neighbours are never gathered: its minimum is
    pre-aggregated, and joined back to the edges as rows (adaptive execution splits such a join's hot keys).
    Each round is written to the shared folder, so a lost executor costs a round at most.
    """
    spark = edges.sparkSession
    first = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, path = stored(first, "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        half, half_path = stored(large, "large-star")
        low = half.groupBy("u").agg(F.min("v").alias("m"))
        # the minimum itself links to each node; every other smaller neighbour links to the minimum
        small = half.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after, after_path = stored(small, "small-star")
        discard(spark, path, half_path)
        now, path = after, after_path
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and an order-free digest of the edges: equal for equal sets."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)
