"""Rank statistics over all rows of a table, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values for each group; a window runs within a range, and over the ranges' sums.
RANGES = 256


def error_auroc(rows: DataFrame, groups: list[str], outcome: Column, confidence: Column, ranges: int = RANGES) -> DataFrame:
    """groups, errors, rights, auroc: the probability that an error (outcome 0) is less sure than a success, ties half.

    The Mann-Whitney statistic of whole groups: rows are counted by value first (map-side partials, so hot values cost nothing); then a
    value's mid-rank needs the successes at lower values, a running sum. It is taken within ranges of like
    numbers of distinct values, and over the ranges' sums, which are ``ranges`` rows a group. Rows with a null outcome or confidence don't
    count; a group without errors or successes has no auroc.
    """
    named = [f"_g{i}" for i in range(len(groups))]
    values = rows.select(*[F.col(g).alias(n) for g, n in zip(groups, named, strict=True)], (1.0 - confidence).alias("u"), outcome.alias("o")).where("u IS NOT NULL AND o IS NOT NULL")
    counted = values.groupBy(*named, "u").agg(F.count_if(F.col("o") == 0).alias("e"), F.count_if(F.col("o") != 0).alias("r"))
    # only for the balance of the ranges; any borders give the same result
    borders = counted.groupBy(*named).agg(F.percentile_approx("u", F.array(*[F.lit(i / max(ranges, 2)) for i in range(1, max(ranges, 2))])).alias("borders"))
    on = [F.col(f"c.{n}").eqNullSafe(F.col(f"b.{n}")) for n in named]
    ranged = counted.alias("c").join(borders.alias("b"), on) if named else counted.alias("c").crossJoin(F.broadcast(borders.alias("b")))  # one row of borders
    ranged = ranged.select(*[F.col(f"c.{n}").alias(n) for n in named], "u", "e", "r", F.size(F.filter("borders", lambda x: x < F.col("u"))).alias("k"))
    sums = ranged.groupBy(*named, "k").agg(F.sum("r").alias("own"))
    before = Window.partitionBy(*named).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(n).alias(f"_{n}") for n in named], F.col("k").alias("_k"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(*named, "k").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    below = ranged.withColumn("below", F.coalesce(F.sum("r").over(within), F.lit(0)))
    same = [F.col("k") == F.col("_k"), *[F.col(n).eqNullSafe(F.col(f"_{n}")) for n in named]]
    # twice the wins, so that all sums are whole numbers
    wins = below.join(starts, same).withColumn("w", F.col("e").cast("decimal(38,0)") * (2 * (F.col("start") + F.col("below")) + F.col("r")))
    total = wins.groupBy(*named).agg(F.sum("e").alias("errors"), F.sum("r").alias("rights"), F.sum("w").alias("w"))
    share = F.when((F.col("errors") > 0) & (F.col("rights") > 0), F.col("w").cast("double") / (2.0 * F.col("errors") * F.col("rights")))
    return total.select(*[F.col(n).alias(g) for g, n in zip(groups, named, strict=True)], "errors", "rights", share.alias("auroc"))
