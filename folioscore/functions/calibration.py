"""Confidence metrics of a page: arrays of outcomes (0/1) and confidences, position by position.

Null where the metric has no value: no items, unequal lengths, or (for the AUROC) only one class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let

BINS = 10


def _pairs(outcomes: Column, confidences: Column) -> Column:
    return F.arrays_zip(outcomes.alias("o"), confidences.alias("c"))


def _valid(outcomes: Column, confidences: Column) -> Column:
    return (F.size(outcomes) > 0) & (F.size(outcomes) == F.size(confidences))


def brier(outcomes: Column, confidences: Column) -> Column:
    total = F.aggregate(_pairs(outcomes, confidences), F.lit(0.0), lambda s, p: s + F.pow(p.c - p.o, F.lit(2)))
    return F.when(_valid(outcomes, confidences), total / F.size(outcomes))


def bin_of(confidence: Column, bins: int = BINS) -> Column:
    """The last bin whose lower edge i / bins is not above the confidence; the last bin is closed.

    Edges are compared, not multiplied: confidence x bins rounds wrongly next to an edge.
    """
    if bins <= 0:
        raise ValueError("bins must be positive")
    edges = F.array(*[F.lit(i / bins) for i in range(bins)])
    return F.size(F.filter(edges, lambda e: confidence >= e)) - 1


def calibration_error(outcomes: Column, confidences: Column, bins: int = BINS) -> Column:
    """Sum over bins of share x |accuracy - mean confidence|."""
    pairs = F.transform(_pairs(outcomes, confidences), lambda p: F.struct(bin_of(p.c, bins).alias("b"), p.o.cast("double").alias("o"), p.c.alias("c")))

    def gap(own: Column, b: Column) -> Column:
        return F.abs(F.aggregate(F.filter(own, lambda p: p.b == b), F.lit(0.0), lambda s, p: s + (p.o - p.c)))

    total = let(pairs, lambda own: F.aggregate(F.array(*map(F.lit, range(bins))), F.lit(0.0), lambda s, b: s + gap(own, b)))
    return F.when(_valid(outcomes, confidences), total / F.size(outcomes))


def error_auroc(outcomes: Column, confidences: Column) -> Column:
    """Probability that an error (outcome 0) has a higher 1 - confidence than a success, ties half."""
    pairs = F.transform(_pairs(outcomes, confidences), lambda p: F.struct(p.o.alias("o"), (1.0 - p.c).alias("u")))

    def share(errors: Column, rights: Column) -> Column:
        def wins(e: Column) -> Column:
            return F.aggregate(rights, F.lit(0.0), lambda s, r: s + F.when(e.u > r.u, 1.0).when(e.u == r.u, 0.5).otherwise(0.0))

        total = F.aggregate(errors, F.lit(0.0), lambda s, e: s + wins(e))
        return F.when((F.size(errors) > 0) & (F.size(rights) > 0), total / (F.size(errors) * F.size(rights)))

    sides = F.struct(F.filter(pairs, lambda p: p.o == 0).alias("e"), F.filter(pairs, lambda p: p.o != 0).alias("r"))
    return let(sides, lambda s: share(s.e, s.r))
