"""Structured fields: alignment by name and occurrence, and the scores of an extraction.

A field has field_name, normalized_value and bbox. An extraction's fields lie in one array (a form has tens of them), so
they are aligned inside the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let, iou

#: Fixed value: names of amounts, between separators.
FINANCIAL = r"(?i)(^|[_.\-\[\]])(ht|tva|ttc|quantity|unit_price|line_total)([_.\-\[\]]|$)"


def is_financial(name: Column) -> Column:
    return name.rlike(FINANCIAL)


def aligned(reference: Column, hypothesis: Column) -> Column:
    """For each reference field (r), the hypothesis field (h, or null) of its name and occurrence."""

    def numbered(fields: Column) -> Column:
        return let(F.transform(fields, lambda f: f.field_name), lambda names: F.transform(fields, lambda f, i: F.struct(f.alias("f"), F.size(F.filter(F.slice(names, F.lit(1), i), lambda n: n == f.field_name)).alias("k"))))

    def paired(others: Column) -> Column:
        return F.transform(
            numbered(reference),
            lambda r: F.struct(r.f.alias("r"), F.get(F.filter(others, lambda h: (h.f.field_name == r.f.field_name) & (h.k == r.k)), 0).f.alias("h")),
        )

    return let(numbered(hypothesis), paired)


def field_scores(reference: Column, hypothesis: Column) -> Column:
    """precision, recall, f1, exact_accuracy, coordinate_iou, hallucination_rate, financial_accuracy and counts."""
    return let(F.struct(reference.alias("r"), hypothesis.alias("h")), lambda s: let(aligned(s.r, s.h), lambda pairs: _scores(s.r, s.h, pairs)))


def _scores(reference: Column, hypothesis: Column, pairs: Column) -> Column:
    exact = F.filter(pairs, lambda p: F.coalesce(p.r.normalized_value.eqNullSafe(p.h.normalized_value) & p.h.isNotNull(), F.lit(False)))
    n_ref, n_hyp = F.size(reference), F.size(hypothesis)
    n_exact = F.size(exact)
    boxed = F.filter(exact, lambda p: p.r.bbox.isNotNull() & p.h.bbox.isNotNull())
    overlap = F.aggregate(boxed, F.lit(0.0), lambda s, p: s + iou(p.r.bbox, p.h.bbox))
    partners = F.size(F.filter(pairs, lambda p: p.h.isNotNull()))
    n_fin = F.size(F.filter(reference, lambda f: is_financial(f.field_name)))
    fin = F.size(F.filter(exact, lambda p: is_financial(p.r.field_name)))
    precision, recall = n_exact / F.greatest(n_hyp, F.lit(1)), n_exact / F.greatest(n_ref, F.lit(1))
    return F.struct(
        precision.alias("precision"),
        recall.alias("recall"),
        (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).alias("f1"),
        recall.alias("exact_accuracy"),
        F.when(F.size(boxed) > 0, overlap / F.size(boxed)).otherwise(0.0).alias("coordinate_iou"),
        ((n_hyp - partners) / F.greatest(n_hyp, F.lit(1))).alias("hallucination_rate"),
        (fin / F.greatest(n_fin, F.lit(1))).alias("financial_accuracy"),
        n_ref.alias("n_reference"),
        n_fin.alias("n_financial"),
    )
