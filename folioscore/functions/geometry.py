"""Boxes and blocks of a page: overlap, greedy matching, layout, tables, equations, diagrams, reading order.

A box is a struct of x, y, width, height; a block has block_id, block_type, bbox, reading_order_index and more.
Matching stays inside a page: no shuffle. A batch of pages is matched at once, in numpy.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from .text import on_workers, order_score

MINIMUM_IOU = 0.1
DIAGRAMS = ("diagram", "figure")
MATCHES = ArrayType(StructType().add("h", IntegerType()).add("iou", DoubleType()))
#: Hypothesis boxes compared at a time (a page with more goes alone): bounds a worker's memory.
MAX_BOXES = 65_536


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    width = F.greatest(F.lit(0.0), F.least(a.x + a.width, b.x + b.width) - F.greatest(a.x, b.x))
    height = F.greatest(F.lit(0.0), F.least(a.y + a.height, b.y + b.height) - F.greatest(a.y, b.y))
    both = width * height
    union = a.width * a.height + b.width * b.height - both
    return F.when(union > 0, both / union).otherwise(0.0)


def greedy_match(reference: Column, hypothesis: Column, minimum_iou: float = MINIMUM_IOU) -> Column:
    """For each reference box in turn, the unused hypothesis box of the largest overlap (ties: the first).

    An array as long as the reference of (h: its position or null, iou). Below minimum_iou a reference stays
    unmatched and the candidate free. Python: not for use within a lambda function (see also ordered_boxes).
    """
    if not 0 <= minimum_iou <= 1:
        raise ValueError("minimum_iou must be within 0 and 1")
    return on_workers(_matcher(float(minimum_iou))(_numbers(reference), _numbers(hypothesis)))


def _numbers(boxes: Column) -> Column:
    """x, y, width and height of each box in turn: one flat array, since each nested field costs a vector a row on the way to Python."""
    return F.flatten(F.transform(boxes, lambda b: F.array(*[b[name].cast("double") for name in ("x", "y", "width", "height")])))


def _sides(pages: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Boxes of each page (0 if null), where they start, and x, y, width, height of all, nan for null."""
    sizes = pc.fill_null(pc.list_value_length(pages), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    flat = pages.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 4)
    return sizes, np.cumsum(sizes) - sizes, list(np.ascontiguousarray(flat.T))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """iou, position by position; 0 where it is no number."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    both = np.fmax(0.0, np.fmin(ax + aw, bx + bw) - np.fmax(ax, bx)) * np.fmax(0.0, np.fmin(ay + ah, by + bh) - np.fmax(ay, by))
    union = aw * ah + bw * bh - both
    found = np.zeros(len(both))
    np.divide(both, union, out=found, where=union > 0)
    found[np.isnan(found)] = 0.0
    return found


def match_pages(reference: pa.Array, hypothesis: pa.Array, minimum_iou: float) -> pa.Array:
    """greedy_match of a batch of pages (the four numbers of each box in turn): the first references of all pages at once, then the second ones, and so on."""
    r_sizes, r_starts, r = _sides(reference)
    h_sizes, h_starts, h = _sides(hypothesis)
    partner, overlap = np.full(len(r[0]), -1, np.int32), np.zeros(len(r[0]))
    used = np.zeros(len(h[0]), bool)
    matchable = np.flatnonzero((r_sizes > 0) & (h_sizes > 0))
    slices = np.split(matchable, np.flatnonzero(np.diff(np.cumsum(h_sizes[matchable]) // MAX_BOXES)) + 1)
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        for pages in slices:
            k = kept = 0
            while len(pages := pages[r_sizes[pages] > k]):
                if kept != len(pages):  # all boxes of these pages, page after page
                    kept, counts = len(pages), h_sizes[pages]
                    begins = np.cumsum(counts) - counts
                    own = np.repeat(np.arange(kept), counts)
                    at = np.arange(len(own)) + (h_starts[pages] - begins)[own]
                    candidates = [v[at] for v in h]
                box = r_starts[pages] + k
                found = _overlaps([v[box][own] for v in r], candidates)
                found[used[at]] = -1.0
                best = np.maximum.reduceat(found, begins)
                tops = np.flatnonzero(found == best[own])
                first = tops[np.flatnonzero(np.diff(own[tops], prepend=-1))]
                hit = best >= minimum_iou
                taken = at[first[hit]]
                used[taken] = True
                partner[box[hit]] = taken - h_starts[pages[hit]]
                overlap[box[hit]] = best[hit]
                k += 1
    rows = pa.StructArray.from_arrays([pa.array(partner, pa.int32(), mask=partner < 0), pa.array(overlap)], ["h", "iou"])
    offsets = np.append(r_starts, len(partner)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows, mask=reference.is_null())


@functools.cache
def _matcher(minimum_iou: float):
    @F.arrow_udf(MATCHES)
    def matches(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
        return match_pages(reference, hypothesis, minimum_iou)

    # Declared non-deterministic so that the optimizer computes it once, as a column, and never moves it into a lambda
    # function, where no Python runs.
    return matches.asNondeterministic()


def boxes(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: b.bbox)


def of_types(blocks: Column, *types: str) -> Column:
    return F.filter(blocks, lambda b: b.block_type.isin(*types))


def matched(matches: Column) -> Column:
    """Matches that have a partner."""
    return F.filter(matches, lambda m: m.h.isNotNull())


def total_iou(matches: Column) -> Column:
    return F.aggregate(matches, F.lit(0.0), lambda s, m: s + F.when(m.h.isNotNull(), m.iou).otherwise(0.0))


def layout(reference: Column, hypothesis: Column, matches: Column) -> Column:
    """(block_count, correct_type, iou, matched) of a page, from its matching in document order."""
    correct = F.filter(F.arrays_zip(reference.alias("r"), matches.alias("m")), lambda p: p.m.h.isNotNull() & (p.r.block_type == F.get(hypothesis, p.m.h).block_type))
    return F.struct(
        F.greatest(F.size(reference), F.size(hypothesis)).alias("block_count"),
        F.size(correct).alias("correct_type"),
        total_iou(matches).alias("iou"),
        F.size(matched(matches)).alias("matched"),
    )


def cell_keys(table: Column) -> Column:
    return F.array_distinct(F.transform(table.cells, lambda c: F.struct(c.row_index.alias("r"), c.column_index.alias("c"), c.row_span.alias("rs"), c.column_span.alias("cs"))))


def table_similarity(reference: Column, hypothesis: Column) -> Column:
    """Half for equal numbers of rows and columns, half the F1 of the sets of cell places; 0 without a hypothesis."""
    a, b = cell_keys(reference), cell_keys(hypothesis)
    grid = ((reference.rows == hypothesis.rows) & (reference.columns == hypothesis.columns)).cast("double")
    f1 = 2.0 * F.size(F.array_intersect(a, b)) / F.greatest(F.size(a) + F.size(b), F.lit(1))
    return F.when(hypothesis.isNull(), 0.0).otherwise(0.5 * grid + 0.5 * f1)


def _mean_over(matches: Column, references: Column, score) -> Column:
    """Mean over the references of score(reference, partner's position), 0 without one; null without references."""
    pairs = F.arrays_zip(references.alias("r"), matches.alias("m"))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.when(p.m.h.isNotNull(), score(p.r, p.m.h)).otherwise(0.0))
    return F.when(F.size(references) > 0, total / F.size(references))


def table_page_score(reference: Column, hypothesis: Column) -> Column:
    """reference: table blocks with a table; hypothesis: all table blocks."""
    return _mean_over(greedy_match(boxes(reference), boxes(hypothesis)), reference, lambda r, h: table_similarity(r.table, F.get(hypothesis, h).table))


def equation_page_score(reference: Column, hypothesis: Column) -> Column:
    """Equation blocks as structs with bbox and ``text``, their normalised text."""

    def score(r: Column, h: Column) -> Column:
        return let(F.get(hypothesis, h).text, lambda other: one(r, other))

    def one(r: Column, other: Column) -> Column:
        return 1 - F.levenshtein(r.text, other) / F.greatest(F.char_length(r.text), F.char_length(other), F.lit(1))

    return _mean_over(greedy_match(boxes(reference), boxes(hypothesis)), reference, score)


def diagram_counts(reference: Column, hypothesis: Column) -> Column:
    """(matched, reference, hypothesis) of diagram and figure blocks."""
    r, h = of_types(reference, *DIAGRAMS), of_types(hypothesis, *DIAGRAMS)
    return F.struct(F.size(matched(greedy_match(boxes(r), boxes(h)))).alias("matched"), F.size(r).alias("reference"), F.size(h).alias("hypothesis"))


def in_reading_order(items: Column) -> Column:
    """Sorted by reading_order_index, ties in array order. Only keys are sorted: items may hold what has no order."""

    def sort(own: Column) -> Column:
        keys = F.sort_array(F.transform(own, lambda b, i: F.struct(b.reading_order_index.alias("k"), i.alias("i"))))
        return F.transform(keys, lambda k: F.get(own, k.i))

    return let(items, sort)


def let(value: Column, body) -> Column:
    """body(value), with value computed once: lambda functions would compute a captured expression at every use."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def ordered_boxes(blocks: Column) -> Column:
    """(id, bbox) of the blocks in reading order.

    No lambda function here uses another's variable: from a Python function's argument with such a one Spark can't
    extract the function ("Cannot evaluate expression").
    """
    keyed = F.transform(blocks, lambda b, i: F.struct(b.reading_order_index.alias("k"), i.alias("i"), b.block_id.alias("id"), b.bbox.alias("bbox")))
    return F.transform(F.sort_array(keyed), lambda b: F.struct(b.id.alias("id"), b.bbox.alias("bbox")))


def comparable_orders(reference: Column, hypothesis: Column) -> Column:
    """(reference, hypothesis): block ids in reading order, hypothesis ids replaced by those of their partners."""
    r, h = ordered_boxes(reference), ordered_boxes(hypothesis)
    return partner_orders(r, h, greedy_match(boxes(r), boxes(h)))


def partner_orders(reference: Column, hypothesis: Column, matches: Column) -> Column:
    """comparable_orders from ordered_boxes of both sides and their matching."""

    def pairs(s: Column) -> Column:
        """The partners' ids, (h, r), the last match first: of equal hypothesis ids it counts."""
        ids = F.transform(s.m, lambda x, i: F.struct(F.get(s.h, x.h).id.alias("h"), F.get(s.r, i).id.alias("r")))
        return F.reverse(F.filter(ids, lambda p: p.h.isNotNull()))

    def mapped(s: Column, known: Column) -> Column:
        own = F.transform(s.h, lambda b, i: F.coalesce(F.get(F.filter(known, lambda p: p.h == b.id), 0).r, F.concat(F.lit("unmatched:"), i.cast("string"))))
        return F.struct(F.transform(s.r, lambda b: b.id).alias("reference"), own.alias("hypothesis"))

    return let(F.struct(reference.alias("r"), hypothesis.alias("h"), matches.alias("m")), lambda s: let(pairs(s), lambda known: mapped(s, known)))


def reading_order_score(orders: Column) -> Column:
    return order_score(orders.reference, orders.hypothesis)


def flat_lines(blocks: Column) -> Column:
    """All lines of a page in reading order of blocks, then of lines."""
    return F.flatten(F.transform(in_reading_order(blocks), lambda b: in_reading_order(F.coalesce(b.lines, F.array()))))


def page_text(blocks: Column) -> Column:
    """Lines' normalized_text joined by line ends; neither cells nor equations."""
    return F.array_join(F.transform(flat_lines(blocks), lambda x: x.normalized_text), "\n")


def block_text(block: Column, empty_equation_counts: bool = False) -> Column:
    """equation_text, else the joined lines; an empty equation_text counts only for the equation metric."""
    equation = block.equation_text if empty_equation_counts else F.nullif(block.equation_text, F.lit(""))
    return F.coalesce(equation, F.array_join(F.transform(block.lines, lambda x: x.normalized_text), "\n"))


def grid_cells(box: Column, rows: Column, columns: Column) -> Column:
    """Cells of equal size that fill a box, row by row."""
    width, height = box.width / columns, box.height / rows
    at = F.sequence(F.lit(0), rows * columns - 1)

    def cell(i: Column) -> Column:
        r, c = F.floor(i / columns).cast("int"), F.pmod(i, columns).cast("int")
        return F.struct(r.alias("row_index"), c.alias("column_index"), F.lit(1).alias("row_span"), F.lit(1).alias("column_span"),
            F.struct((box.x + c * width).alias("x"), (box.y + r * height).alias("y"), width.alias("width"), height.alias("height")).alias("bbox"))

    return F.transform(at, cell)
