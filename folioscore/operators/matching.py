"""Operators on whole tables that are too wide for one row's arrays."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import MINIMUM_IOU, iou
from ..session import discard, written

#: A page of so many pairs of boxes at most is matched in one group.
FEW_PAIRS = 10_000


def align_fields(reference: DataFrame, hypothesis: DataFrame, keys: list[str]) -> DataFrame:
    """Full alignment of fields by key, name and occurrence, as rows.

    keys, field_name, occurrence (from 1), reference and hypothesis (normalized values, null where a side has none).
    Both sides are shuffled by (keys, field_name) once: the window and the join share that partitioning.
    """

    def numbered(side: DataFrame, name: str) -> DataFrame:
        rows = side.select(*keys, F.posexplode("fields").alias("pos", "f")).select(*keys, "pos", F.col("f.field_name").alias("field_name"), F.col("f.normalized_value").alias(name))
        return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys, "field_name").orderBy("pos")).cast("long")).drop("pos")

    return numbered(reference, "reference").join(numbered(hypothesis, "hypothesis"), [*keys, "field_name", "occurrence"], "full")


def overlapping(reference: DataFrame, hypothesis: DataFrame, keys: list[str], minimum_iou: float) -> DataFrame:
    """keys, r, h, iou: pairs of boxes of a page that overlap by minimum_iou or more.

    A box lies in at most four cells of a grid as wide as itself (rounded up to a power of two). Boxes that overlap so much have sides
    within a factor 1 / minimum_iou, so a box enters the grids up to that much coarser than its own, and a pair
    meets in the grid of its larger box, in the one cell with the upper left corner of what they share.
    """
    coarser = math.ceil(math.log2(1 / minimum_iou))

    def celled(side: DataFrame, name: str) -> DataFrame:
        b = F.col("bbox")
        own = F.ceil(F.log2(F.greatest(b.width, b.height))).cast("int")
        rows = side.where((b.width > 0) & (b.height > 0)).select(*keys, F.col("pos").alias(name), b.alias(f"{name}_box"), own.alias(f"{name}_level"))
        rows = rows.withColumn("level", F.explode(F.sequence(F.col(f"{name}_level"), F.col(f"{name}_level") + coarser)))
        box, size = F.col(f"{name}_box"), F.pow(F.lit(2.0), F.col("level"))
        for axis, low, high in (("gx", box.x, box.x + box.width), ("gy", box.y, box.y + box.height)):
            rows = rows.withColumn(axis, F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
        return rows

    both = celled(reference, "r").join(celled(hypothesis, "h"), [*keys, "level", "gx", "gy"])
    r, h, size = F.col("r_box"), F.col("h_box"), F.pow(F.lit(2.0), F.col("level"))
    here = (F.col("level") == F.greatest("r_level", "h_level")) & (F.col("gx") == F.floor(F.greatest(r.x, h.x) / size)) & (F.col("gy") == F.floor(F.greatest(r.y, h.y) / size))
    return both.where(here).select(*keys, "r", "h", iou(r, h).alias("iou")).where(F.col("iou") >= minimum_iou)


def _fitting(reference: DataFrame, hypothesis: DataFrame, keys: list[str], minimum_iou: float) -> DataFrame:
    """match_boxes of pages with few pairs of boxes: all boxes of a page meet in one join on its keys, and what overlaps is folded.

    Both sides are shuffled by the keys at most, a row a box; grouping and fold keep that partitioning.
    """
    sides = [side.select(*keys, F.col("pos").alias(name), F.col("bbox").alias(f"{name}_box")) for side, name in ((reference, "r"), (hypothesis, "h"))]
    r, h = F.col("r_box"), F.col("h_box")
    extent = (r.width > 0) & (r.height > 0) & (h.width > 0) & (h.height > 0)
    met = sides[0].join(sides[1], keys, "left").withColumn("iou", F.when(extent, iou(r, h)))
    near = F.coalesce(F.col("iou") >= minimum_iou, F.lit(False))
    # in the order in which they are tried: references in turn, larger overlaps first, then the first hypothesis
    pair = F.struct("r", (-F.col("iou")).alias("back"), "h")
    pages = met.groupBy(*keys).agg(F.collect_set("r").alias("all"), F.array_sort(F.collect_list(F.when(near, pair))).alias("pairs"))
    nothing = F.array().cast(pages.schema["pairs"].dataType)

    def take(taken: Column, p: Column) -> Column:
        return F.when(F.exists(taken, lambda t: (t.r == p.r) | (t.h == p.h)), taken).otherwise(F.array_append(taken, p))

    pages = pages.select(*keys, "all", F.aggregate("pairs", nothing, take).alias("taken"))
    partner = F.transform("all", lambda x: F.struct(x.alias("r"), F.get(F.filter("taken", lambda t: t.r == x), 0).alias("t")))
    found = pages.select(*keys, F.explode(partner).alias("m"))
    return found.select(*keys, F.col("m.r").alias("r"), F.col("m.t.h").alias("h"), F.coalesce(-F.col("m.t.back"), F.lit(0.0)).alias("iou"))


def match_boxes(reference: DataFrame, hypothesis: DataFrame, keys: list[str], minimum_iou: float = MINIMUM_IOU) -> DataFrame:
    """``geometry.greedy_match`` in row form, for pages too wide for an array: keys, r, h (null if unmatched), iou.

    Both sides: keys, pos (the order on the page, unique there), bbox. A page of at most FEW_PAIRS pairs of boxes is matched as a group of its own,
    without cells and rounds; how many boxes a page has is counted first. Wider pages go by ``_in_rounds``. Boxes without an
    extent match nothing; minimum_iou must be above 0, as pairs that don't touch are never formed.
    """
    if not 0 < minimum_iou <= 1:
        raise ValueError("minimum_iou must be above 0 and at most 1")
    sizes = [side.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)) for side, name in ((reference, "n_r"), (hypothesis, "n_h"))]
    pairs = F.col("n_r").cast("double") * F.greatest(F.coalesce("n_h", F.lit(0)), F.lit(1))
    wide, path = written(sizes[0].join(sizes[1], keys, "left").where(pairs > FEW_PAIRS).select(*keys), "wide")
    if wide.isEmpty():
        discard(reference.sparkSession, path)
        return _fitting(reference, hypothesis, keys, minimum_iou)
    few, many = ([side.join(wide, keys, how) for side in (reference, hypothesis)] for how in ("left_anti", "left_semi"))
    return _fitting(*few, keys, minimum_iou).unionByName(_in_rounds(*many, keys, minimum_iou))


def _in_rounds(reference: DataFrame, hypothesis: DataFrame, keys: list[str], minimum_iou: float) -> DataFrame:
    """match_boxes of pages of any width, whose boxes are dealt by cells.

    A reference takes, in its turn, the free hypothesis of the largest overlap
    (ties: the first). That is found in rounds: a reference's best free candidate is its own if no earlier reference
    that is still open overlaps it. The first open reference of a neighbourhood always settles, so every round settles all
    neighbourhoods' first ones at once; rounds grow with the longest chain of neighbours, not with the page. Each round's rows are
    written to the shared folder.
    """
    spark = reference.sparkSession
    open_, path = written(overlapping(reference, hypothesis, keys, minimum_iou), "overlaps")
    settled: list[tuple[DataFrame, str]] = []
    of_r = Window.partitionBy(*keys, "r").orderBy(F.col("iou").desc(), "h")
    while not open_.isEmpty():
        ranked = open_.withColumn("first", F.min("r").over(Window.partitionBy(*keys, "h"))).withColumn("best", F.row_number().over(of_r))
        now, now_path = written(ranked.where("best = 1 AND first = r").select(*keys, "r", "h", "iou"), "settled")
        settled.append((now, now_path))
        left = open_.join(now.select(*keys, "r"), [*keys, "r"], "left_anti").join(now.select(*keys, "h"), [*keys, "h"], "left_anti")
        after, after_path = written(left, "overlaps")
        discard(spark, path)
        open_, path = after, after_path
    discard(spark, path)
    found = reduce(DataFrame.unionByName, [t for t, _ in settled], open_.limit(0))
    matched, _ = written(found, "matched")
    discard(spark, *[p for _, p in settled])
    return reference.select(*keys, F.col("pos").alias("r")).join(matched, [*keys, "r"], "left").select(*keys, "r", "h", F.coalesce("iou", F.lit(0.0)).alias("iou"))
