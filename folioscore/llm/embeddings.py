"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned to the principal axes of all of them, so that their leading coordinates hold most.
Two vectors with a cosine of at least t are at most r = sqrt(2 - 2t) apart in every set of coordinates. So a grid of width r
over the GRID leading coordinates makes cells: a vector lives in one cell, and visits each later neighbour cell whose
box is within r. A pair then meets exactly once. A cell with many vectors is cut into blocks of about TILE by the hash of
their ids, and a tile is a pair of blocks: no task ever holds more than two blocks, however many near copies there are.

In a tile, products of the leading coordinates are accumulated first, a few at a time; what the others can add is
bounded by the product of the suffix norms, and pairs that cannot reach the threshold any more are given up. The rest are decided by
the whole product in the vectors' own coordinates, in double precision. A tile gives out a count for each vector and links that
join what it has linked (fewer than vectors), never all pairs.

Exact copies are one vector with a number. Equality is told by a 128-bit digest of the values. The axes come from the second
moments of all vectors of the commonest length (partial sums of each task, added up by Spark; the decomposition runs in a task); they
decide only how early pairs are given up, never which are linked.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing and are their own
component. Vectors link only with those of their length. A null vec_id is linked like any other and never names a component, unless
all of a component's are null; it isn't kept. Rows with equal vec_ids are rows of their own. An empty table gives none. Other
columns, whatever their names, are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, StructField, StructType

from .components import components
from .shared import map_batches, ship_package, stored, unused

THRESHOLD = 0.95
GRID = 4
TILE = 2_048
#: Cells whose sizes may be broadcast (28 bytes each).
FEW_CELLS = 200_000
#: Leading coordinates after which a tile looks which pairs can still reach the threshold.
STEPS = (8, 16, 32, 64)
#: Longer vectors keep their own axes.
MAX_DIMS = 2_048
#: Pairs are given up only if they miss the threshold by more than any rounding.
SLACK = 1e-6
#: Rows of a block that are compared at once, and pairs whose products are taken at once.
SOME_ROWS, SOME_PAIRS = 256, 65_536


# -- vectors -------------------------------------------------------------------------------------------------------


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the vectors that are not null and hold no null."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        values = vectors.take(pa.array(rows)).flatten()
        if values.null_count:
            holes = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(axis=1)
            yield rows[~holes], pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False).reshape(-1, d)[~holes].astype(np.float64)
        else:
            yield rows, values.to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """The rows at length one; scaled by their largest value first, so that no square is out of range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _keys(batch: pa.RecordBatch) -> dict:
    keys: list[bytes | None] = [None] * batch.num_rows
    for rows, x in _matrices(batch.column(1)):
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        x = x + 0.0  # -0.0 is 0.0
        for i, v in zip(rows[good].tolist(), x[good], strict=True):
            keys[i] = xxhash.xxh3_128_digest(v.tobytes())
    return {"id": batch.column(0), "v": batch.column(1), "k": pa.array(keys, pa.binary())}


def _moments(batches: Iterable[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((d, d))
    for batch in batches:
        for _, x in _matrices(batch.column(0)):
            if x.shape[1] == d:
                u = unit(x)
                total += u.T @ u
    i, j = np.triu_indices(d)
    yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})


def _axes(batches: Iterable[pa.RecordBatch], d: int, kept: int) -> Iterator[pa.RecordBatch]:
    """The leading eigenvectors of the summed moments."""
    whole = np.zeros((d, d))
    for b in batches:
        i, j, s = (c.to_numpy() for c in b.columns)
        whole[i, j] = whole[j, i] = s
    vectors = np.linalg.eigh(whole)[1][:, ::-1][:, :kept]
    yield pa.RecordBatch.from_pydict({"k": pa.array(range(vectors.shape[1]), pa.int32()), "axis": pa.array(list(vectors.T), pa.list_(pa.float64()))})


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """{length: leading axes as columns} for the commonest length of ``vectors`` (column v); a few hundred KB at most."""
    common = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if common is None or common.d > MAX_DIMS:
        return {}
    d, kept = common.d, min(common.d, STEPS[-1])
    sums = vectors.select("v").mapInArrow(functools.partial(_moments, d=d), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    # at most MAX_DIMS squared numbers: one task; not on the driver, whose threads of linear algebra may be in use
    found = sums.coalesce(1).mapInArrow(functools.partial(_axes, d=d, kept=kept), "k int, axis array<double>").orderBy("k").collect()
    return {d: np.array([r.axis for r in found]).T}


def _leading(u: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates on the leading axes (the vectors' own ones where no axes are known)."""
    own = axes.get(u.shape[1])
    return u[:, : STEPS[-1]] if own is None else u @ own


# -- cells and tiles -----------------------------------------------------------------------------------------------


def _cells(batch: pa.RecordBatch, axes: dict[int, np.ndarray], reach: float) -> Iterator[pa.RecordBatch]:
    """Each vector in its own cell, and in the later neighbour cells within reach of it."""
    width = reach * (1 + 1e-9)
    names = ["d", "cell", "home", "id", "n", "v"]
    for rows, x in _matrices(batch.column(2)):
        d = x.shape[1]
        y = _leading(unit(x), axes)[:, :GRID]
        c = np.floor(y / width).astype(np.int64)
        up, down = (c + 1) * width - y, y - c * width
        place = (1 << 16) ** np.arange(y.shape[1], dtype=np.int64)
        own = ((c + (1 << 15)) * place).sum(axis=1)
        for step in itertools.product((0, 1, -1), repeat=y.shape[1]):
            o = np.array(step, np.int64)
            moved = np.flatnonzero(o)
            if len(moved) and o[moved[0]] < 0:  # an earlier cell visits this one
                continue
            gap = np.where(o > 0, up, np.where(o < 0, down, 0.0))
            near = np.flatnonzero((gap * gap).sum(axis=1) <= reach * reach * (1 + 1e-6))
            if len(near):
                at = pa.array(rows[near])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), d, np.int32)), pa.array(own[near] + int((o * place).sum())), pa.array(np.full(len(near), not len(moved))), *(batch.column(k).take(at) for k in range(3))], names=names)


def tiles(vectors: DataFrame, axes: dict[int, np.ndarray], threshold: float, tile: int = TILE) -> DataFrame:
    """Rows of (d, cell, a, b): the vectors of blocks a and b, which are to be compared. side 0 is block a's.

    vectors: id, n, v. Blocks 0 .. homes - 1 hold a cell's own vectors, those from homes on its visitors, which
    meet all of its own and not each other.
    """
    reach = math.sqrt(2 - 2 * threshold)
    element = vectors.schema["v"].dataType.elementType.simpleString()
    placed = map_batches(vectors.select("id", "n", "v"), functools.partial(_cells, axes=axes, reach=reach), f"d int, cell long, home boolean, id long, n long, v array<{element}>")
    placed, _ = stored(placed, "cells")
    sizes = placed.groupBy("d", "cell").agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("guests")).where("own > 0 AND own + guests > 1")
    blocks = sizes.select("d", "cell", F.ceil(F.col("own") / tile).cast("int").alias("homes"), F.ceil(F.col("guests") / tile).cast("int").alias("visits"))
    blocks, _ = stored(blocks, "blocks")
    few = blocks.count() <= FEW_CELLS  # the grid bounds them for each length of vectors
    rows = placed.join(F.broadcast(blocks) if few else blocks, ["d", "cell"])
    block = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("visits"))).cast("int")
    k, homes, every = F.col("block"), F.col("homes"), F.col("homes") + F.col("visits")
    pair = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))
    as_home = F.concat(F.transform(F.sequence(k, every - 1), lambda b: pair(k, b, 0)), F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda a: pair(a, k, 1))).otherwise(F.array()))
    as_guest = F.transform(F.sequence(F.lit(0), homes - 1), lambda a: pair(a, k + homes, 1))
    dealt = rows.withColumn("block", block).select("d", "cell", "id", "n", "v", F.explode(F.when(F.col("home"), as_home).otherwise(as_guest)).alias("t"))
    return dealt.select("d", "cell", "t.a", "t.b", "t.side", "id", "n", "v")


def _close(a: np.ndarray, b: np.ndarray, lead_a: np.ndarray, lead_b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of the rows of a and b with a cosine of threshold or more."""
    steps = [k for k in STEPS if k < lead_a.shape[1]] + [lead_a.shape[1]]
    rest_a, rest_b = ([np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x[:, :k], x[:, :k]), 0)) for k in steps] for x in (lead_a, lead_b))
    for at in range(0, len(b), SOME_ROWS):
        part = slice(at, at + SOME_ROWS)
        product = lead_a[:, : steps[0]] @ lead_b[part, : steps[0]].T
        i, j = np.nonzero(product + np.outer(rest_a[0], rest_b[0][part]) >= threshold - SLACK)
        product, j = product[i, j], j + at
        for k, (low, high) in enumerate(itertools.pairwise(steps), 1):
            for some in range(0, len(i), SOME_PAIRS):
                s = slice(some, some + SOME_PAIRS)
                product[s] += np.einsum("ij,ij->i", lead_a[i[s], low:high], lead_b[j[s], low:high])
            alive = product + rest_a[k][i] * rest_b[k][j] >= threshold - SLACK
            i, j, product = i[alive], j[alive], product[alive]
        for some in range(0, len(i), SOME_PAIRS):
            x, y = i[some : some + SOME_PAIRS], j[some : some + SOME_PAIRS]
            linked = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            yield x[linked], y[linked]


def _joined(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> None:
    """label: the smallest node that each node can reach, with the links i - j added."""
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label[:] = label[label]
        if (label == before).all():
            return


def _compare(key: tuple, rows: pa.Table, axes: dict[int, np.ndarray], threshold: float) -> pa.Table:
    """(a, b, links): a count of links for each vector (b null), and links that join the linked ones (links null)."""
    d, _, block_a, block_b = (x.as_py() for x in key)
    rows = rows.combine_chunks()
    side, ids, n = (rows.column(c).to_numpy() for c in ("side", "id", "n"))
    u = unit(rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64))
    lead = _leading(u, axes)
    left = np.flatnonzero(side == 0)
    right = left if block_a == block_b else np.flatnonzero(side == 1)
    counts, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i, j in _close(u[left], u[right], lead[left], lead[right], threshold):
        x, y = left[i], right[j]
        if block_a == block_b:
            x, y = x[i < j], y[i < j]
        if len(x):
            np.add.at(counts, x, n[y])
            np.add.at(counts, y, n[x])
            _joined(x, y, label)
    counted, moved = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(ids)))
    no = pa.nulls(len(moved), pa.int64())
    return pa.table({
        "a": pa.array(np.concatenate([ids[counted], ids[moved]])),
        "b": pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(ids[label[moved]])]),
        "links": pa.concat_arrays([pa.array(counts[counted]), no]),
    })


# -- results -------------------------------------------------------------------------------------------------------


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row: others linked directly, the smallest vec_id reachable; and k, the vector's digest."""

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _compare(key, rows, axes, threshold)

    ship_package(table.sparkSession)
    kind = table.schema[column].dataType
    element = kind.elementType if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType | DoubleType) else DoubleType()
    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col(column).cast(ArrayType(element)).alias("v"))
    keyed, _ = stored(map_batches(rows, _keys, f"id long, v array<{element.simpleString()}>, k binary"), "vectors")
    grouped = keyed.where("k IS NOT NULL").groupBy("k").agg(F.first("v").alias("v"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    distinct, _ = stored(grouped.withColumn("id", F.monotonically_increasing_id()), "distinct")
    axes = principal_axes(distinct)
    parts = tiles(distinct, axes, threshold, tile).repartition("d", "cell", "a", "b").groupBy("d", "cell", "a", "b")  # a cell's tiles go to different tasks
    compared, _ = stored(parts.applyInArrow(compare, "a long, b long, links long"), "links")
    counts = compared.where("links IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    roots = components(compared.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("id"), "root")
    known = distinct.drop("v").join(counts, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    known, _ = stored(known.select("k", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "linked")
    named = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("k", "n_links", "component_id")
    out = keyed.select("id", "k").join(named, "k", "left")
    component = F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), "k")


def _with_key(batch: pa.RecordBatch, column: str, name: str) -> pa.RecordBatch:
    vectors = batch.column(batch.schema.names.index(column))
    return batch.append_column(name, _keys(pa.RecordBatch.from_arrays([vectors, vectors], names=["id", "v"]))["k"])


def keep_one(table: DataFrame, threshold: float = THRESHOLD, column: str = "embedding") -> DataFrame:
    """The rows of table that name their component (repeated rows all do)."""
    i, k, own = unused(table, "_id", "_k", "_own")
    kept = near_duplicates(table, threshold, column=column).where("kept").select(F.col("vec_id").alias(i), F.col("k").alias(k)).distinct()
    keyed = map_batches(table, functools.partial(_with_key, column=column, name=own), StructType([*table.schema.fields, StructField(own, BinaryType())]))
    return keyed.join(kept, (F.col("vec_id").cast("long") == F.col(i)) & F.col(own).eqNullSafe(F.col(k)), "left_semi").drop(own)


#: The same by all pairs, for DuckDB: vectors that count, their links, and the least vector that each can reach.
SQL = f"""
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), link AS (
  SELECT a.r AS a, a.vec_id AS vec_id, b.r AS b, b.vec_id AS other FROM good a JOIN good b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= {THRESHOLD}
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, link.other FROM reach JOIN link ON link.vec_id = reach.other
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.vec_id = e.vec_id) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.vec_id = e.vec_id
"""


def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("k")
