"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards carries weights. A row descends it: at each level every child draws
-ln(u) / weight, where u is a hash of the row's key and the child's path, and the smallest draw wins
(weighted rendezvous). A child's share is its weight's share, and its draw depends on nothing but the key,
its own path and its own weight. So a changed weight moves rows only into or out of the subtrees on its path;
inside an untouched subtree nothing moves. A tree that grows by whole regions therefore sends rows only into
the new region: that is how ``grown`` adds a shard, and so the law ``key`` holds.

All of it is column expressions; rows of the tree (shards, not data) are literals. Slots are gapless by
sub-group counts (see gapless_ranks), so a shard of any size never meets in one task.

Edge cases: a null key hashes as its own value; equal keys share a shard, whatever their texts; a null text
has no bytes (size 16, CRC 0). Repeated rows get a slot each; an empty table gives none. Only the size and the CRC of a text are kept, however long it is.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bucket_count, documents, gapless_ranks

OVERHEAD_BYTES = 16


@dataclass(frozen=True)
class HashTree:
    """regions[i][j][k] is the weight of shard k of rack j of region i; shards are numbered in that order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    def __post_init__(self):
        if not self.regions or not all(r and all(k and all(w > 0 for w in k) for k in r) for r in self.regions):
            raise ValueError("each region needs racks, each rack shards, each shard a weight above 0")

    @staticmethod
    def even(regions: int, racks: int, shards: int) -> HashTree:
        return HashTree((((1.0,) * shards,) * racks,) * regions)

    @property
    def shards(self) -> int:
        return sum(len(k) for r in self.regions for k in r)

    def grown(self, weight: float = 1.0) -> HashTree:
        """The tree with one more shard, in a region of its own."""
        return HashTree((*self.regions, ((weight,),)))


def _draw(key: Column, level: str, parents: list[Column], child: Column, weight: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), *parents, child), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.ln(u) / weight


def _winner(key: Column, level: str, children: Column, *parents: Column) -> Column:
    """The position of the child of the smallest draw; ties go to the first child."""
    drawn = F.transform(children, lambda w, i: F.struct(_draw(key, level, list(parents), i, w).alias("d"), i.alias("i")))
    return F.array_min(drawn).i


def shard_of(key: Column, tree: HashTree) -> Column:
    """The number of the shard to which the key descends."""
    def doubles(xs) -> Column:
        return F.array(*map(F.lit, xs))

    racks = F.array(*[doubles(sum(k) for k in r) for r in tree.regions])
    shards = F.array(*[F.array(*[doubles(k) for k in r]) for r in tree.regions])
    first, n = [], 0
    for r in tree.regions:
        first.append(F.array(*[F.lit(n + sum(map(len, r[:j]))) for j in range(len(r))]))
        n += sum(map(len, r))
    one = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  a let: value is evaluated once
    return one(
        _winner(key, "region", doubles(sum(map(sum, r)) for r in tree.regions)),
        lambda region: one(
            _winner(key, "rack", F.get(racks, region), region),
            lambda rack: F.get(F.get(F.array(*first), region), rack) + _winner(key, "shard", F.get(F.get(shards, region), rack), region, rack),
        ),
    )


def assign_shards(docs: DataFrame, tree: HashTree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of each row."""
    raw = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(raw) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), tree).alias("shard"),
        shard_of(F.col(key), tree.grown()).alias("grown_shard"),
    )
    order = [F.col(key), F.col("text_crc32"), F.col("size")]
    ranked = gapless_ranks(rows, ["shard"], order, F.xxhash64(F.col(key), F.col("text_crc32")), "slot", bucket_count(docs.sparkSession))
    return ranked.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: 5 regions of 2 racks of 4 shards.
TREE = HashTree.even(5, 2, 4)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), TREE)
