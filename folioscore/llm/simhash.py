"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: over the XXH64 (seed 42) of a text's three-word shingles, a bit is 1 if it is set in more than half.
Two fingerprints link if at most three bits differ. Cut into two segments of 32 bits, at least one segment
then differs in at most one bit. So each fingerprint is indexed under 64 variants: a segment, one of its bits
wiped out (a wildcard), the other 31 as they are. An equality match on a variant makes candidates, and the
whole fingerprints verify them.

Hot groups. Copies have one fingerprint and enter once. Many near copies can share a segment value; a value with
more than HOT fingerprints (an aggregate of two rows a fingerprint tells) is indexed finer, without a loss:
pairs that differ in one bit of that segment differ in at most two of the other, so they agree on one of its
thirds; pairs equal in that segment differ in at most three bits of the other, so one of its halves differs in at
most one bit (a wildcard variant again). In a bucket, members are compared in numpy while the bucket streams by (one that is
large all the same is cut again, by the bits that vary in it), and only links that join two parts of it are given out (fewer than members), never all pairs.

Components of the links are found on the executors (see components), and a document's component_id is the smallest
doc_id with a fingerprint that is reachable.

Edge cases: null, empty and blank texts have the fingerprint zero and link like any other; fewer than three words
are one shingle. Repeated rows are in one component, a row each; a null doc_id counts only where no other is
there. An empty table gives none. Texts of any length are read whole. Other columns, whatever their names, are ignored, and
``keep_one`` keeps them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import documents, map_batches, ship_package, stored, unused

SEED = 42
SHINGLE = 3
MAX_BITS = 3
HOT = 256
#: Buckets up to this size give out all their links; larger ones a spanning forest.
SMALL_BUCKET = 6
#: Buckets over this size are cut into finer ones before their members are compared.
FOREST = 2_048


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z, and only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    count = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # the bits of a very long text don't all lie in memory at once
        count += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n).view(np.uint64)[0])


def _fingerprints(batch: pa.RecordBatch, width: int) -> dict:
    prints = np.fromiter((fingerprint(t, width) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows).view(np.int64)
    return {"doc_id": batch.column(0), "h": batch.column(1), "fp": pa.array(prints)}


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, h (the text's hash) and fp (long, the fingerprint's bits) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return map_batches(rows, functools.partial(_fingerprints, width=width), "doc_id long, h long, fp long")


def _segment(fp: Column, k: int) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF)) if k == 0 else F.shiftrightunsigned(fp, 32)


def _bits(n: int) -> Column:
    return F.array(*[F.lit(i) for i in range(n)])


def variants(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, fp): the variants of each distinct fingerprint. A key is exact: its fields fill separate bits."""
    spark_segments = F.array(*[F.struct(F.lit(k).cast("long").alias("seg"), _segment(F.col("fp"), k).alias("v"), _segment(F.col("fp"), 1 - k).alias("w")) for k in (0, 1)])
    rows = prints.select("fp", F.explode(spark_segments).alias("s")).select("fp", "s.*")
    # Which wildcard buckets are hot: those of a hot value, from its own side and from the other side of the bit.
    often = rows.groupBy("seg", "v").count().where(F.col("count") > hot // 2).select("seg", "v")
    own = often.select("seg", "v", F.lit(0xFFFFFFFF).alias("mask"))
    sides = often.select("seg", "v", F.explode(_bits(32)).alias("i")).select("seg", F.expr("v ^ shiftleft(1L, i)").alias("v"), F.expr("shiftleft(1L, i)").alias("mask"))
    masks = own.union(sides).groupBy("seg", "v").agg(F.bit_or("mask").alias("mask"))
    marked = rows.join(masks, ["seg", "v"], "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    # Fields from the left: kind (2 bits), segment (1), then those of the kind.
    plain = "transform(filter(sequence(0, 31), i -> (mask & shiftleft(1L, i)) = 0), i -> shiftleft(seg, 61) | shiftleft(CAST(i AS BIGINT), 32) | (v & ~shiftleft(1L, i)))"
    thirds = "array(w & 2047, shiftright(w, 11) & 2047, shiftright(w, 22))"
    near = f"flatten(transform(filter(sequence(0, 31), i -> (mask & shiftleft(1L, i)) <> 0), i -> transform({thirds}, (x, t) -> shiftleft(1L, 62) | shiftleft(seg, 61) | shiftleft(CAST(i AS BIGINT), 45) | shiftleft(CAST(t AS BIGINT), 43) | shiftleft(x, 32) | (v & ~shiftleft(1L, i)))))"
    halves = "array(w & 65535, shiftright(w, 16))"
    equal = f"flatten(transform({halves}, (x, h) -> transform(sequence(0, 15), j -> shiftleft(2L, 62) | shiftleft(seg, 61) | shiftleft(CAST(h AS BIGINT), 52) | shiftleft(CAST(j AS BIGINT), 48) | shiftleft(x & ~shiftleft(1L, j), 32) | v)))"
    keys = F.when(F.col("mask") == 0, F.expr(plain)).otherwise(F.concat(F.expr(plain), F.expr(near), F.when(F.col("mask") == 0xFFFFFFFF, F.expr(equal)).otherwise(F.array().cast("array<bigint>"))))
    return marked.select("fp", F.explode(keys).alias("key")).select("key", "fp")


def _forest(members: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the parts of one bucket: each reached member is compared with those not reached yet."""
    rest = members
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= MAX_BITS
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                yield from ((int(at), int(x)) for x in found)


def _joining(members: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the parts of one bucket of any size.

    Members of a bucket agree in most bits. Of the bits that vary, cut into MAX_BITS + 1 parts, a linked pair agrees on one part
    at least: so a bucket over FOREST members falls into finer ones, again and again, until they are small.
    """
    varying = int(np.bitwise_or.reduce(members ^ members[0]))
    bits = [b for b in range(64) if varying >> b & 1]
    if len(members) <= FOREST or len(bits) <= MAX_BITS:
        yield from _forest(members)
        return
    for part in np.array_split(np.array(bits, np.uint64), MAX_BITS + 1):
        values = members & np.bitwise_or.reduce(np.uint64(1) << part)
        order = np.argsort(values, kind="stable")
        yield from _bucket_links(values[order], members[order])


class _Links:
    """Union-find over what a task has linked, so that it gives out each joining link once."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def _root(self, x: int) -> int:
        p = self.parent
        while (y := p.setdefault(x, x)) != x:
            p[x] = x = p[y]
        return x

    def new(self, pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
        if len(self.parent) > 2_000_000:  # memory stays bounded; a link may then come twice
            self.parent.clear()
        out = []
        for a, b in pairs:
            x, y = self._root(a), self._root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                out.append((a, b))
        return out


def _bucket_links(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links within the buckets (runs of equal keys)."""
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(edge, len(key)))
    for n in range(2, SMALL_BUCKET + 1):
        start = edge[size == n]
        for i in range(n):
            for j in range(i + 1, n):
                a, b = fp[start + i], fp[start + j]
                near = np.bitwise_count(a ^ b) <= MAX_BITS
                if near.any():
                    yield from set(zip(a[near].tolist(), b[near].tolist(), strict=True))
    large = size > SMALL_BUCKET
    for start, n in zip(edge[large].tolist(), size[large].tolist(), strict=True):
        yield from _joining(fp[start : start + n])


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp) rows to links; the bucket at a batch's end waits for the next batch."""
    held_key, held_fp, links = [], [], _Links()

    def give(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if found := links.new(_bucket_links(key, fp)):
            a, b = np.array(found, np.uint64).view(np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if held_key and key[-1] == held_key[0][0]:
            held_key.append(key)
            held_fp.append(fp)
            continue
        key, fp = np.concatenate([*held_key, key]), np.concatenate([*held_fp, fp])
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        yield from give(key[:cut], fp[:cut])
        held_key, held_fp = [key[cut:]], [fp[cut:]]
    if held_key:
        yield from give(np.concatenate(held_key), np.concatenate(held_fp))


def linked(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints of ``prints`` (column fp) within MAX_BITS."""
    ship_package(prints.sparkSession)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = variants(prints.select("fp").distinct(), hot).repartition(2 * n, "key").sortWithinPartitions("key")
    return keyed.mapInArrow(_links, "a long, b long")


def grouped(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(fp, root): the component of each fingerprint that links to another; ``prints`` should be stored."""
    return components(linked(prints, hot)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, hot: int = HOT, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id of each row."""
    prints, _ = stored(fingerprints(docs, width), "fingerprints")
    roots = grouped(prints, hot)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    member = least.join(smallest, "root").select("fp", "component_id")
    return prints.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, hot: int = HOT, width: int = SHINGLE) -> DataFrame:
    """One row of each component: that of the smallest doc_id (of equal ones, by the text's hash; of repeated rows, any)."""
    prints, _ = stored(fingerprints(docs, width), "fingerprints")
    roots = grouped(prints, hot)
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("w")).join(roots, "fp", "left")
    i, h, k = unused(docs, "_id", "_h", "_k")
    chosen = first.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("w").alias("w")).select(F.col("w.doc_id").alias(i), F.col("w.h").alias(k))
    kept = docs.withColumn(h, F.xxhash64("text")).join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(h) == F.col(k)))
    return kept.dropDuplicates(["doc_id", h]).drop(i, h, k)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
