"""Ranked lexical search by a hierarchical max tree over document ranges.

Each item (a query text) gets its best documents. A term weighs floor(1000 ln((2N + 2) / (2df + 1))); a document's score sums, over
the item's terms, weight * (10^9 tf div (1000 tf + 8m)), where m grows with the document's length; all but the logarithm is
in 64-bit integers, so scores are the same wherever they are computed.

One pass over the whole texts counts each document's terms and keeps, of those that an item asks for, their places in a
list of numbers (stored; texts aren't read again). N, L and the document frequencies are aggregates of it, over all documents. A task then
works on its documents SHARD at a time. For each term it builds a tree of maxima over document ranges: LEAF documents a leaf, FAN nodes a
parent. The bound of a node is the sum of its maxima over the item's terms. Search is best-first: the node with the highest
bound is opened, its children get their bounds, a leaf its documents' scores, until no bound reaches the k-th score; nodes that equal it are
opened too, as a smaller doc_id may lie in them. A task's later shards start from what its earlier ones have found. What leaves a task is k
rows an item; they are ranked in two steps, salted first, so no item's rows meet in one task unranked.

Items come in blocks of ITEMS: a block's terms travel with the tasks, so their size is bounded, and more items mean more passes, not more
memory. Rows of one item_id are one item with all their terms.

Edge cases: null, empty and blank texts have no terms: such items find nothing, such documents aren't found and don't count in N. Repeated
documents are ranked each (equal doc_ids in any order); a null doc_id ranks after the others of its score. Empty tables give
none. Very long texts are read whole. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bucket_count, discard_since, documents, map_batches, mark, ship_package, stored

TOP = 10
#: Items whose terms travel with the tasks at once, and the code points of an item's texts that a block may hold beyond that.
ITEMS, BLOCK_CHARS = 4_096, 4_000_000
SHARD = 16_384
LEAF, FAN = 8, 8

#: Bytes of terms as they are, A-Z as a-z, all other ASCII as a space.
_TERMS = bytes(c if c >= 128 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


def _counted(batch: pa.RecordBatch, vocabulary: dict[bytes, int]) -> dict:
    n, terms, times = [], [], []
    for text in batch.column(1).to_pylist():
        words = terms_of(text)
        own = Counter(map(vocabulary.get, words))
        own.pop(None, None)
        n.append(len(words))
        terms.append(list(own))
        times.append(list(own.values()))
    return {"doc_id": batch.column(0), "n": n, "terms": terms, "times": times}


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the vocabulary's terms in the text (by number) with how often each occurs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, functools.partial(_counted, vocabulary=vocabulary), "doc_id long, n long, terms array<int>, times array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class MaxTree:
    """A shard's documents by length (like lengths have like scores), and trees of maxima over ranges of them.

    ``levels`` has, from the leaves up, for each term the nodes in which it occurs and its largest part of a score there.
    """

    def __init__(self, doc: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        order = np.argsort(n, kind="stable")
        self.doc = doc[order]
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        at = place[np.repeat(np.arange(len(n)), sizes)]
        by_doc = np.argsort(at, kind="stable")
        self.at, self.terms, times = at[by_doc], terms[by_doc], times[by_doc]
        m = 10 + (90 * n[order] * n_docs) // max(n_terms, 1)
        self.part = weights[self.terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[self.at]))
        leaves = max(1, -(-len(n) // LEAF))
        self.start = np.searchsorted(self.at, np.arange(leaves + 1) * LEAF)
        by_term = np.argsort(self.terms, kind="stable")
        term, node, most = self.terms[by_term], self.at[by_term], self.part[by_term]
        self.levels, fan = [], LEAF
        while True:
            node = node // fan
            heads = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (node[1:] != node[:-1]))) if len(term) else np.array([], np.int64)
            term, node, most = term[heads], node[heads], np.maximum.reduceat(most, heads) if len(heads) else most
            self.levels.append((np.searchsorted(term, np.arange(len(weights) + 1)), node, most, leaves))
            if leaves == 1:
                return
            leaves, fan = -(-leaves // FAN), FAN

    def bounds(self, wanted: np.ndarray) -> list[np.ndarray]:
        """For each level and node the sum of the terms' maxima; doubles hold these integers exactly."""
        out = []
        for start, node, most, width in self.levels:
            own = [slice(i, j) for i, j in zip(start[wanted].tolist(), start[wanted + 1].tolist(), strict=True) if i < j]
            out.append(np.bincount(np.concatenate([node[s] for s in own]), weights=np.concatenate([most[s] for s in own]), minlength=width) if own else np.zeros(width))
        return out

    def search(self, wanted: np.ndarray, asked: np.ndarray, best: list[tuple[int, int]], top: int) -> None:
        """Adds to best, a heap of the top (score, -doc_id) so far, what this shard has. asked: wanted as a mask."""
        bounds = self.bounds(wanted)
        heap = [(-bounds[-1][0], len(bounds) - 1, 0)]
        while heap:
            bound, level, node = heapq.heappop(heap)
            if not bound or len(best) == top and -bound < best[0][0]:
                return
            if level:
                low = node * FAN
                for k, b in enumerate(bounds[level - 1][low : low + FAN].tolist()):
                    if b and (len(best) < top or b >= best[0][0]):
                        heapq.heappush(heap, (-b, level - 1, low + k))
                continue
            own = slice(self.start[node], self.start[node + 1])
            hit = asked[self.terms[own]]
            scores = np.bincount(self.at[own][hit] - node * LEAF, weights=self.part[own][hit], minlength=LEAF)
            for k in np.flatnonzero(scores >= best[0][0] if len(best) == top else scores > 0).tolist():
                entry = (int(scores[k]), -self.doc[node * LEAF + k])
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


#: Stands for a null doc_id: after all others.
_NULL = 1 << 63


def _search(batches: Iterable[pa.RecordBatch], items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, top: int, shard: int) -> Iterator[pa.RecordBatch]:
    best: list[list] = [[] for _ in items]
    held: list[pa.RecordBatch] = []

    def work() -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        ids = np.array([_NULL if x is None else x for x in table.column("doc_id").to_pylist()], object)
        terms, times = (table.column(c).combine_chunks() for c in ("terms", "times"))
        sizes = terms.value_lengths().to_numpy()
        tree = MaxTree(ids, table.column("n").to_numpy(), sizes, terms.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64), weights, n_docs, n_terms)
        asked = np.zeros(len(weights), bool)
        for (_, wanted), own in zip(items, best, strict=True):
            asked[wanted] = True
            tree.search(wanted, asked, own, top)
            asked[wanted] = False

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= shard:
            work()
    if held and sum(b.num_rows for b in held):
        work()
    rows = [(i, None if -d == _NULL else -d, s) for (i, _), own in zip(items, best, strict=True) for s, d in own]
    for at in range(0, len(rows), 10_000):
        some = rows[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], pa.int64()) for k in range(3)], names=["item_id", "doc_id", "score"])


def _first(found: DataFrame, top: int, *keys: Column) -> DataFrame:
    ranked = Window.partitionBy("item_id", *keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items with their distinct terms, ``size`` at most at a time."""
    rows, block, chars = items.orderBy("item_id").toLocalIterator(), {}, 0
    for r in rows:
        if r.item_id not in block and (len(block) >= size or chars > BLOCK_CHARS):
            yield [(i, sorted(t)) for i, t in block.items()]
            block, chars = {}, 0
        own = set(terms_of(r.text))
        block.setdefault(r.item_id, set()).update(own)
        chars += sum(map(len, own))
    if block:
        yield [(i, sorted(t)) for i, t in block.items()]


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = ITEMS, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` documents with the highest scores above 0 for each item (item_id, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    wanted = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for own in _blocks(wanted, block):
        vocabulary = {t: k for k, t in enumerate(sorted({t for _, terms in own for t in terms}))}
        if vocabulary:
            point = mark()
            found, _ = stored(_rank_block(docs, own, vocabulary, top, shard), "ranked", point)
            out = out.unionByName(found)
    return out


def _rank_block(docs: DataFrame, items: list[tuple[int, list[bytes]]], vocabulary: dict[bytes, int], top: int, shard: int) -> DataFrame:
    counted, _ = stored(count_terms(docs, vocabulary), "terms")
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # a row for each term of this block's items at most
    df = counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for t, n in df:
        weights[t] = weight(n_docs, n)
    asked = [(i, np.array([vocabulary[t] for t in terms], np.int64)) for i, terms in items if terms]
    search = functools.partial(_search, items=asked, weights=weights, n_docs=n_docs, n_terms=n_terms, top=top, shard=shard)
    found = counted.where("n > 0").mapInArrow(search, "item_id long, doc_id long, score long")
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(bucket_count(docs.sparkSession)))
    return _first(_first(found, top, salt).drop("rank"), top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for DuckDB, every document scored for every item that shares a term with it.
SQL = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), post AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM post, totals GROUP BY term),
scored AS (
  SELECT item_id, post.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN post USING (term) JOIN weights USING (term) JOIN sizes ON sizes.doc_id = post.doc_id, totals GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}
"""


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
