"""Packing token sequences by cutting-stock column generation.

A document's ids (and a closing id 0) are cut into pieces of the full capacity and one rest. The pieces'
length histogram (at most ``capacity`` rows, whatever the data) goes to the driver. There a linear program
over patterns (multisets of lengths that fit) is solved by column generation: an unbounded-knapsack dynamic
program prices new patterns until the Farley bound says that the program is within ``tolerance`` of its
optimum. Patterns are rounded down; what is left over is packed by first fit decreasing, still on
the histogram. Each length's pieces are ranked (gapless, by sub-groups), and rank intervals of each length
belong to the copies of a pattern: so a piece finds its sequence by binary search.

The intervals are bounded by the capacity, not by the data, and so travel with the tasks.

Edge cases: a null or empty text is one piece, the closing id. Very long texts become many full pieces.
Repeated rows are packed each; equal lengths are told apart by their rank. An empty table packs into nothing.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import warnings
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import Vocabulary
from .shared import bucket_count, documents, gapless_ranks, map_batches, stored

CAPACITY = 1024
CLOSING_ID = 0


@functools.lru_cache(maxsize=2)
def fast_encoder(path: str) -> tiktoken.Encoding:
    """The library encoder of a byte-level tokenizer file; its ids are those of the tokenizers library."""
    v = Vocabulary(path)
    special = set(v.special.values())
    ranks = {b: i for i, b in enumerate(v.bytes) if b and i not in special}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=v.special)


def _pieces(batch: pa.RecordBatch, path: str, capacity: int) -> dict:
    e = fast_encoder(path)
    closing = np.array([CLOSING_ID], "<u4")
    key, start, length, crc, total = [], [], [], [], []
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        ids = e.encode_to_numpy(text, allowed_special="all") if text else closing[:0]
        raw = np.concatenate([ids.astype("<u4", copy=False), closing]).tobytes()
        n = len(raw) // 4
        for at in range(0, n, capacity):
            key.append(doc)
            start.append(at)
            length.append(min(capacity, n - at))
            crc.append(zlib.crc32(raw[4 * at : 4 * (at + capacity)]))
            total.append(n)
    return {"doc_id": key, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total}


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each document's pieces."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, functools.partial(_pieces, path=tokenizer, capacity=capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of lengths that fits, and its value."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, np.int64)
    order = np.argsort(lengths)
    sizes, worth = lengths[order], values[order]
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            got = best[c - sizes[:k]] + worth[:k]
            if got[i := int(got.argmax())] > best[c] + 1e-12:
                best[c], took[c] = got[i], i
    counts = np.zeros(len(lengths), np.int64)
    c = capacity
    while c > 0:
        if (i := took[c]) < 0:
            c -= 1
        else:
            counts[order[i]] += 1
            c -= sizes[i]
    return float(best[capacity]), counts


def first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """A feasible basis, how often each pattern is used, and the order in which the lengths are exhausted: fractional first fit decreasing.

    Each pattern is used until one of its lengths is exhausted. In that order the patterns form a lower
    triangular matrix, so they are a basis; lengths exhausted at the same time get an unused pattern of their own.
    """
    n = len(lengths)
    basis, use = np.zeros((n, n), np.int64), np.zeros(n)
    left, open_, exhausted = demand.copy(), np.ones(n, bool), []
    order = np.argsort(-lengths)
    while open_.any():
        room, column = capacity, np.zeros(n, np.int64)
        for i in order[open_[order]]:
            if lengths[i] <= room:
                column[i] = min(room // lengths[i], max(1, int(left[i])))
                room -= column[i] * lengths[i]
        at = np.flatnonzero(column)
        times = left[at] / column[at]
        copies = times.min()
        done = at[times <= copies * (1 + 1e-12)]
        left -= copies * column
        exhausted += done.tolist()
        for k, i in enumerate(done.tolist()):
            basis[:, i] = column if k == 0 else 0
            if k:
                basis[i, i] = capacity // lengths[i]
            use[i] = copies if k == 0 else 0.0
        open_[done] = False
        left[done] = 0.0
    return basis, use, exhausted


def triangular_inverse(basis: np.ndarray, order: list[int]) -> np.ndarray:
    """The inverse of a matrix that is lower triangular in this order of its rows and columns: its rows have few entries.

    Without the linear algebra library: its threads may hang in a driver that has started other processes.
    """
    out = np.zeros(basis.shape)
    for i in order:
        out[i, i] = 1.0
        for j in np.flatnonzero(basis[i]).tolist():
            if j != i:
                out[i] -= basis[i, j] * out[j]
        out[i] /= basis[i, i]
    return out


def solve_cutting(lengths: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = 0.002, rounds: int = 300) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each: the linear relaxation by column generation (revised simplex).

    It ends within ``tolerance`` of the larger of the Farley bound and the material bound, or after ``rounds``, with a
    warning that tells how far it got; either way every length's demand is met exactly.
    """
    basis, use, order = first_basis(lengths, demand, capacity)
    inverse = triangular_inverse(basis, order)
    bound = float((lengths * demand).sum()) / capacity
    for _ in range(rounds):
        total = use.sum()
        if total <= bound * (1 + tolerance):
            break
        value, column = best_pattern(lengths, inverse.sum(axis=0), capacity)
        bound = max(bound, total / max(value, 1.0))
        if value <= 1 + 1e-9:
            break
        own = np.flatnonzero(column)
        step = (inverse[:, own] * column[own]).sum(axis=1)
        ratio = np.full(len(lengths), np.inf)
        positive = step > 1e-9
        ratio[positive] = use[positive] / step[positive]
        leave = int(ratio.argmin())
        theta = ratio[leave]
        row = inverse[leave] / step[leave]
        step[leave] -= 1.0
        inverse -= np.outer(step, row)
        use = np.maximum(use - theta * step, 0)
        use[leave] = theta
        basis[:, leave] = column
    else:
        warnings.warn(f"packing: {use.sum():.1f} sequences after {rounds} rounds, no less than {bound:.1f} are needed", stacklevel=2)
    return [(basis[:, j], float(use[j])) for j in range(len(lengths)) if use[j] > 1e-9]


@dataclass(frozen=True)
class Interval:
    """Ranks [first, last) of a length: ``each`` of them to a sequence, from ``sequence`` on, from ``offset`` on."""

    length: int
    first: int
    last: int
    each: int
    sequence: int
    offset: int


def plan_intervals(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Interval]:
    """Where each rank of each length goes. Sequence ids are gapless from 0."""
    patterns: list[tuple[dict[int, int], int]] = []
    left = Counter({k: n for k, n in histogram.items() if n})
    if full := left.pop(capacity, 0):
        patterns.append(({capacity: 1}, full))
    if left:
        lengths = np.array(sorted(left), np.int64)
        demand = np.array([left[int(k)] for k in lengths], np.float64)
        for column, use in solve_cutting(lengths, demand, capacity):
            if copies := int(use + 1e-6):
                own = {int(k): int(a) for k, a in zip(lengths, column, strict=True) if a}
                copies = min(copies, *(left[k] // a for k, a in own.items()))
                if copies:
                    patterns.append((own, copies))
                    left.subtract({k: a * copies for k, a in own.items()})
        left = +left
        rest: Counter = Counter()
        while left:  # first fit decreasing: fill one sequence from the longest length that fits on
            room, own = capacity, {}
            for k in sorted(left, reverse=True):
                if k <= room:
                    own[k] = min(left[k], room // k)
                    room -= own[k] * k
            copies = min(left[k] // a for k, a in own.items())
            left = +(left - Counter({k: a * copies for k, a in own.items()}))
            rest[tuple(own.items())] += copies
        patterns += [(dict(own), n) for own, n in rest.items()]
    out, sequence, used = [], 0, Counter()
    for own, copies in patterns:
        offset = 0
        for k, a in own.items():
            out.append(Interval(k, used[k], used[k] + a * copies, a, sequence, offset))
            used[k] += a * copies
            offset += a * k
        sequence += copies
    return out


def _place(batch: pa.RecordBatch, intervals: list[Interval]) -> dict:
    """sequence_id and offset of ranked pieces: the interval of a rank is found by binary search."""
    length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
    table = np.array(sorted((i.length, i.first, i.each, i.sequence, i.offset) for i in intervals), np.int64).reshape(-1, 5)
    bits = 62 - int(table[-1, 0]).bit_length()  # lengths above, ranks below
    at = np.searchsorted((table[:, 0] << bits) + table[:, 1], (length << bits) + rank, side="right") - 1
    _, first, each, sequence, offset = table[at].T
    turn, place = np.divmod(rank - first, each)
    return {n: batch.column(n) for n in batch.schema.names if n != "_rank"} | {"sequence_id": pa.array(sequence + turn), "offset": pa.array(offset + place * length)}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. ``pieces`` is read twice: store it first if it is costly."""
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    intervals = plan_intervals(histogram, capacity)
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens")]
    ranked = gapless_ranks(pieces, ["length"], order, F.xxhash64("doc_id", "start", "ids_crc32"), "_rank", bucket_count(pieces.sparkSession) // 2)
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return map_batches(ranked.select(*pieces.columns, "_rank"), functools.partial(_place, intervals=intervals), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    pieces, _ = stored(cut_pieces(docs, tokenizer, capacity), "pieces")
    return pack(pieces, capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
