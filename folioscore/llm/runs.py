"""Periodic runs of words, by the runs theorem.

A run is a stretch with a smallest period q (words q apart are identical), at least twice as long as q, that no
neighbouring word extends keeping q. The theorem (Bannai et al. 2017): each run has a Lyndon root that is the longest Lyndon
word at its place, under an order of the words or under the inverse order. So, for each order, the longest Lyndon word at i ends before
the next smaller value of the inverse suffix array; a candidate i, j with root length j - i is extended to the right by the
longest common prefix of the suffixes i and j and to the left by that of the reversed text's. Common prefixes are range minima
of the LCP array: blocks, and a sparse table over the blocks, so memory is linear in the text.

A run of min_length words or more repeats at least min_length / 2 words in a row. A text that repeats no such stretch has no run,
which a sort of its stretches' hashes tells; all other texts go through the whole method.

Each text is worked on alone, without a shuffle. Edge cases: null, empty and blank texts have no words and no run; very
long texts are read whole; a null doc_id is returned as it is. Repeated rows give equal rows, an empty table none. Other columns,
whatever their names, are ignored by the reports and kept by ``collapse``.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, map_batches

MIN_LENGTH = 12
#: Values in a block of the range-minimum structure.
BLOCK = 32
#: Words whose runs are looked for in one go.
CHUNK = 200_000
#: Rows that a Python worker holds before it gives them out.
PIECE = 4_096

#: Words of a document before its runs are looked for.
Edit = Callable[[int | None, list[bytes]], list[bytes]]
Run = tuple[int, int, int]  # start, length, period


def inverse_suffix_array(s: np.ndarray) -> np.ndarray:
    """The rank of each suffix of s (integers from 0 on); a suffix stands before those that it begins.

    Prefix doubling, in which only suffixes that share their rank with others are sorted again.
    """
    n = len(s)
    rank = np.empty(n, np.int64)
    order = np.argsort(s, kind="stable")
    fresh = np.append(True, s[order][1:] != s[order][:-1])
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    open_ = order[~(fresh & np.append(fresh[1:], True))]
    k = 1
    while len(open_):
        after = np.full(len(open_), 0, np.int64)
        inside = open_ + k < n
        after[inside] = rank[open_[inside] + k] + 1
        key = rank[open_] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key, open_ = key[order], open_[order]
        old = rank[open_]
        at = np.arange(len(open_))
        group = np.append(True, old[1:] != old[:-1])
        fresh = np.append(True, key[1:] != key[:-1])
        # a group keeps its places: a suffix's new rank is its group's rank plus its place in the group
        moved = old + at - at[group][np.cumsum(group) - 1]
        rank[open_] = moved[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        k *= 2
    return rank


def next_smaller(values: list[int]) -> list[int]:
    """For each place the next one with a smaller value, or the length."""
    n = len(values)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        here, j = values[i], i + 1
        while j < n and values[j] > here:
            j = out[j]
        out[i] = j
    return out


def common_prefixes(s: list[int], rank: np.ndarray) -> np.ndarray:
    """The LCP array: at r the common prefix of the suffixes of ranks r - 1 and r (Kasai et al. 2001)."""
    n = len(s)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    before = suffix[rank - 1].tolist()
    s = [*s, -1]  # ends every prefix, as it equals nothing
    own, first = [0] * n, int(suffix[0])
    h = 0
    for i, j in enumerate(before):
        if i == first:
            h = 0
            continue
        while s[i + h] == s[j + h]:
            h += 1
        if h:
            own[i] = h
            h -= 1
    lcp = np.empty(n, np.int64)
    lcp[rank] = own
    return lcp


class RangeMin:
    """Minima of ranges: within blocks by running minima, across blocks by a sparse table."""

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // BLOCK)
        self.values = np.full(n * BLOCK, np.iinfo(np.int64).max)
        self.values[: len(values)] = values
        blocks = self.values.reshape(n, BLOCK)
        self.head = np.minimum.accumulate(blocks, axis=1).ravel()
        self.tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while 2 ** len(self.table) <= n:
            last, half = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minimum of values[low..high] for each pair, low <= high."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.tail[low], self.head[high])
        same = np.flatnonzero(a == b)
        at, last = low[same], high[same]
        out[same] = self.values[at]
        while len(same):
            at = at + 1
            more = at <= last
            same, at, last = same[more], at[more], last[more]
            out[same] = np.minimum(out[same], self.values[at])
        wide = np.flatnonzero(b - a > 1)
        if len(wide):
            first, count = a[wide] + 1, b[wide] - a[wide] - 1
            level = np.frexp(count)[1] - 1
            for k in np.unique(level):
                here = level == k
                at = wide[here]
                row = self.table[k]
                out[at] = np.minimum(out[at], np.minimum(row[first[here]], row[first[here] + count[here] - 2**k]))
        return out


class CommonPrefix:
    """The longest common prefix of any two suffixes of a text."""

    def __init__(self, s: np.ndarray, rank: np.ndarray | None = None):
        self.n = len(s)
        self.rank = inverse_suffix_array(s) if rank is None else rank
        self.least = RangeMin(common_prefixes(s.tolist(), self.rank))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For i < j; the suffix at the text's end is empty."""
        out = np.zeros(len(i), np.int64)
        inside = j < self.n
        a, b = self.rank[i[inside]], self.rank[j[inside]]
        out[inside] = self.least(np.minimum(a, b) + 1, np.maximum(a, b))
        return out


def may_have_runs(s: np.ndarray, min_length: int = MIN_LENGTH) -> bool:
    """False only if no stretch of min_length / 2 words occurs twice."""
    width = max(1, min_length // 2)
    n = len(s) - width + 1
    if n < 2:
        return False
    h = np.zeros(n, np.uint64)
    for k in range(width):  # equal stretches have equal hashes; a collision only costs the whole method
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + s[k : k + n].astype(np.uint64)
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, and where each starts.

    Each has numbers of its own and ends with a number of its own that is less than any word: so no suffix, Lyndon word or
    common prefix goes beyond its text.
    """
    first, parts = len(texts), []
    for d, s in enumerate(texts):
        parts += [s + first, np.array([d])]
        first += int(s.max()) + 1
    return np.concatenate(parts), np.cumsum([0, *(len(s) + 1 for s in texts)])


def _runs_of(texts: list[np.ndarray], min_length: int) -> list[list[Run]]:
    s, starts = _joined(texts)
    n, ends = len(s), len(texts)
    rank = inverse_suffix_array(s)
    ahead, back = CommonPrefix(s, rank), CommonPrefix(s[::-1].copy())
    inverse = np.where(s < ends, s, s.max() + ends - s)
    found = []
    for ranks in (rank, inverse_suffix_array(inverse)):
        i, j = np.arange(n), np.array(next_smaller(ranks.tolist()), np.int64)
        # an extension takes an equal pair on one side at least
        right, left = np.zeros(n, bool), np.zeros(n, bool)
        inside = j < n
        right[inside] = s[i[inside]] == s[j[inside]]
        left[1:] = s[i[1:] - 1] == s[j[1:] - 1]
        i, j = i[right | left], j[right | left]
        more, less = ahead(i, j), back(n - j, n - i)
        start, period = i - less, j - i
        length = less + period + more
        good = (length >= 2 * period) & (length >= min_length)
        found.append(np.stack([start[good], period[good], length[good]], axis=1))
    each = np.unique(np.concatenate(found), axis=0)
    out: list[list[Run]] = [[] for _ in texts]
    text = np.searchsorted(starts, each[:, 0], side="right") - 1
    for d, start, length, period in zip(text.tolist(), (each[:, 0] - starts[text]).tolist(), each[:, 2].tolist(), each[:, 1].tolist(), strict=True):
        out[d].append((start, length, period))
    return out


def find_runs(texts: list[np.ndarray], min_length: int = MIN_LENGTH) -> list[list[Run]]:
    """All runs of min_length or more of each text (integers from 0 on), by start, then period.

    Texts that may have runs are worked on CHUNK words at a time (a longer text alone).
    """
    out: list[list[Run]] = [[] for _ in texts]
    chunk: list[int] = []
    words = 0
    for d, s in enumerate(texts):
        if len(s) < min_length or not may_have_runs(s, min_length):
            continue
        if chunk and words + len(s) > CHUNK:
            for k, found in zip(chunk, _runs_of([texts[k] for k in chunk], min_length), strict=True):
                out[k] = found
            chunk, words = [], 0
        chunk.append(d)
        words += len(s)
    if chunk:
        for k, found in zip(chunk, _runs_of([texts[k] for k in chunk], min_length), strict=True):
            out[k] = found
    return out


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return (text or "").encode().split()


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, dropped in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not dropped]


def _report(batch: pa.RecordBatch, min_length: int, edit: Edit | None) -> dict:
    out: dict[str, list] = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
    texts = [words_of(t) for t in batch.column(1).to_pylist()]
    if edit:
        texts = [edit(doc, words) for doc, words in zip(batch.column(0).to_pylist(), texts, strict=True)]
    for words, found in zip(texts, find_runs([numbered(w) for w in texts], min_length), strict=True):
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        row = (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, found))).hexdigest())
        for values, value in zip(out.values(), row, strict=True):
            values.append(value)
    return {"doc_id": batch.column(0)} | out


def summarise(docs: DataFrame, min_length: int = MIN_LENGTH, edit: Edit | None = None) -> DataFrame:
    """Of each row: the number of runs, the longest one, and digests of all runs and of the text without repeats.

    edit: changes a document's words before (see :func:`repeating`).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_batches(rows, functools.partial(_report, min_length=min_length, edit=edit), schema)


def _listed(batch: pa.RecordBatch, min_length: int) -> Iterator[dict]:
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "period", "root")}
    texts = [words_of(t) for t in batch.column(1).to_pylist()]
    for doc, words, found in zip(batch.column(0).to_pylist(), texts, find_runs([numbered(w) for w in texts], min_length), strict=True):
        for start, length, period in found:
            row = (doc, start, length, period, b" ".join(words[start : start + period]).decode())
            for values, value in zip(out.values(), row, strict=True):
                values.append(value)
            if len(out["doc_id"]) >= PIECE:
                yield out
                out = {k: [] for k in out}
    yield out


def runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """A row for each run: doc_id, start, length and period in words, and its first period's text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, functools.partial(_listed, min_length=min_length), "doc_id long, start long, length long, period long, root string")


def _collapse(batch: pa.RecordBatch, min_length: int) -> pa.RecordBatch:
    at = batch.schema.names.index("text")
    texts = batch.column(at).to_pylist()
    words = [words_of(t) for t in texts]
    found = find_runs([numbered(w) for w in words], min_length)
    out = [b" ".join(kept_words(w, f)).decode() if f else t for t, w, f in zip(texts, words, found, strict=True)]
    return batch.set_column(at, "text", pa.array(out, pa.string()))


def collapse(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """The rows of docs; a text with runs keeps one period of each, its words joined by spaces."""
    return map_batches(docs, functools.partial(_collapse, min_length=min_length), docs.schema)


def repeating(doc: int | None, words: list[bytes]) -> list[bytes]:
    """From a tenth of the documents a text that repeats itself: its words from a place on, over and over.

    With h the CRC-32 of the decimal doc_id and g = h // 10, documents with h % 10 = 0 are changed: words from a = g % n on
    become those from a on with period 1 + (n - a) // (3 + g % 8). A null doc_id changes nothing.
    """
    n = len(words)
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(documents(spark, sf_dir), edit=repeating)
