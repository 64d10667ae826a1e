"""Quality rules by compression bands.

A text's zstandard ratio (raw bytes / compressed bytes) is low for incompressible text and high for repetitive
text, and it depends on the length: a short text has little to repeat. So the limits are a table by length.
The whole document is judged by the band of its length, and every fixed chunk of it (``chunk_bytes``), and the last
``chunk_bytes`` where the chunks leave a tail, by the chunk band (a shorter text is one chunk, judged by the band of its
length): if more than a share ``max_bad_chunks`` of the chunks is outside, the document is rejected.

Besides, the base counts of the words (runs without ASCII white space) are returned.

Edge cases: a null or empty text has no words and fails the base rule; below 256 bytes a ratio only tells
repetition, so there is no lower limit. Very long texts are read whole; their windows are counted in numpy.
Repeated rows give equal rows, an empty table none. Other columns, whatever their names, are ignored by ``measure`` and kept by
``keep_good``.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, map_batches

WINDOW = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio: (bytes from, lowest, highest), the last fitting row counts.

    Set from the labelled good rows of the small check table that pass the base rule: from the lowest ratio of each
    length class (half octaves) less 5 % to the highest plus 2 %; chunks likewise.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 1.31), (128, 0.0, 1.48), (181, 0.0, 1.61), (256, 1.19, 1.75), (362, 1.29, 1.79), (512, 1.38, 1.89), (724, 1.46, 2.07), (1_024, 1.58, 2.11), (1_448, 1.68, 2.22), (2_048, 1.73, 2.25),
        (2_896, 1.82, 2.28), (4_096, 1.86, 2.35), (5_793, 1.99, 2.4), (8_192, 2.05, 2.45), (11_585, 2.1, 2.48), (16_384, 2.16, 2.5), (23_170, 2.16, 2.54), (32_768, 2.2, 2.59), (46_341, 2.23, 2.6),
    )
    chunk: tuple[float, float] = (1.85, 2.33)
    chunk_bytes: int = 4_096
    max_bad_chunks: float = 0.1
    level: int = 3

    def limits(self, n: int) -> tuple[float, float] | None:
        fitting = [b for b in self.whole if n >= b[0]]
        return fitting[-1][1:] if fitting else None


BANDS = Bands()


@functools.lru_cache(maxsize=4)
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)


def ratio(raw: bytes, level: int = 3) -> float:
    return len(raw) / len(_compressor(level).compress(raw)) if raw else 1.0


@dataclass
class Verdict:
    ratio: float
    bad_chunks: int
    chunks: int
    kept: bool = field(default=True)


def judge(raw: bytes, bands: Bands = BANDS) -> Verdict:
    whole = ratio(raw, bands.level)
    limits = bands.limits(len(raw))
    size = bands.chunk_bytes
    parts = [raw[i : i + size] for i in range(0, len(raw) - size + 1, size)]
    if parts and len(raw) % size:
        parts.append(raw[-size:])  # the tail, with what is before it: the limits are made for whole chunks
    bad = sum(not bands.chunk[0] <= ratio(p, bands.level) <= bands.chunk[1] for p in parts)
    kept = (limits is None or limits[0] <= whole <= limits[1]) and bad <= bands.max_bad_chunks * len(parts)
    return Verdict(whole, bad, len(parts), kept)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if n <= 20_000:
        windows = list(zip(*(words[i:] for i in range(width)), strict=False))
        if len(set(windows)) == n:
            return 0
        count: dict = {}
        ids = np.fromiter((count.setdefault(w, len(count)) for w in windows), np.int64, n)
    else:
        number: dict = {}
        single = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        ids, size = single[:n], len(number)
        for i in range(1, width):  # exact: each longer window gets a number of its own
            ids = np.unique(ids * size + single[i : i + n], return_inverse=True)[1]
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _measure(batch: pa.RecordBatch, bands: Bands) -> dict:
    texts = batch.column(1).to_pylist()
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks")}
    for text in texts:
        text = text or ""
        raw = text.encode()
        words = raw.split()  # bytes split at exactly the six ASCII white-space characters
        repeats = repeated_words(words)
        failed = len(words) < 10 or 100 * repeats > 20 * len(words)
        verdict = judge(raw, bands)
        row = (len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)), duplicate_lines(raw), repeats, failed, not failed and verdict.kept, verdict.ratio, verdict.chunks, verdict.bad_chunks)
        for values, value in zip(out.values(), row, strict=True):
            values.append(value)
    return {"doc_id": batch.column(0)} | out


def measure(docs: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the ratios behind the verdict."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
    return map_batches(rows, functools.partial(_measure, bands=bands), schema)


def _keep(batch: pa.RecordBatch, bands: Bands) -> pa.RecordBatch:
    texts = batch.column(batch.schema.names.index("text"))
    pair = pa.RecordBatch.from_arrays([texts, texts], names=["doc_id", "text"])
    return batch.filter(pa.array(_measure(pair, bands)["kept"], pa.bool_()))


def keep_good(docs: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    return map_batches(docs, functools.partial(_keep, bands=bands), docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(documents(spark, sf_dir))
