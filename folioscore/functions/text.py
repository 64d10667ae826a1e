"""Text functions: normalisation, word and digit sequences, edit distances and error rates.

All are column expressions; only Unicode NFC has no built-in and goes through an Arrow UDF, batch by batch.
"""

from __future__ import annotations

import functools
import math
import sys
import unicodedata
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..session import ship_package

#: White space between words as Python's str.split() sees it; plain \s knows only six of these.
SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"
#: Sequences of more items are interned in Python: the expression's look-ups grow with length x distinct items.
MAX_INTERNED = 4_096
#: A character for each item: from U+0100 on, all below the surrogates.
_ALPHABET = "".join(map(chr, range(256, 256 + 2 * MAX_INTERNED)))
#: Texts of more bytes are compared in Python.
SHORT = 64
#: Distances up to these are looked for in a band of so many cells on either side of the table's diagonal.
BANDS = (16, 64, 256, 1_024)


def _nfc(values: list) -> list:
    return [v if v is None or v.isascii() else unicodedata.normalize("NFC", v) for v in values]


@F.arrow_udf(StringType())
def _nfc_text(texts: pa.Array) -> pa.Array:
    return pa.array(_nfc(texts.to_pylist()), pa.string())


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def _nfc_nested(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else [None if x is None else _nfc(x) for x in t] for t in texts.to_pylist()], pa.list_(pa.list_(pa.string())))


# Declared non-deterministic so that the optimizer computes it once, as a column, and never moves it into a lambda
# function, where no Python runs.
_nfc_nested = _nfc_nested.asNondeterministic()


def on_workers(column: Column) -> Column:
    """A column that runs this package's Python: the active session's workers get the package."""
    if spark := SparkSession.getActiveSession():
        ship_package(spark)
    return column


def _line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def normalize(text: Column) -> Column:
    """NFC with all line ends as \\n; case, marks, digits and direction marks stay."""
    return _line_ends(on_workers(_nfc_text(text)))


def nfc_nested(texts: Column) -> Column:
    """NFC over an array of arrays, in one call: select it as a column of its own before using it.

    Texts joined by line ends may be composed one by one: nothing composes across a line end. Only rows with a character
    from U+0300 on go to Python: texts without one are composed as they are.
    """
    # the count of bytes tells ASCII without a regular expression
    other = lambda x: (F.octet_length(x) > F.char_length(x)) & x.rlike(r"[^\x{0}-\x{2ff}]")
    open_ = F.exists(texts, lambda t: F.coalesce(F.exists(t, other), F.lit(False)))
    return F.coalesce(on_workers(_nfc_nested(F.when(open_, texts))), texts)


def line_ends(text: Column) -> Column:
    """The other half of normalize, for composed texts."""
    return _line_ends(text)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


@functools.cache
def _digit_table() -> tuple[str, str]:
    """All decimal digits of Python's Unicode data beyond ASCII, and their ASCII digits."""
    others = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdecimal()]
    return "".join(others), "".join(str(unicodedata.decimal(c)) for c in others)


def digits(text: Column) -> Column:
    """The decimal digits of a text, as ASCII, in order."""
    # other digits are looked up letter by letter, and only in texts that may have any
    return F.regexp_replace(F.when(F.octet_length(text) > F.char_length(text), F.translate(text, *_digit_table())).otherwise(text), "[^0-9]+", "")


def has_digit(text: Column) -> Column:
    return F.char_length(digits(text)) > 0


def digit_exact(reference: Column, hypothesis: Column) -> Column:
    """1.0 if the digit sequences are equal (two empty ones are), else 0.0."""
    return (digits(reference) == digits(hypothesis)).cast("double")


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two texts: short ones here, others in Python. Not for use within a lambda function."""
    # levenshtein walks one whole text for each character of the other, within a band as well
    long = (a != b) & (F.greatest(F.octet_length(a), F.octet_length(b)) > SHORT)
    return F.when(a == b, 0).otherwise(F.coalesce(on_workers(_text_distance(F.when(long, a), F.when(long, b))), F.when(~long, F.levenshtein(a, b))))


def _banded(a: Column, b: Column) -> Column:
    """Levenshtein distance of two texts that are no arguments for Python: bands are tried first."""
    # beyond its band levenshtein is -1, and get null: each band is tried once, and only after those before it
    near = [F.get(F.sequence(F.lit(0), F.lit(band)), F.levenshtein(a, b, band)) for band in BANDS]
    return F.when(a == b, 0).otherwise(F.coalesce(*near, F.levenshtein(a, b)))


def near_edits(a: Sequence, b: Sequence, most: int) -> int | None:
    """Levenshtein distance of two sequences if it is at most ``most``: how far each diagonal gets with so many edits (Ukkonen 1985)."""
    n, m = len(a), len(b)
    none = -2  # a diagonal not reached
    far: dict[int, int] = {}
    for e in range(most + 1):
        now = {}
        for k in range(-min(e, n), min(e, m) + 1):
            # an item replaced, inserted or deleted; the diagonal k holds the places i of a, i + k of b
            i = max(far.get(k, none) + 1, far.get(k - 1, none), far.get(k + 1, none) + 1) if e else 0
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            j = i + k
            while i + 16 <= n and a[i : i + 16] == b[j : j + 16]:
                i, j = i + 16, j + 16
            while i < n and j < m and a[i] == b[j]:
                i, j = i + 1, j + 1
            if i == n and j == m:
                return e
            now[k] = i
        far = now
    return None


def edits(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences: like ones by near_edits, others a column at a time as bits of whole numbers (Hyyrö 2003).

    near_edits takes up to edits x edits steps, so it is given the root of the lengths. A column of the table is two numbers with a bit for each item of a (the steps up and down it), so an item of b costs
    a dozen operations on numbers of len(a) bits, whatever the distance.
    """
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    end = 0
    while end < high - low and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    if (near := near_edits(a, b, math.isqrt(len(a) + len(b)))) is not None:
        return near
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    wanted = Counter(x for x in b if x in places)
    masks: dict = {}  # of items that are met often: a bounded number, as the others are built when met

    def mask(x: object) -> int:
        if (known := masks.get(x)) is not None:
            return known
        at = places.get(x, ())
        if len(at) < 16:
            made = sum(1 << i for i in at)
        else:
            bits = bytearray(len(a) // 8 + 1)
            for i in at:
                bits[i >> 3] |= 1 << (i & 7)
            made = int.from_bytes(bits, "little")
        if at and (len(at) + wanted[x] > 64):
            masks[x] = made
        return made

    every = (1 << len(a)) - 1
    top = 1 << (len(a) - 1)
    up, down, distance = every, 0, len(a)
    for x in b:
        same = mask(x)
        vertical = same | down
        diagonal = (((same & up) + up) ^ up) | same
        plus = down | (every & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus = (plus << 1 | 1) & every
        up = (minus << 1 & every) | (every & ~(vertical | plus))
        down = plus & vertical
    return distance


@F.arrow_udf(IntegerType())
def _text_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance of long texts (null where the expression does it)."""
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else edits(x, y) for x, y in pairs], pa.int32())


_text_distance = _text_distance.asNondeterministic()  # as _nfc_nested


@F.arrow_udf(IntegerType())
def _long_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance of long sequences (null where the expression does it)."""
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else edits(x, y) for x, y in pairs], pa.int32())


def sequence_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of strings: each distinct item becomes a character of its own."""
    short = (F.size(a) <= MAX_INTERNED) & (F.size(b) <= MAX_INTERNED)
    both = F.struct(F.array_distinct(F.concat(a, b)).alias("known"), a.alias("a"), b.alias("b"))

    def coded(known: Column, items: Column) -> Column:
        return F.array_join(F.transform(items, lambda t: F.substring(F.lit(_ALPHABET), F.array_position(known, t).cast("int"), 1)), "")

    # lets: the lambda functions get the arrays and the coded texts as arguments and compute them once
    texts = F.transform(F.array(both), lambda s: F.struct(coded(s.known, s.a).alias("a"), coded(s.known, s.b).alias("b")))
    exact = F.when(a == b, 0).when(short, F.get(F.transform(texts, lambda s: _banded(s.a, s.b)), 0))
    long = ~short & (a != b)
    return F.coalesce(exact, on_workers(_long_distance(F.when(long, a), F.when(long, b))))


def similarity(edits: Column, a: Column, b: Column) -> Column:
    """1 - edits / max(length, length, 1)."""
    return 1 - edits / F.greatest(a, b, F.lit(1))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Of normalised texts; above 1 where the hypothesis is much longer."""
    return distance(reference, hypothesis) / F.greatest(F.char_length(reference), F.lit(1))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    r, h = words(reference), words(hypothesis)
    return sequence_distance(r, h) / F.greatest(F.size(r), F.lit(1))


def edit_similarity(reference: Column, hypothesis: Column) -> Column:
    return similarity(distance(reference, hypothesis), F.char_length(reference), F.char_length(hypothesis))


def order_score(reference: Column, hypothesis: Column) -> Column:
    """Similarity of two sequences of ids."""
    return similarity(sequence_distance(reference, hypothesis), F.size(reference), F.size(hypothesis))


def is_arabic(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\x{600}-\x{6ff}]"), F.lit(False))


def fill_template(template: Column, **values: Column) -> Column:
    """``{name}`` replaced by each value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def canonical_checksum(columns: dict[str, Column]) -> Column:
    """SHA-256 of the columns as JSON with sorted keys and no spaces."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def run_id(command: Column) -> Column:
    return F.concat(F.lit("run-"), F.substring(F.sha2(command, 256), 1, 16))
