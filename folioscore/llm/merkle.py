"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line with its line end; a section is a run of paragraphs that ends after a blank line or where
a paragraph's own hash says so, so that an insertion shifts no later section. Below a paragraph stand its
sentences (pieces of at most MAX_LEAF characters), the leaves. Every digest is SHA-256 over a tag of the node's kind and its
children's digests (128 bits of it below the root, all 256 at the root): equal roots mean equal texts. Comparing two trees descends
only into sections and paragraphs whose digests differ, which locates edits; the likeness of two fingerprints is the share of
characters (of both texts) in leaves that both have. It is computed from what the strings hold: the root, and SHORT bytes of
each node's digest (enough to tell the nodes of two texts apart).

The string is ``root|section;section...``, a section ``digest:paragraph,paragraph...``, a paragraph
``digest=leaf.leaf...`` and a leaf its digest and its length.

Neighbours in doc_id order (``with_next``) come without a global sort into one task: splitters of doc_id cut the
rows into about as many ranges as there are shuffle partitions, each range is one partition, and each gets its successor's
first row as well. A doc_id (or null) with more than a range's share of the rows is cut further, by the texts' hashes. A text is
shuffled once.

Edge cases: a null text is empty; the empty text has a root and no section. The next document of the
last is the first; of the only one, itself. Null doc_ids come last; equal doc_ids are ordered by the texts' hashes (XXH64, seed
42, signed), then by text; rows equal in both stay in one range. Texts of any length are read whole; an empty table gives none;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, ship_package, slices

MAX_LEAF = 256
#: Bytes of a node's digest in a fingerprint string.
SHORT = 6
#: Tags of the kinds of nodes.
LEAF, PARAGRAPH, SECTION, ROOT = b"\0", b"\1", b"\2", b"\3"
#: One in so many paragraphs ends a section.
SECTION_ODDS = 8
_LEAF = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")


def _digest(tag: bytes, content: bytes) -> bytes:
    return hashlib.sha256(tag + content).digest()[:16]


@dataclass(frozen=True)
class Node:
    digest: bytes
    size: int
    children: tuple[Node, ...] = ()

    @property
    def short(self) -> bytes:
        return self.digest[:SHORT]


def _leaf(text: str) -> Node:
    return Node(_digest(LEAF, text.encode()), len(text))


def _over(tag: bytes, children: tuple[Node, ...]) -> Node:
    return Node(_digest(tag, b"".join([c.digest for c in children])), sum([c.size for c in children]), children)


def _paragraph(line: str) -> Node:
    leaves = []
    for m in _LEAF.finditer(line):
        s = m[0]
        leaves += [_leaf(s)] if len(s) <= MAX_LEAF else [_leaf(s[i : i + MAX_LEAF]) for i in range(0, len(s), MAX_LEAF)]
    return _over(PARAGRAPH, tuple(leaves))


@dataclass(frozen=True)
class Tree:
    """A text's tree; ``sections`` are nodes over paragraphs over leaves."""

    sections: tuple[Node, ...]

    @staticmethod
    def of(text: str) -> Tree:
        sections, run = [], []
        at = 0
        while at < len(text):
            end = text.find("\n", at) + 1 or len(text)
            line = text[at:end]
            node = _paragraph(line)
            run.append(node)
            if node.digest[-1] % SECTION_ODDS == 0 or not line.strip():
                sections.append(_over(SECTION, tuple(run)))
                run = []
            at = end
        if run:
            sections.append(_over(SECTION, tuple(run)))
        return Tree(tuple(sections))

    @cached_property
    def root(self) -> str:
        return hashlib.sha256(ROOT + b"".join(s.digest for s in self.sections)).hexdigest()

    @property
    def size(self) -> int:
        return sum(s.size for s in self.sections)

    def __str__(self) -> str:
        def paragraph(p: Node) -> str:
            return f"{p.short.hex()}={'.'.join([f'{x.short.hex()}{x.size:x}' for x in p.children])}"

        return f"{self.root}|{';'.join([f'{s.short.hex()}:{",".join(map(paragraph, s.children))}' for s in self.sections])}"


def parse(fingerprint: str) -> Tree:
    """The tree of a fingerprint string; its digests are the short ones, which is all that comparisons use."""
    root, _, body = fingerprint.partition("|")
    digits = 2 * SHORT

    def leaf(s: str) -> Node:
        return Node(bytes.fromhex(s[:digits]), int(s[digits:], 16))

    def over(digest: str, children: tuple[Node, ...]) -> Node:
        return Node(bytes.fromhex(digest), sum(c.size for c in children), children)

    def paragraph(s: str) -> Node:
        digest, _, rest = s.partition("=")
        return over(digest, tuple(map(leaf, rest.split("."))))

    def section(s: str) -> Node:
        digest, _, rest = s.partition(":")
        return over(digest, tuple(map(paragraph, rest.split(","))))

    tree = Tree(tuple(map(section, body.split(";"))) if body else ())
    tree.__dict__["root"] = root
    return tree


def _unmatched(a: Iterable[Node], b: Iterable[Node]) -> tuple[list[Node], list[Node], int]:
    """What is left of both sides without equal nodes, and the size of the equal ones."""
    a = list(a)
    have = Counter([n.short for n in b])
    rest_a, same, taken = [], 0, Counter()
    for n in a:
        if have[n.short] > taken[n.short]:
            taken[n.short] += 1
            same += n.size
        else:
            rest_a.append(n)
    rest_b = []
    for n in b:
        if taken[n.short]:
            taken[n.short] -= 1
        else:
            rest_b.append(n)
    return rest_a, rest_b, same


def likeness(a: Tree, b: Tree) -> float:
    """0 to 1; 1 for equal texts."""
    if a.root == b.root:
        return 1.0
    shared = 0
    x, y = list(a.sections), list(b.sections)
    for _ in range(3):  # sections, paragraphs, leaves: only what differs is opened
        x, y, same = _unmatched(x, y)
        shared += same
        x, y = [c for n in x for c in n.children], [c for n in y for c in n.children]
    return min(1.0, 2 * shared / (a.size + b.size))


def locate_edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Character ranges of a (start, end) in paragraphs that b doesn't have; touching ranges are joined."""
    if a.root == b.root:
        return []
    rest = {id(p) for s in _unmatched(a.sections, b.sections)[0] for p in s.children}
    others = Counter(p.short for s in b.sections for p in s.children)
    out, at = [], 0
    for s in a.sections:
        for p in s.children:
            if id(p) in rest and not others[p.short]:
                if out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + p.size)
                else:
                    out.append((at, at + p.size))
            at += p.size
    return out


def _part_of(key: Column, splits: list) -> Column:
    """How many of the splitters (ascending) are above the key; null keys come after all."""
    step = max(1, int(len(splits) ** 0.5))
    groups = [splits[i : i + step] for i in range(0, len(splits), step)]
    if not groups:
        return F.lit(0)
    tops = F.array(*[F.lit(g[-1]) for g in groups])
    inner = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    sizes = F.array(*[F.lit(sum(map(len, groups[i + 1 :]))) for i in range(len(groups))])
    at = F.size(F.filter(tops, lambda s: s <= key))
    above = F.coalesce(F.get(sizes, at), F.lit(0)) + F.coalesce(F.size(F.filter(F.get(inner, at), lambda s: s > key)), F.lit(0))
    return F.when(key.isNull(), len(splits)).otherwise(F.when(at >= len(groups), 0).otherwise(above)).cast("int")


def _ranges(rows: DataFrame, n: int) -> tuple[Column, int]:
    """The range of each row (doc_id, h) in the order of (doc_id descending, nulls last; h), and the number of ranges."""
    share = [i / n for i in range(1, n)] or [0.5]
    quantiles, nulls, total = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, share)), F.lit(10 * n + 1000)), F.count_if(F.col("doc_id").isNull()), F.count(F.lit(1))).first()
    often = Counter(int(q) for q in quantiles or [])
    splits = sorted(often)
    # a range ends with its lowest splitter: if that id has several ranges' share, it gets as many of its own; so do nulls
    own = [often[s] if often[s] > 1 else 0 for s in reversed(splits)] + [n * nulls // total if total else 0]
    first = list(itertools.accumulate(own, lambda a, k: a + 1 + k, initial=0))
    part = _part_of(F.col("doc_id"), splits)
    ends = F.get(F.array(*map(F.lit, [*reversed(splits), None])).cast("array<bigint>"), part)
    k = F.get(F.array(*map(F.lit, own)), part)
    at = F.least((F.col("h") / F.lit(2.0**64) + 0.5) * k, k - 1).cast("int")  # by the hash, which is even
    sub = F.when((k > 0) & F.col("doc_id").eqNullSafe(ends), 1 + at).otherwise(0)
    return (F.get(F.array(*map(F.lit, first)), part) + sub).cast("int"), first[-1]


def with_next(docs: DataFrame, each: callable, schema: str) -> DataFrame:
    """Run ``each`` over (iterator of (doc_id, text), the row behind them) of every range in descending doc_id order.

    ``each`` gets pairs (row, next row) and yields record batches of the schema.
    """
    spark = docs.sparkSession
    ship_package(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    ids = rows.select("doc_id", "h")
    part, count = _ranges(ids, n)
    # The first row of each range, by one pass over ids and hashes: as many rows as ranges.
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "h")
    firsts = {r[0]: (None if r[1] else ~r[2], r[3]) for r in ids.groupBy(part.alias("p")).agg(F.min(place).alias("m")).select("p", "m.*").collect()}
    used = sorted(firsts)
    before = {p: used[i - 1] for i, p in enumerate(used)}  # the first range's first row comes after the last
    nowhere = (None, None)
    first_id, first_h = (F.get(F.array(*[F.lit(firsts.get(p, nowhere)[i]) for p in range(count)]).cast("array<bigint>"), F.col("_p")) for i in (0, 1))
    target = F.get(F.array(*[F.lit(before.get(p, 0)) for p in range(count)]), F.col("_p"))
    here = F.struct(F.col("_p").alias("p"), F.lit(0).alias("behind"))
    there = F.struct(target.alias("p"), F.lit(1).alias("behind"))
    placed = rows.withColumn("_p", part)
    starts = F.col("doc_id").eqNullSafe(first_id) & (F.col("h") == first_h)
    both = placed.select("doc_id", "text", "h", F.explode(F.when(starts, F.array(here, there)).otherwise(F.array(here))).alias("x"))
    dealt = both.select("doc_id", "text", "h", "x.p", "x.behind").repartitionById(count, F.col("p"))
    ordered = dealt.sortWithinPartitions("behind", F.col("doc_id").desc_nulls_last(), "h", "text").select("doc_id", "text", "behind")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def single() -> Iterator[tuple]:
            for batch in batches:
                for cut in slices(batch):
                    yield from zip(*(c.to_pylist() for c in cut.columns), strict=True)

        def pairs() -> Iterator[tuple]:
            held = None
            for doc, text, behind in single():
                if held is not None:
                    yield held, (doc, text)
                if behind:
                    return
                held = (doc, text)

        yield from each(pairs())

    return ordered.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _edit_rows(pairs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        coming, tree = None, None
        for (doc, text), following in pairs:
            tree = tree if coming is not None and coming == text else Tree.of(text)
            behind = Tree.of(following[1])
            changed = edited(text, following[1])
            other = Tree.of(changed)
            yield doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), str(tree), str(other), likeness(tree, other), likeness(tree, behind)
            coming, tree = following[1], behind

    found = rows()
    while some := list(itertools.islice(found, 500)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the likenesses."""
    return with_next(docs, _edit_rows, _SCHEMA)


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
