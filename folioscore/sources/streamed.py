"""JSON artifacts of any size, read in parallel: a row for each element of their top-level lists.

A whole artifact as one row is one task's work and 2 GB at most. Here Spark's text reader cuts the file at every "}", so that a large
file is many splits (blocks), and nobody holds more than one element.

Where a block starts, nobody knows at first whether that is within a string and how deep. So blocks are read more than once. The first pass
takes both cases: the number of quotes tells the state at the block's end, and the brackets outside of strings, for
either case, by how much the depth changes. Running sums over the blocks of a file (rows a block, not bytes) then give each
block's true start. The second tells which blocks start in a list of the root, the third cuts out the elements: an object in
a list that is a member of the root. One that spans blocks is put together from its pieces, which alone are shuffled; what is outside of
elements is the file's head, a small object.

No file is validated here: text that is no JSON object gives elements that parse to null, or none. Empty files give
nothing. Escapes, braces and quotes within strings are read as such. Elements that are no objects (a list of strings) stay in the head.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..session import discard, ship_package, written
from . import schemas as S

#: What ends a record of the reader; a record is cut after it, so an escape is never cut.
CUT = "}"
#: Blocks of a file whose starts may be broadcast.
FEW_BLOCKS = 200_000
#: Parts of an artifact are numbered; a part's blocks are numbered from its number times this.
LONGEST_PART = 1 << 42
#: Characters that a worker scans at once.
CHUNK = 4_000_000

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*("?)', re.DOTALL)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[{}\[\]]', re.DOTALL)
_EMPTY_LIST = re.compile(r"\[[\s,]+\]")


def _chunks(batches: Iterable[pa.RecordBatch], *more: str) -> Iterator[tuple[tuple, str]]:
    """((path, block, *more), text) in the file's order, CHUNK characters or a little more at a time."""
    now, held, size = None, [], 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("path", "block", *more)]
        for *key, value in zip(*columns, batch.column("value").to_pylist(), strict=True):
            if (key := tuple(key)) != now or size > CHUNK:
                if held:
                    yield now, "".join(held)
                now, held, size = key, [], 0
            held += (value, CUT)
            size += len(value) + 1
    if held:
        yield now, "".join(held)


def _depth(parts: list[str]) -> int:
    text = "".join(parts)
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part of a block: quotes, and the change of depth if it starts outside and inside a string."""
    for (path, block), text in _chunks(batches):
        parts = _ESCAPED.sub("", text).split('"')
        yield pa.RecordBatch.from_pydict({"path": [path], "block": [block], "quotes": [len(parts) - 1], "outside": [_depth(parts[::2])], "inside": [_depth(parts[1::2])]})


class Cutter:
    """Follows a block's text and tells its pieces: (role, key, text).

    Roles: ``item`` a whole element; ``open`` one that goes on in the next block; ``rest`` what goes on from an earlier block; ``last``
    the same, with its end; ``head`` text outside of elements. A key is null where the list was opened in an earlier block.
    """

    def __init__(self, in_string: bool, depth: int, listed: bool):
        self.in_string, self.depth = in_string, depth
        self.listed = listed  # whether the member of the root that holds this place is a list
        self.key: str | None = None
        self.text: str | None = None  # the last string of the root's own
        self.held: list[str] = []
        self.inherited = depth > 2

    def feed(self, chunk: str) -> Iterator[tuple[str, str | None, str]]:
        at = begin = 0
        if self.in_string:
            m = _REST_OF_STRING.match(chunk)
            self.in_string, at = not m[1], m.end()
        for m in _TOKEN.finditer(chunk, at):
            c = m[0]
            if c[0] == '"':
                if self.depth == 1:
                    self.text = c
                self.in_string = not m[1]
            elif c in "{[":
                if self.depth == 1:
                    self.listed = c == "["
                    self.key = json.loads(self.text) if self.text else None
                elif self.depth == 2 and self.listed and c == "{":
                    if between := chunk[begin : m.start()].strip(" \t\r\n,"):
                        yield "head", None, between
                    begin = m.start()
                    self.inherited = False
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == 2 and self.listed and c == "}":
                    yield "last" if self.inherited else "item", self.key, "".join([*self.held, chunk[begin : m.end()]])
                    self.held, begin, self.inherited = [], m.end(), False
                if not self.depth:  # the root's end: what follows is white space, or an added CUT
                    yield "head", None, chunk[begin : m.end()]
                    begin = len(chunk)
                    break
        if begin < len(chunk):
            if self.depth > 2 and self.listed:
                self.held.append(chunk[begin:])
            elif left := chunk[begin:].strip(" \t\r\n,") if self.depth == 2 and self.listed else chunk[begin:]:
                yield "head", None, left

    def end(self) -> Iterator[tuple[str, str | None, str]]:
        if self.held:
            yield "rest" if self.inherited else "open", self.key, "".join(self.held)


_PIECE = "path string, block long, part long, role string, key string, value string"


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, cutter, part = None, None, 0
    names = [f.split()[0] for f in _PIECE.split(", ")]

    def given(found: Iterable[tuple[str, str | None, str]]) -> Iterator[pa.RecordBatch]:
        nonlocal part
        rows = list(found)
        if rows:
            numbers = range(part, part + len(rows))
            part += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(rows), pa.string()), pa.array([now[1]] * len(rows), pa.int64()), pa.array(numbers, pa.int64()), *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], names=names)

    for key, text in _chunks(batches, "in_string", "depth", "listed", "ended"):
        if key != now:
            if cutter:
                yield from given(cutter.end())
            now, part = key, 0
            cutter = Cutter(*key[2:5])
        if not key[5]:
            yield from given(cutter.feed(text))
    if cutter:
        yield from given(cutter.end())


def _records(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    if parts:
        number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
        file, start = F.regexp_replace(file, "/[^/]*$", ""), number * LONGEST_PART + start
    return spark.read.option("lineSep", CUT).text(path).select(file.alias("path"), start.alias("block"), "value")


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk of a block that opens members of the root: whether the last of them is a list."""
    now, state = None, (False, 0)
    for key, text in _chunks(batches, "in_string", "depth"):
        if key != now:
            now, state = key, key[2:4]
        (inside, depth), seen = state, None
        at = 0
        if inside:
            m = _REST_OF_STRING.match(text)
            inside, at = not m[1], m.end()
        for m in _TOKEN.finditer(text, at):
            c = m[0]
            if c[0] == '"':
                inside = not m[1]
            elif c in "{[":
                if depth == 1:
                    seen = c == "["
                depth += 1
            else:
                depth -= 1
        state = inside, depth
        if seen is not None:
            yield pa.RecordBatch.from_pydict({"path": [now[0]], "block": [now[1]], "own": [seen]})


def _started(spark: SparkSession, records: DataFrame) -> DataFrame:
    """path, block, in_string, depth: the state in which each block starts."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = records.mapInArrow(_summaries, "path string, block long, quotes long, outside long, inside long")
    # a block's parts come in its order, but an aggregate forgets it: quotes before a part are counted within the block first
    numbered = sums.withColumn("n", F.monotonically_increasing_id())
    within = Window.partitionBy("path", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    odd = (F.coalesce(F.sum("quotes").over(within), F.lit(0)) % 2) == 1
    each = numbered.withColumn("odd", odd).groupBy("path", "block").agg(
        F.sum("quotes").alias("quotes"), F.sum(F.when(F.col("odd"), F.col("inside")).otherwise(F.col("outside"))).alias("outside"), F.sum(F.when(F.col("odd"), F.col("outside")).otherwise(F.col("inside"))).alias("inside")
    )
    stated = each.withColumn("in_string", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2) == 1)
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    return stated.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)).cast("long")).select("path", "block", "in_string", "depth")


def _with(records: DataFrame, starts: DataFrame) -> DataFrame:
    """The records in their order, with what is known of their block's start."""
    if starts.count() <= FEW_BLOCKS:
        return records.join(F.broadcast(starts), ["path", "block"])
    keyed = records.withColumn("_n", F.monotonically_increasing_id())
    return keyed.join(starts, ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "_n").drop("_n")


def pieces(spark: SparkSession, path: str, parts: bool = False) -> tuple[DataFrame, str]:
    """path, block, part, role, key, value: all pieces of the artifacts at a path (see Cutter), in the file's order by block and part.

    parts: the folder is one artifact, cut after any "}" into the files that ``write_parts`` leaves. They are written to the shared
    folder; the second value tells where.
    """
    ship_package(spark)
    records = _records(spark, path, parts)
    starts, kept = written(_started(spark, records), "starts")
    seen = _with(records, starts).mapInArrow(_listed, "path string, block long, own boolean").withColumn("n", F.monotonically_increasing_id())
    opened, also = written(seen.groupBy("path", "block").agg(F.max_by("own", "n").alias("own")), "opened")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = starts.join(opened, ["path", "block"], "left").select("path", "block", "in_string", "depth", F.coalesce(F.last("own", ignorenulls=True).over(before), F.lit(False)).alias("listed"))
    known = known.withColumn("ended", (F.col("depth") <= 0) & (F.row_number().over(Window.partitionBy("path").orderBy("block")) > 1))
    found = written(_with(records, known).mapInArrow(_pieces, _PIECE), "pieces")
    discard(spark, kept, also)
    return found


def write_parts(texts: DataFrame, path: str) -> None:
    """Write one artifact in parallel, as a folder of numbered files. texts: at, value, which in the order of ``at`` are its text.

    Every value ends with "}", as the reader's records do, so that no file ends within one. Rows of equal ``at`` go to one file.
    """
    cut = F.when(F.col("value").endswith(CUT), F.expr("substring(value, 1, char_length(value) - 1)")).otherwise(F.raise_error(F.lit("a text of an artifact in parts must end with }")))
    texts.repartitionByRange("at").sortWithinPartitions("at").select(cut.alias("value")).write.option("lineSep", CUT).text(path)


def elements(found: DataFrame) -> DataFrame:
    """path, key, position (from 0 within its list), value: an element's text each, from ``pieces``."""
    own = found.where("role <> 'head'")
    order = Window.partitionBy("path").orderBy("block", "part")
    # the few rows that tell where a block's elements belong: its last key, how many of each list start in it
    keyed = own.where("role IN ('item', 'open')").groupBy("path", "block", "key").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("part"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    named = keyed.withColumn("name", F.last("key", ignorenulls=True).over(running))
    lists = Window.partitionBy("path", "name").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = named.withColumn("first", F.coalesce(F.sum("n").over(lists), F.lit(0))).select("path", "block", F.col("key").alias("own_key"), "name", "first")
    inside = Window.partitionBy("path", "block", "key").orderBy("part")
    started = own.where("role IN ('item', 'open')").withColumn("k", F.row_number().over(inside) - 1)
    on = (started.path == firsts.path) & (started.block == firsts.block) & started.key.eqNullSafe(firsts.own_key)
    placed = started.join(firsts, on).select(started.path, started.block, "role", F.col("name").alias("key"), (F.col("first") + F.col("k")).alias("position"), "value")
    whole = placed.where("role = 'item'").select("path", "key", "position", "value")
    # pieces of elements that span blocks: each belongs to the last one opened before
    spanning = placed.where("role = 'open'").select("path", "block", "key", "position", "value").unionByName(own.where("role IN ('rest', 'last')").select("path", "block", F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("position"), "value"))
    turn = Window.partitionBy("path").orderBy("block", F.col("position").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    ids = spanning.withColumn("at", F.last(F.when(F.col("position").isNotNull(), F.struct("key", "position")), ignorenulls=True).over(turn))
    joined = ids.groupBy("path", "at").agg(F.array_sort(F.collect_list(F.struct("block", F.col("position").isNotNull().alias("opens"), "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p.value), "")
    return whole.unionByName(joined.select("path", "at.key", "at.position", text.alias("value")))


def heads(found: DataFrame) -> DataFrame:
    """path, value: each artifact's text without its elements."""
    parts = found.where("role = 'head'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "part", "value"))).alias("parts"))
    return parts.select("path", F.regexp_replace(F.array_join(F.transform("parts", lambda p: p.value), " "), _EMPTY_LIST.pattern, "[]").alias("value"))


class Artifact:
    """Artifacts of a kind as tables; lists are parsed element by element."""

    def __init__(self, spark: SparkSession, kind: str, path: str, parts: bool = False):
        self.schema = S.schema_of(kind)
        self.pieces, self._path = pieces(spark, path, parts)
        self.elements = elements(self.pieces)

    def close(self) -> None:
        """Delete the pieces, when the tables have been used."""
        discard(self.pieces.sparkSession, self._path)

    def of(self, name: str) -> DataFrame:
        """path, position, e: the typed elements of the list ``name``."""
        kind = self.schema[name].dataType
        assert isinstance(kind, ArrayType)
        return self.elements.where(F.col("key") == name).select("path", "position", F.from_json("value", kind.elementType).alias("e"))

    def head(self) -> DataFrame:
        """path, a: what is no list of objects."""
        fields = [f for f in self.schema if not (isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType))]
        return heads(self.pieces).select("path", F.from_json("value", StructType([StructField(f.name, f.dataType) for f in fields])).alias("a"))


def manifest_pages(artifact: Artifact) -> DataFrame:
    """As contracts.manifest_pages."""
    docs = artifact.of("documents")
    rows = docs.select(F.col("position").cast("int").alias("doc_pos"), F.col("e.document_id").alias("document_id"), F.col("e.split").alias("split"), F.col("e.category").alias("category"), F.posexplode("e.pages").alias("page_pos", "p"))
    return rows.select("document_id", "split", "category", "doc_pos", "page_pos", "p.*")


def truth_pages(artifact: Artifact) -> DataFrame:
    """As contracts.truth_pages."""
    from ..plans.scoring import last_of

    rows = artifact.of("documents").select(F.col("position").alias("doc_pos"), F.col("e.document_id").alias("document_id"), F.posexplode("e.pages").alias("page_pos", "truth"))
    return last_of(rows.select("document_id", F.col("truth.page_id").alias("page_id"), "doc_pos", "page_pos", "truth"), ["document_id", "page_id"], "doc_pos", "page_pos")


def truth_extractions(artifact: Artifact) -> DataFrame:
    return artifact.of("documents").select(F.explode("e.extractions").alias("x")).select("x.*")


def samples(artifact: Artifact) -> DataFrame:
    """As contracts.samples."""
    rows = artifact.of("samples")
    return rows.select(F.col("e.document_id").alias("document_id"), F.col("e.page_id").alias("page_id"), F.col("e").alias("sample"))


def extractions(artifact: Artifact) -> DataFrame:
    return artifact.of("document_extractions").select("e.*")
