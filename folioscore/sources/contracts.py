"""Reading artifacts and checking their contracts.

An artifact is a JSON object in a file, or many in a folder; what it holds becomes one row for each page, sample or
extraction. Rules give a table of violations (rule, artifact, key, message), so that a corpus of any size is
checked in one go; ``require`` turns the first of them into an error.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from . import schemas as S
from . import shapes


class ContractError(ValueError):
    """An artifact breaks its contract."""


# -- reading -----------------------------------------------------------------------------------------------------


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files; object stores included."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_artifact(spark: SparkSession, kind: str, path: str, strict: bool = True) -> DataFrame:
    """The typed artifact(s) at a path, a row each. strict: contract violations raise ContractError."""
    raw = read_text(spark, path)
    if strict:
        require(shape_violations(raw, kind))
        require(artifact_violations(raw.select(F.from_json("value", rule_schema(kind)).alias("a")).select("a.*"), kind))
    return raw.select(F.from_json("value", S.schema_of(kind)).alias("a")).select("a.*")


#: What V1 to V12 and the value rules read of the objects under a name ("" is the artifact itself); of other names' objects they may read all.
RULED = {name: frozenset(names.split()) for name, names in {
    "": "schema_version dataset_revision coordinate_system documents reference_sources samples document_extractions assets metrics",
    "documents": "document_id split category checksum pages extractions", "reference_sources": "reference_id", "samples": "document_id page_id status page error runtime_ms peak_memory_mb", "error": "code",
    "extractions": "document_id schema_name schema_version fields validations", "fields": "value_type confidence bbox", "validations": "status", "confidence": "score",
    "pages": "page_id page_index checksum width height source_kind blocks reading_order", "blocks": "block_id block_type bbox reading_order_index confidence lines table",
    "lines": "line_id spans", "spans": "span_id", "cells": "cell_id row_index column_index row_span column_span",
}.items()}
RULED |= {"page": RULED["pages"], "document_extractions": RULED["extractions"]}


def rule_schema(kind: str) -> T.StructType:
    """The schema of a kind without what no rule reads: parsing skips that instead of building it."""

    def ruled(x: T.DataType, name: str) -> T.DataType:
        if isinstance(x, T.ArrayType):
            return T.ArrayType(ruled(x.elementType, name), x.containsNull)
        if isinstance(x, T.StructType):
            return T.StructType([T.StructField(f.name, ruled(f.dataType, f.name), f.nullable) for f in x if f.name in RULED.get(name, x.names)])
        return x

    return ruled(S.schema_of(kind), "")


def manifest_pages(manifest: DataFrame) -> DataFrame:
    docs = manifest.select(F.posexplode("documents").alias("doc_pos", "d"))
    pages = docs.select("doc_pos", F.col("d.document_id").alias("document_id"), F.col("d.split").alias("split"), F.col("d.category").alias("category"), F.posexplode("d.pages").alias("page_pos", "p"))
    return pages.select("document_id", "split", "category", "doc_pos", "page_pos", "p.*")


def truth_pages(truth: DataFrame) -> DataFrame:
    """document_id, page_id, truth (the page); of equal keys the last page counts."""
    from ..plans.scoring import last_of

    docs = truth.select(F.posexplode("documents").alias("doc_pos", "d"))
    pages = docs.select("doc_pos", F.col("d.document_id").alias("document_id"), F.posexplode("d.pages").alias("page_pos", "truth"))
    return last_of(pages.select("document_id", F.col("truth.page_id").alias("page_id"), "doc_pos", "page_pos", "truth"), ["document_id", "page_id"], "doc_pos", "page_pos")


def truth_extractions(truth: DataFrame) -> DataFrame:
    docs = truth.select(F.explode("documents").alias("d"))
    return docs.select(F.explode("d.extractions").alias("e")).select("e.*")


def samples(predictions: DataFrame) -> DataFrame:
    rows = predictions.select(F.explode("samples").alias("sample"))
    return rows.select(F.col("sample.document_id").alias("document_id"), F.col("sample.page_id").alias("page_id"), "sample")


def extractions(predictions: DataFrame) -> DataFrame:
    return predictions.select(F.explode("document_extractions").alias("e")).select("e.*")


# -- rules -------------------------------------------------------------------------------------------------------


def _violations(rows: DataFrame, rule: str, artifact: str, key: Column, message: str | Column) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(rule).alias("rule"), F.lit(artifact).alias("artifact"), key.cast("string").alias("key"), text.alias("message"))


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeated(rows: DataFrame, keys: list[str], rule: str, artifact: str, message: str) -> DataFrame:
    twice = rows.groupBy(*keys).count().where("count > 1")
    return _violations(twice, rule, artifact, F.concat_ws("/", *keys), message)


def bad_values(rows: DataFrame, artifact: str, key: Column, checks: dict[str, Column]) -> DataFrame:
    """One row for each check (a condition that must hold; null counts as failed) that a row fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return _violations(rows.select(key.cast("string").alias("k"), F.explode(failed).alias("m")), "value", artifact, F.col("k"), F.col("m"))


def identifier(column: Column) -> Column:
    return column.rlike(S.IDENTIFIER)


def sound_checksum(c: Column) -> Column:
    return (c.algorithm == "sha256") & c.value.rlike("^[0-9a-fA-F]{64}$") & (c.size_bytes.isNull() | (c.size_bytes >= 0))


def sound_box(b: Column) -> Column:
    return (b.x >= 0) & (b.y >= 0) & (b.width > 0) & (b.height > 0)


def safe_path(path: Column) -> Column:
    """Relative POSIX path without backslashes or parent steps."""
    return (F.char_length(path) > 0) & ~path.rlike(r"\\|^/|(^|/)\.\.(/|$)")


def table_grid_ok(t: Column) -> Column:
    """V1: unique cell ids, and each cell within the grid."""
    ids = F.transform(t.cells, lambda c: c.cell_id)
    inside = F.forall(t.cells, lambda c: (c.row_index >= 0) & (c.column_index >= 0) & (c.row_span >= 1) & (c.column_span >= 1) & (c.row_index + c.row_span <= t.rows) & (c.column_index + c.column_span <= t.columns))
    return (F.size(t.cells) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids)) & inside


def reading_order_ok(page: Column) -> Column:
    """V2: no repeats, and only ids of the page's blocks and lines."""
    known = F.concat(F.transform(page.blocks, lambda b: b.block_id), F.flatten(F.transform(page.blocks, lambda b: F.transform(b.lines, lambda x: x.line_id))))
    return (F.size(F.array_distinct(page.reading_order)) == F.size(page.reading_order)) & (F.size(F.array_except(page.reading_order, known)) == 0)


# A fault is (said, key): said is the place of its (rule, message, once) in a list, keys are lists of ids. Where ``once`` is true, the
# row only says that the key was given, and it is a fault if another row says so as well. What holds gives null, which is dropped after
# the lists of faults are exploded: what stands within a higher-order function (such as array_compact) is interpreted, not compiled.

_FAULT = "array<struct<said: int, key: array<string>>>"
_SAID: dict[tuple[str, str, bool], int] = {}


def _fault(rule: str, key: Column, message: str, once: bool = False) -> Column:
    said = _SAID.setdefault((rule, message, once), len(_SAID))
    return F.struct(F.lit(said).alias("said"), key.cast("array<string>").alias("key"))


def _unless(ok: Column, fault: Column) -> Column:
    """The fault, unless the condition holds (null counts as failed)."""
    return F.when(~F.coalesce(ok, F.lit(False)), fault)


def _values(key: Column, checks: dict[str, Column]) -> list[Column]:
    return [_unless(ok, _fault("value", key, name)) for name, ok in checks.items()]


def _rule(rule: str, key: Column, ok: Column, message: str) -> list[Column]:
    return [_unless(ok, _fault(rule, key, message))]


def _given(rule: str, key: Column, message: str) -> list[Column]:
    return [_fault(rule, key, message, True)]


def _faults(*parts: list[Column], when: Column | None = None) -> Column:
    found = F.array(*[fault for part in parts for fault in part]).cast(_FAULT)
    return found if when is None else F.when(when, found).otherwise(F.array().cast(_FAULT))


def _page_faults(document: Column, p: Column) -> Column:
    key = F.array(document, p.page_id)
    blocks = F.coalesce(p.blocks, F.array())
    checks = {
        "page_id is no identifier": identifier(p.page_id), "page_index below 0": p.page_index >= 0, "checksum": sound_checksum(p.checksum), "size": (p.width > 0) & (p.height > 0),
        "block type": F.forall(blocks, lambda b: b.block_type.isin(*S.BLOCK_TYPES)), "block box": F.forall(blocks, lambda b: sound_box(b.bbox)),
        "confidence": F.forall(blocks, lambda b: b.confidence.score.between(0, 1)), "reading_order_index": F.forall(blocks, lambda b: b.reading_order_index >= 0),
        "line without spans": F.forall(blocks, lambda b: F.forall(F.coalesce(b.lines, F.array()), lambda x: F.size(x.spans) > 0)),
    }
    grids = F.coalesce(F.forall(blocks, lambda b: b.table.isNull() | table_grid_ok(b.table)), F.lit(True))
    return _faults(_values(key, checks), _rule("V1", key, grids, "table cells repeat an id or leave the grid"), _rule("V2", key, reading_order_ok(p), "reading_order repeats or names unknown ids"), when=p.isNotNull())


def _extraction_faults(x: Column) -> Column:
    fields = F.coalesce(x.fields, F.array())
    checks = {
        "document_id is no identifier": identifier(x.document_id), "value_type": F.forall(fields, lambda f: f.value_type.isin(*S.VALUE_TYPES)),
        "field confidence": F.forall(fields, lambda f: f.confidence.score.between(0, 1)), "field box": F.forall(fields, lambda f: f.bbox.isNull() | F.coalesce(sound_box(f.bbox), F.lit(False))),
        "validation status": F.forall(F.coalesce(x.validations, F.array()), lambda v: v.status.isin(*S.VALIDATION_STATUSES)),
    }
    return _faults(_values(F.array(x.document_id, x.schema_name), checks), when=x.isNotNull())


def _sample_faults(s: Column) -> Column:
    """V8 and V9."""
    key = F.array(s.document_id, s.page_id)
    fits = F.when(s.status == "success", s.page.isNotNull() & s.error.isNull()).otherwise(s.error.isNotNull())
    measured = {"status": s.status.isin(*S.STATUSES), "runtime_ms below 0": s.runtime_ms.isNull() | (s.runtime_ms >= 0), "peak_memory_mb below 0": s.peak_memory_mb.isNull() | (s.peak_memory_mb >= 0)}
    return _faults(_values(key, measured), _rule("V8", key, fits, "status and payload disagree"), _given("V9", key, "sample given twice"), when=s.isNotNull())


def _asset_faults(a: Column) -> Column:
    key = F.array(a.document_id, a.page_id)
    checks = {"media_type": a.media_type.isin(*S.MEDIA_TYPES), "checksum": sound_checksum(a.checksum), "size": (a.width > 0) & (a.height > 0)}
    return _faults(_values(key, checks), _rule("V5", key, safe_path(a.relative_path), "asset path is not a safe relative POSIX path"), _given("V6", key, "asset given twice"), when=a.isNotNull())


def _document_faults(d: Column) -> Column:
    key = F.array(d.document_id)
    checks = {"document_id": identifier(d.document_id), "split": d.split.isin(*S.SPLITS), "category": identifier(d.category), "checksum": sound_checksum(d.checksum), "no pages": F.size(d.pages) > 0}
    return _faults(_values(key, checks), _given("V4", key, "document id given twice"), when=d.isNotNull())


def _listed_page_faults(document: Column, p: Column) -> Column:
    key = F.array(document, p.page_id)
    checks = {"page_id": identifier(p.page_id), "page_index": p.page_index >= 0, "checksum": sound_checksum(p.checksum), "size": (p.width > 0) & (p.height > 0), "source_kind": p.source_kind.isin(*S.SOURCE_KINDS)}
    return _faults(_values(key, checks), _given("V3", key, "page id given twice in a document"), _given("V4", F.array(p.page_id), "page id given twice"), when=p.isNotNull())


def _head_faults(artifact: DataFrame, kind: str) -> Column:
    checks = {
        "schema_version": F.col("schema_version").rlike(r"^\d+\.\d+\.\d+$"),
        "dataset_revision": identifier(F.col("dataset_revision.dataset_id")) & F.col("dataset_revision.revision").rlike(S.REVISION),
    }
    if "coordinate_system" in artifact.columns:
        checks["coordinate_system"] = reduce(lambda a, b: a & b, [F.col(f"coordinate_system.{k}") == v for k, v in S.COORDINATES.items()])
    found = _faults(_values(F.array(F.lit(kind)), checks))
    if kind == "manifest":
        sources = F.coalesce("reference_sources", F.array())
        return F.concat(found, F.transform(sources, lambda r: _fault("V4", F.array(r.reference_id), "reference id given twice", True)).cast(_FAULT))
    if kind == "report":
        sound = lambda m: (m.micro >= 0) & (m.macro >= 0) & (m.sample_count >= 0)
        return F.concat(found, F.coalesce(F.transform(F.map_entries("metrics"), lambda e: _unless(sound(e.value), _fault("value", F.array(e.key), "metric"))), F.array()).cast(_FAULT))
    return found


def _items(artifact: DataFrame, kind: str) -> DataFrame:
    """A row for each document, page, extraction, sample or asset; ``head`` has the artifact's own faults in its first row.

    The lists of an artifact become one list, so that one explode reads them all: of each kind of item a column, null in the others' rows.
    """
    def both(**lists: Column) -> Column:
        types = {name: artifact.select(column.alias("c")).schema["c"].dataType.elementType for name, column in lists.items()}

        def alone(own: str) -> Callable[[Column], Column]:
            return lambda x: F.struct(*[(x if n == own else F.lit(None)).cast(t).alias(n) for n, t in types.items()])

        return F.concat(*[F.transform(F.coalesce(column, F.array()), alone(name)) for name, column in lists.items()])

    if kind in ("manifest", "ground-truth"):
        docs = artifact.select(_head_faults(artifact, kind).alias("head"), F.posexplode_outer("documents").alias("at", "d"))
        first = F.when(F.coalesce(F.col("at"), F.lit(0)) == 0, F.col("head")).otherwise(F.array().cast(_FAULT))
        d = F.col("d")
        if kind == "manifest":
            return docs.select(first.alias("head"), _document_faults(d).alias("own"), d.document_id.alias("document_id"), F.posexplode_outer(d.pages).alias("i", "page"))
        own = _faults(_given("V7", F.array(d.document_id), "document id given twice"), when=d.isNotNull())
        docs = docs.select(first.alias("head"), own.alias("own"), d.document_id.alias("document_id"), d.pages.alias("pages"), d.extractions.alias("extractions"))
        artifact = docs
        return docs.select("head", "own", "document_id", F.posexplode_outer(both(page=F.col("pages"), extraction=F.col("extractions"))).alias("i", "x")).select("head", "own", "document_id", "i", "x.*")
    heads = artifact.withColumn("head", _head_faults(artifact, kind))
    if kind == "prediction":
        return heads.select("head", F.posexplode_outer(both(sample=F.col("samples"), extraction=F.col("document_extractions"))).alias("i", "x")).select("head", "i", "x.*")
    if kind == "assets":
        return heads.select("head", F.posexplode_outer("assets").alias("i", "asset"))
    return heads.select("head", F.lit(0).alias("i"))


def artifact_violations(artifact: DataFrame, kind: str) -> DataFrame:
    """All violations within artifacts of a kind: the artifacts are read once, and one grouping finds what is given twice."""
    rows = _items(artifact, kind)
    first = F.coalesce(F.col("i"), F.lit(0)) == 0
    parts = [F.when(first, F.col(c)).otherwise(F.array().cast(_FAULT)) for c in ("head", "own") if c in rows.columns]
    if kind == "manifest":
        parts.append(_listed_page_faults(F.col("document_id"), F.col("page")))
    elif kind == "ground-truth":
        parts += [_page_faults(F.col("document_id"), F.col("page")), _extraction_faults(F.col("extraction"))]
    elif kind == "prediction":
        s, x = F.col("sample"), F.col("extraction")
        parts += [_sample_faults(s), _page_faults(s.document_id, s.page), _extraction_faults(x), _faults(_given("V9", F.array(x.document_id, x.schema_name, x.schema_version), "extraction given twice"), when=x.isNotNull())]
    elif kind == "assets":
        parts.append(_asset_faults(F.col("asset")))
    found = rows.select(F.concat(*parts).alias("found")).select(F.explode_outer("found").alias("f")).where("f IS NOT NULL").select("f.*")
    counted = found.groupBy("said", "key").count()
    rule, message, once = (F.get(F.array(*map(F.lit, column)), F.col("said")) for column in zip(*_SAID, strict=True))
    times = F.when(once, (F.col("count") > 1).cast("int")).otherwise(F.col("count").cast("int"))
    shown = counted.select(rule.alias("rule"), F.lit(kind).alias("artifact"), F.concat_ws("/", "key").alias("key"), message.alias("message"), F.explode(F.array_repeat(F.lit(1), times)).alias("_"))
    return shown.drop("_")


def asset_files(spark: SparkSession, assets: DataFrame, folder: str, pattern: str = "*") -> DataFrame:
    """Violations of a typed asset index against the files of a folder and its subfolders, whose bytes the executors read.

    A listed file that isn't there, a file matching the pattern that isn't listed, another size, another SHA-256: a row each, its key
    the relative path. A size of null isn't compared. Paths listed twice are compared once for each. Files over 2 GB can't be read whole (Spark says so).
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    found = files.select(F.substring("path", len(root) + 2, 1 << 20).alias("relative_path"), F.col("length").alias("own_size"), F.sha2("content", 256).alias("own_sum"))
    listed = assets.select(F.explode("assets").alias("a")).select(F.col("a.relative_path").alias("relative_path"), F.col("a.checksum.size_bytes").alias("size"), F.lower("a.checksum.value").alias("sum"), F.lit(True).alias("is_listed"))
    both = listed.join(found, "relative_path", "full")
    said = (
        F.when(F.col("own_sum").isNull(), "listed, but there is no such file").when(F.col("is_listed").isNull(), "a file that isn't listed")
        .when(F.col("size") != F.col("own_size"), "the file has another size").when(~F.col("sum").eqNullSafe(F.col("own_sum")), "the file has another SHA-256")
    )
    return _violations(both.withColumn("said", said).where("said IS NOT NULL"), "file", "assets", F.col("relative_path"), F.col("said"))


def key_containment(manifest: DataFrame, rows: DataFrame, keys: list[str], rule: str, artifact: str) -> DataFrame:
    """Keys of rows that the manifest doesn't have."""
    unknown = rows.select(*keys).join(manifest.select(*keys).distinct(), keys, "left_anti").distinct()
    return _violations(unknown, rule, artifact, F.concat_ws("/", *keys), "unknown to the manifest")


def _claims(artifact: DataFrame, **keys: Column) -> DataFrame:
    """(rule, key) of all that an artifact names; keys: for each rule, arrays of arrays of ids. The artifact is read once."""
    heads = [F.array(F.struct(F.lit(f"V10 {c}").alias("rule"), F.array(F.coalesce(F.to_json(c), F.lit("null"))).alias("key"))) for c in _HEADS]

    def by(rule: str) -> Callable[[Column], Column]:
        return lambda k: F.struct(F.lit(rule).alias("rule"), k.alias("key"))

    named = [F.transform(F.coalesce(each, F.array().cast("array<array<string>>")), by(rule)) for rule, each in keys.items()]
    return artifact.select(F.explode(F.concat(*heads, *named)).alias("c")).select("c.*")


def _pairs(documents: Column, pages: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(documents, lambda d: F.coalesce(F.transform(pages(d), lambda p: F.array(d.document_id, p.page_id)), F.array().cast("array<array<string>>"))))


_HEADS = ("dataset_revision", "coordinate_system")


def bundle_violations(manifest: DataFrame, truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """V10 to V12, over the three typed artifacts: each is read once, and what they name meets in one grouping.

    An id of null is unknown to every manifest; heads of null equal each other.
    """
    docs = F.col("documents")
    known = _claims(manifest, V11=_pairs(docs, lambda d: d.pages), V12=F.transform(docs, lambda d: F.array(d.document_id)))
    known = known.where(F.forall("key", lambda k: k.isNotNull()))  # else null ids would meet
    extracted = F.flatten(F.transform(docs, lambda d: F.coalesce(F.transform(d.extractions, lambda e: F.array(e.document_id)), F.array().cast("array<array<string>>"))))
    said = {
        "ground-truth": _claims(truth, V11=_pairs(docs, lambda d: d.pages), V12=extracted),
        "prediction": _claims(predictions, V11=F.transform("samples", lambda x: F.array(x.document_id, x.page_id)), V12=F.transform("document_extractions", lambda e: F.array(e.document_id))),
    }
    rows = _union([known.withColumn("by", F.lit("manifest")), *[rows.withColumn("by", F.lit(name)) for name, rows in said.items()]])
    names = F.array_compact(F.array(*[F.when(F.bool_or(F.col("by") == name), F.lit(name)) for name in said]))
    met = rows.groupBy("rule", "key").agg(F.bool_or(F.col("by") == "manifest").alias("is_known"), names.alias("names"))
    strange = met.where("NOT is_known").select("rule", "key", F.explode("names").alias("artifact"))
    head = F.when(F.col("rule").startswith("V10 "), F.substring("rule", 5, 1 << 10))
    return strange.select(F.substring("rule", 1, 3).alias("rule"), "artifact", F.coalesce(head, F.concat_ws("/", "key")).alias("key"), F.coalesce(F.concat(head, F.lit(" differs from the manifest's")), F.lit("unknown to the manifest")).alias("message"))


def _walk(batches: Iterable[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    names = ("path", "rule", "place", "message")
    for batch in batches:
        found = ((path, *fault) for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for fault in shapes.text_faults(text, kind))
        while piece := list(itertools.islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*piece, strict=True)], names=list(names))


def faults_of(raw: DataFrame, kind: str) -> DataFrame:
    """(path, rule, place, message) of all faults of shape: no JSON object, unknown or missing keys, types, closed lists, bounds.

    raw: path and value, a file's text each. Files are walked on the executors.
    """
    ship_package(raw.sparkSession)
    return raw.select("path", "value").mapInArrow(functools.partial(_walk, kind=kind), "path string, rule string, place string, message string")


def shape_violations(raw: DataFrame, kind: str) -> DataFrame:
    found = faults_of(raw, kind)
    return found.select("rule", F.lit(kind).alias("artifact"), F.col("place").alias("key"), F.concat("message", F.lit(" in "), "path").alias("message"))


def require(violations: DataFrame) -> None:
    """Raise ContractError on the first violation."""
    order = F.struct("rule", "artifact", "key", "message")
    if first := violations.agg(F.min(order).alias("v")).first().v:  # one row a task reaches the last one
        raise ContractError(f"{first.artifact}: {first.rule}: {first.key}: {first.message}")


def schema_json(kind: str) -> str:
    return json.dumps(json.loads(S.schema_of(kind).json()), indent=2, sort_keys=True)
