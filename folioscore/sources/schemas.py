"""Typed schemas of the five artifacts, their closed value lists, and the metric specification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SCHEMA_VERSION = "1.1.0"
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,199}$"
REVISION = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$"

# The contracts' closed lists.
SPLITS = ("dev", "validation", "test-public", "test-private")
SOURCE_KINDS = ("native_pdf", "scanned_pdf", "image", "synthetic_record", "unknown")
STATUSES = ("success", "crashed", "timeout", "missing")
MEDIA_TYPES = ("image/png", "image/jpeg", "image/tiff")
VALUE_TYPES = ("string", "date", "identifier", "decimal", "currency")
EVENT_STATUSES = ("attempted", "accepted", "rejected", "failed", "skipped")
VALIDATION_STATUSES = ("pass", "fail", "review")
LANGUAGES = ("ar", "fr", "en", "latin", "mixed", "unknown")
SCRIPTS = ("arabic", "latin", "mixed", "common", "unknown")
DIRECTIONS = ("rtl", "ltr", "mixed", "unknown")
FAILURES = ("missing", "crashed", "timeout", "invalid", "ground_truth_missing")
SEVERITIES = ("info", "warning", "error")
PROVENANCES = ("human_annotation", "synthetic_generator", "system_prediction", "native_pdf", "ocr", "vlm", "manual_correction", "derived")
SOURCE_TYPES = ("synthetic", "redistributable", "reference-only", "private-evaluation")
LICENSES = ("verified", "unverified", "unknown", "not_applicable")
REDISTRIBUTIONS = ("redistributable", "reference-only", "private-evaluation", "synthetic")
UNITS = ("page", "digit_page", "block", "equation", "table", "milliseconds", "megabytes", "field", "financial_value", "confidence_block", "diagram")
BLOCK_TYPES = ("title", "instruction", "exercise", "subquestion", "paragraph", "list", "table", "equation", "figure", "diagram", "caption", "header", "footer", "page_number", "answer_space", "stamp", "signature", "unknown")
COORDINATES = {"unit": "pixel", "origin": "top_left", "x_axis": "right", "y_axis": "down"}

CHECKSUM = "struct<algorithm: string, value: string, size_bytes: bigint>"
BBOX = "struct<x: double, y: double, width: double, height: double>"
CONFIDENCE = "struct<score: double, calibrated: boolean, method: string>"
OPEN_MAP = "map<string, variant>"
PROVENANCE = f"struct<kind: string, source: string, version: string, model: string, stage: string, details: {OPEN_MAP}>"
WARNING = "struct<code: string, message: string, severity: string, stage: string>"
ERROR = "struct<code: string, message: string, stage: string, retryable: boolean>"
EVENT = f"struct<event_id: string, stage: string, status: string, trigger: string, adapter_name: string, adapter_version: string, model_name: string, model_revision: string, confidence_before: double, confidence_after: double, duration_ms: double, details: {OPEN_MAP}>"
ALTERNATIVE = f"struct<raw_text: string, normalized_text: string, confidence: {CONFIDENCE}, provenance: {PROVENANCE}, reason: string>"
_TEXTS = "raw_text: string, normalized_text: string, search_text: string, language: string, script: string, direction: string"
SPAN = f"struct<span_id: string, {_TEXTS}, bbox: {BBOX}, confidence: {CONFIDENCE}, provenance: {PROVENANCE}, alternatives: array<{ALTERNATIVE}>, warnings: array<{WARNING}>>"
LINE = f"struct<line_id: string, {_TEXTS}, bbox: {BBOX}, reading_order_index: int, confidence: {CONFIDENCE}, provenance: {PROVENANCE}, spans: array<{SPAN}>, alternatives: array<{ALTERNATIVE}>, warnings: array<{WARNING}>>"
CELL = f"struct<cell_id: string, row_index: int, column_index: int, row_span: int, column_span: int, bbox: {BBOX}, raw_text: string, normalized_text: string>"
TABLE = f"struct<rows: int, columns: int, cells: array<{CELL}>>"
BLOCK = f"struct<block_id: string, block_type: string, bbox: {BBOX}, reading_order_index: int, confidence: {CONFIDENCE}, provenance: {PROVENANCE}, lines: array<{LINE}>, equation_text: string, table: {TABLE}, alternatives: array<{ALTERNATIVE}>, warnings: array<{WARNING}>>"
PAGE = f"struct<page_id: string, page_index: int, checksum: {CHECKSUM}, width: int, height: int, blocks: array<{BLOCK}>, reading_order: array<string>, provenance: {PROVENANCE}, warnings: array<{WARNING}>, events: array<{EVENT}>>"
FIELD = f"struct<field_id: string, field_name: string, value: string, normalized_value: string, value_type: string, confidence: {CONFIDENCE}, page_id: string, bbox: {BBOX}, provenance: {PROVENANCE}, warnings: array<{WARNING}>>"
VALIDATION = "struct<rule: string, status: string, message: string, confidence: double>"
EXTRACTION = f"struct<document_id: string, schema_name: string, schema_version: string, fields: array<{FIELD}>, validations: array<{VALIDATION}>>"
REVISION_OF = f"struct<dataset_id: string, revision: string, manifest_checksum: {CHECKSUM}>"
COORDINATE_SYSTEM = "struct<unit: string, origin: string, x_axis: string, y_axis: string>"
SOURCE = "struct<kind: string, title: string, canonical_source_url: string, source_organization: string, retrieval_date: string, license_status: string, redistribution: string, notes: string>"
REFERENCE = "struct<reference_id: string, title: string, canonical_source_url: string, source_organization: string, retrieval_date: string, license_status: string, redistribution: string, notes: string>"
MANIFEST_PAGE = f"struct<page_id: string, page_index: int, checksum: {CHECKSUM}, width: int, height: int, source_kind: string, tags: array<string>>"
MANIFEST_DOCUMENT = f"struct<document_id: string, split: string, category: string, checksum: {CHECKSUM}, source: {SOURCE}, pages: array<{MANIFEST_PAGE}>>"
TRUTH_DOCUMENT = f"struct<document_id: string, pages: array<{PAGE}>, extractions: array<{EXTRACTION}>>"
SAMPLE = f"struct<document_id: string, page_id: string, status: string, page: {PAGE}, error: {ERROR}, runtime_ms: double, peak_memory_mb: double>"
SYSTEM = f"struct<name: string, version: string, adapter_name: string, adapter_version: string, model_name: string, model_version: string, execution_provider: string, command: string, git_commit: string, runtime: {OPEN_MAP}, hardware: {OPEN_MAP}>"
RUN = "struct<run_id: string, started_at: timestamp, finished_at: timestamp, duration_ms: double, command: string, dependency_lock_hash: string>"
ASSET = f"struct<document_id: string, page_id: string, media_type: string, relative_path: string, checksum: {CHECKSUM}, width: int, height: int>"
SUMMARY = "struct<total_pages: bigint, scored_pages: bigint, missing_pages: bigint, crashed_pages: bigint, timeout_pages: bigint, invalid_pages: bigint, ground_truth_missing_pages: bigint>"
METRIC = "struct<micro: double, macro: double, sample_count: bigint, unit: string, higher_is_better: boolean>"
FAILURE = "struct<document_id: string, page_id: string, status: string, message: string>"

_HEAD = f"schema_version string, dataset_revision {REVISION_OF}, coordinate_system {COORDINATE_SYSTEM}"
ARTIFACTS: dict[str, str] = {
    "manifest": f"{_HEAD}, documents array<{MANIFEST_DOCUMENT}>, reference_sources array<{REFERENCE}>, notes array<string>",
    "ground-truth": f"{_HEAD}, annotation_provenance {PROVENANCE}, documents array<{TRUTH_DOCUMENT}>",
    "prediction": f"{_HEAD}, system {SYSTEM}, run {RUN}, samples array<{SAMPLE}>, document_extractions array<{EXTRACTION}>",
    "assets": f"schema_version string, dataset_revision {REVISION_OF}, assets array<{ASSET}>",
    "report": f"{_HEAD}, system {SYSTEM}, run {RUN}, generated_at timestamp, summary {SUMMARY}, metrics map<string, {METRIC}>, category_breakdown array<struct<category: string, summary: {SUMMARY}, metrics: map<string, {METRIC}>>>, failures array<{FAILURE}>, notes array<string>",
}


# What a JSON artifact must hold, object by object. A name is required; with "?" it may be left out or null, with "~" left out,
# with "!" null. A value is a kind of text or number, a tuple of allowed values, another object's name, [x] for a list of x
# ([x, 1]: of one at least), or {"*": x} for any names.
_PLACE = {"bbox": "bbox", "confidence": "confidence", "provenance": "provenance", "alternatives": ["alternative"], "warnings": ["warning"]}
_WORDS = {"raw_text": "string", "normalized_text": "string", "search_text?": "string", "language": LANGUAGES, "script": SCRIPTS, "direction": DIRECTIONS}
_SOURCE = {"canonical_source_url?": "string", "source_organization?": "string", "retrieval_date?": "string"}
_PIXELS = {"width": "positive", "height": "positive"}
_KEY = {"document_id": "identifier", "page_id": "identifier"}
_TOP = {"schema_version": "version", "dataset_revision": "dataset_revision"}
_TOPS = _TOP | {"coordinate_system": {k: (v,) for k, v in COORDINATES.items()}}
_MAKER = {"system": "system", "run": "run"}
SHAPES: dict[str, dict] = {
    "checksum": {"algorithm": ("sha256",), "value": "sha256", "size_bytes?": "count"},
    "dataset_revision": {"dataset_id": "identifier", "revision": "revision", "manifest_checksum?": "checksum"},
    "bbox": {"x": "amount", "y": "amount", "width": "extent", "height": "extent"},
    "confidence": {"score": "share", "calibrated": "boolean", "method?": "text"},
    "warning": {"code": "identifier", "message": "text", "severity": SEVERITIES, "stage?": "text"},
    "error": {"code": "identifier", "message": "text", "stage?": "text", "retryable": "boolean"},
    "provenance": {"kind": PROVENANCES, "source": "text", "version?": "text", "model?": "text", "stage?": "text", "details": "open"},
    "event": {
        "event_id": "identifier", "stage": "text", "status": EVENT_STATUSES, "trigger": "text", "adapter_name": "text", "adapter_version": "text", "model_name?": "string", "model_revision?": "string",
        "confidence_before?": "share", "confidence_after?": "share", "duration_ms?": "amount", "details": "open",
    },
    "alternative": {"raw_text": "string", "normalized_text": "string", "confidence": "confidence", "provenance": "provenance", "reason?": "text"},
    "cell": {"cell_id": "identifier", "row_index": "count", "column_index": "count", "row_span": "positive", "column_span": "positive", "bbox": "bbox", "raw_text": "string", "normalized_text": "string"},
    "table": {"rows": "positive", "columns": "positive", "cells": ["cell", 1]},
    "span": {"span_id": "identifier"} | _WORDS | _PLACE,
    "line": {"line_id": "identifier"} | _WORDS | _PLACE | {"reading_order_index": "count", "spans": ["span", 1]},
    "block": {"block_id": "identifier", "block_type": BLOCK_TYPES, "reading_order_index": "count", "lines": ["line"], "equation_text?": "string", "table?": "table"} | _PLACE,
    "page": {"page_id": "identifier", "page_index": "count", "checksum": "checksum", "blocks": ["block"], "reading_order": ["identifier"], "provenance": "provenance", "warnings": ["warning"], "events~": ["event"]} | _PIXELS,
    "source": {"kind": SOURCE_TYPES, "title": "text", "license_status": LICENSES, "redistribution": REDISTRIBUTIONS, "notes?": "string"} | _SOURCE,
    "reference": {"reference_id": "identifier", "title": "text", "license_status": LICENSES[:3], "redistribution": REDISTRIBUTIONS[:3], "notes": "text"} | _SOURCE,
    "manifest_page": {"page_id": "identifier", "page_index": "count", "checksum": "checksum", "source_kind": SOURCE_KINDS, "tags": ["identifier"]} | _PIXELS,
    "manifest_document": {"document_id": "identifier", "split": SPLITS, "category": "identifier", "checksum": "checksum", "source": "source", "pages": ["manifest_page", 1]},
    "truth_document": {"document_id": "identifier", "pages": ["page", 1], "extractions~": ["extraction"]},
    "validation": {"rule": "identifier", "status": VALIDATION_STATUSES, "message": "text", "confidence": "share"},
    "field": {"field_id": "identifier", "field_name": "name", "value": "string", "normalized_value": "string", "value_type": VALUE_TYPES, "confidence": "confidence", "page_id?": "identifier", "bbox?": "bbox", "provenance": "provenance", "warnings": ["warning"]},
    "extraction": {"document_id": "identifier", "schema_name": "identifier", "schema_version": "version", "fields": ["field"], "validations": ["validation"]},
    "sample": _KEY | {"status": STATUSES, "page!": "page", "error!": "error", "runtime_ms?": "amount", "peak_memory_mb?": "amount"},
    "system": {
        "name": "text", "version": "text", "adapter_name": "text", "adapter_version": "text", "model_name?": "string", "model_version?": "string", "execution_provider": "text",
        "command?": "string", "git_commit?": "string", "runtime": "open", "hardware": "open",
    },
    "run": {"run_id": "identifier", "started_at?": "moment", "finished_at?": "moment", "duration_ms?": "amount", "command?": "string", "dependency_lock_hash?": "string"},
    "asset": _KEY | {"media_type": MEDIA_TYPES, "relative_path": "path", "checksum": "checksum"} | _PIXELS,
    "summary": {"total_pages": "count", "scored_pages": "count"} | {f"{x}_pages": "count" for x in FAILURES},
    "metric": {"micro": "amount", "macro": "amount", "sample_count": "count", "unit": UNITS, "higher_is_better": "boolean"},
    "failure": _KEY | {"status": FAILURES, "message": "text"},
    "category": {"category": "identifier", "summary": "summary", "metrics": {"*": "metric"}},
    "manifest": _TOPS | {"documents": ["manifest_document"], "reference_sources": ["reference"], "notes": ["string"]},
    "ground-truth": _TOPS | {"annotation_provenance": "provenance", "documents": ["truth_document"]},
    "prediction": _TOPS | _MAKER | {"samples": ["sample"], "document_extractions~": ["extraction"]},
    "assets": _TOP | {"assets": ["asset"]},
    "report": _TOPS | _MAKER | {"generated_at": "moment", "summary": "summary", "metrics": {"*": "metric"}, "category_breakdown": ["category"], "failures": ["failure"], "notes": ["string"]},
}


def schema_of(kind: str) -> T.StructType:
    if kind == "common":
        return T.StructType.fromDDL(f"page {PAGE}, extraction {EXTRACTION}, sample {SAMPLE}, system {SYSTEM}, run {RUN}")
    if kind not in ARTIFACTS:
        raise ValueError(f"unknown contract kind: {kind}")
    return T.StructType.fromDDL(ARTIFACTS[kind])


@dataclass(frozen=True)
class MetricSpec:
    name: str
    unit: str
    higher_is_better: bool
    optional: bool = False


#: The report's metrics in their order; optional ones appear only if measured.
METRICS = (
    MetricSpec("cer", "page", False),
    MetricSpec("wer", "page", False),
    MetricSpec("normalized_edit_similarity", "page", True),
    MetricSpec("digit_exact_accuracy", "digit_page", True),
    MetricSpec("reading_order_sequence_score", "page", True),
    MetricSpec("block_type_accuracy", "block", True),
    MetricSpec("layout_bbox_iou", "block", True),
    MetricSpec("layout_match_f1", "block", True),
    MetricSpec("equation_text_similarity", "equation", True),
    MetricSpec("table_structure_similarity", "table", True),
    MetricSpec("diagram_detection_f1", "diagram", True),
    MetricSpec("hallucinated_block_rate", "block", False),
    MetricSpec("confidence_brier", "confidence_block", False),
    MetricSpec("confidence_ece", "confidence_block", False),
    MetricSpec("error_detection_auroc", "confidence_block", True),
    MetricSpec("structured_field_precision", "field", True),
    MetricSpec("structured_field_recall", "field", True),
    MetricSpec("structured_field_f1", "field", True),
    MetricSpec("structured_field_exact_accuracy", "field", True),
    MetricSpec("financial_value_accuracy", "financial_value", True),
    MetricSpec("structured_field_coordinate_iou", "field", True),
    MetricSpec("structured_hallucination_rate", "field", False),
    MetricSpec("runtime_ms", "milliseconds", False, optional=True),
    MetricSpec("peak_memory_mb", "megabytes", False, optional=True),
)
