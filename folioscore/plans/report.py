"""A report from the three small tables of a scoring run: as an object, as JSON and as Markdown.

What reaches the driver is bounded by metrics x categories. Failures, which are not bounded, stream into a report's file a
partition at a time; ``score_tables`` goes from page tables to report tables, and collects none.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources import contracts as C
from ..sources import streamed
from ..sources.schemas import METRICS, SCHEMA_VERSION
from .scoring import COUNTERS, EXTRACTION_KEYS, KEYS, Scored

NOTES = [
    "Pages that are missing, crashed, timed out, invalid or without ground truth are counted, but add nothing to quality metrics.",
    "digit_exact_accuracy covers pages whose reference has a digit.",
    "runtime_ms and peak_memory_mb cover the samples that were measured.",
]


def _counts(row: Any) -> dict[str, int]:
    return {"total_pages": row.total_pages} | {f"{c}_pages": row[f"{c}_pages"] for c in COUNTERS}


def build_report(scored: Scored, head: dict, with_failures: bool = True) -> dict:
    """The report object; head: dataset_revision, coordinate_system, system, run."""
    order = {m.name: i for i, m in enumerate(METRICS)}
    metrics: dict = {}
    for r in scored.metrics.collect():
        metrics.setdefault((r.is_total, r.category), {})[r.metric] = {"micro": r.micro, "macro": r.macro, "sample_count": r.sample_count, "unit": r.unit, "higher_is_better": r.higher_is_better}
    metrics = {k: dict(sorted(v.items(), key=lambda x: order[x[0]])) for k, v in metrics.items()}
    counts = {(r.is_total, r.category): _counts(r) for r in scored.summary.collect()}
    total = counts.pop((1, None), {"total_pages": 0} | {f"{c}_pages": 0 for c in COUNTERS})
    empty = {m.name: {"micro": 0.0, "macro": 0.0, "sample_count": 0, "unit": m.unit, "higher_is_better": m.higher_is_better} for m in METRICS if not m.optional}
    return {
        "schema_version": SCHEMA_VERSION,
        **head,
        "generated_at": datetime.now(UTC).isoformat(),
        "summary": total,
        "metrics": metrics.get((1, None), empty),
        "category_breakdown": [{"category": c, "summary": n, "metrics": metrics.get((t, c), empty)} for (t, c), n in sorted(counts.items(), key=lambda x: x[0][1] or "")],
        "failures": [r.asDict() for r in scored.failures.toLocalIterator()] if with_failures else [],
        "notes": NOTES,
    }


def score_artifacts(manifest: DataFrame, truth: DataFrame, predictions: DataFrame, check: bool = True) -> Scored:
    """Score typed artifacts (see contracts.read_artifact)."""
    if check:
        C.require(C.bundle_violations(manifest, truth, predictions))
    return Scored(C.manifest_pages(manifest), C.truth_pages(truth), C.samples(predictions), C.truth_extractions(truth), C.extractions(predictions), store=True)


def score_files(spark: SparkSession, manifest: str, truth: str, predictions: str, output: str | None = None) -> dict:
    m, t, p = (C.read_artifact(spark, kind, str(path)) for kind, path in (("manifest", manifest), ("ground-truth", truth), ("prediction", predictions)))
    scored = score_artifacts(m, t, p)
    # the heads, as JSON, keep the open maps as they were given
    head = json.loads(m.selectExpr("to_json(struct(dataset_revision, coordinate_system))").first()[0]) | json.loads(p.selectExpr("to_json(struct(system, run))").first()[0])
    report = build_report(scored, head)
    scored.close()
    if output:
        write_json(report, output)
    return report


#: The page tables of a scoring run: Parquet, in as many files as there are pages for. The last two may be absent.
PAGE_TABLES = ("manifest", "truth", "samples", "truth_extractions", "extractions")


def save_tables(manifest: DataFrame, truth: DataFrame, predictions: DataFrame, folder: str) -> None:
    """Artifacts, of which there may be many, as page tables for score_tables."""
    rows = (C.manifest_pages(manifest), C.truth_pages(truth), C.samples(predictions), C.truth_extractions(truth), C.extractions(predictions))
    for name, table in zip(PAGE_TABLES, rows, strict=True):
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def stream_tables(spark: SparkSession, manifest: str, truth: str, predictions: str, folder: str) -> None:
    """Artifacts at paths, files of any size, as page tables for score_tables: an element at a time (see sources.streamed)."""
    m, t, p = (streamed.Artifact(spark, kind, path) for kind, path in (("manifest", manifest), ("ground-truth", truth), ("prediction", predictions)))
    rows = (streamed.manifest_pages(m), streamed.truth_pages(t), streamed.samples(p), streamed.truth_extractions(t), streamed.extractions(p))
    for name, table in zip(PAGE_TABLES, rows, strict=True):
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    for artifact in (m, t, p):
        artifact.close()


def bucket_tables(spark: SparkSession, folder: str, prefix: str, buckets: int) -> None:
    """Page tables of a folder as catalog tables ``prefix_NAME``, bucketed and sorted by page (extractions by their key), in ``folder/bucketed``.

    Many runs are scored against one truth: classification then joins bucket by bucket, without a shuffle. The number of buckets
    must be the same for all tables that are joined.
    """
    for name in PAGE_TABLES:
        keys = EXTRACTION_KEYS if "extractions" in name else KEYS
        table = spark.read.parquet(f"{folder}/{name}")
        table.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{folder}/bucketed/{name}").saveAsTable(f"{prefix}_{name}")


def score_bucketed(spark: SparkSession, prefix: str, output: str, head: dict, extractions: bool = True) -> dict:
    """score_tables over the tables of bucket_tables."""
    return _score(spark, {name: spark.table(f"{prefix}_{name}") for name in PAGE_TABLES}, output, head, extractions)


def score_tables(spark: SparkSession, folder: str, output: str, head: dict, extractions: bool = True) -> dict:
    """Page tables to report tables in ``output``, all distributed; the returned report has no failures."""
    return _score(spark, {name: spark.read.parquet(f"{folder}/{name}") for name in (PAGE_TABLES if extractions else PAGE_TABLES[:3])}, output, head, extractions)


def _score(spark: SparkSession, tables: dict[str, DataFrame], output: str, head: dict, extractions: bool) -> dict:
    scored = Scored(*(tables[name] for name in (PAGE_TABLES if extractions else PAGE_TABLES[:3])), store=True)
    write_tables(scored, output)
    report = build_report(scored, head, with_failures=False)
    scored.close()
    return report


def write_report(report: dict, failures: DataFrame, path: str | Path) -> Path:
    """write_json of a report whose failures stream from their table, a partition at a time."""
    before, after = json.dumps(report | {"failures": []}, ensure_ascii=False, indent=2, sort_keys=True).split('"failures": []', 1)
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8", newline="\n") as out:
        out.write(before + '"failures": [')
        end = "]"
        for i, row in enumerate(failures.toLocalIterator()):
            item = json.dumps(row.asDict(), ensure_ascii=False, indent=2, sort_keys=True).replace("\n", "\n    ")
            out.write((",\n    " if i else "\n    ") + item)
            end = "\n  ]"
        out.write(end + after + "\n")
    return target


def write_json(value: dict, path: str | Path) -> Path:
    """UTF-8, sorted keys, two spaces, a final line end; folders are made."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8", newline="\n")
    return target


def write_tables(scored: Scored, folder: str) -> None:
    """The long table and the report's tables as Parquet, by category where there are many rows."""
    scored.observations.write.mode("overwrite").partitionBy("category").parquet(f"{folder}/observations")
    for name in ("summary", "metrics", "failures"):
        getattr(scored, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def _table(metrics: dict) -> list[str]:
    rows = [f"| `{name}` | {m['micro']:.4f} | {m['macro']:.4f} | {m['sample_count']} |" for name, m in metrics.items()]
    return ["| Metric | Micro | Macro | Samples |", "| --- | ---: | ---: | ---: |", *rows]


#: Fixed values, the output's format: what the head says, and the line of a category and of a failure.
HEAD_LINES = (
    ("Dataset", "`{dataset_revision[dataset_id]}@{dataset_revision[revision]}`"),
    ("System", "`{system[name]}@{system[version]}`"),
    ("Total pages", "**{summary[total_pages]}**"),
    ("Scored pages", "**{summary[scored_pages]}**"),
    ("Missing/crashed/timeout", "**{summary[missing_pages]}/{summary[crashed_pages]}/{summary[timeout_pages]}**"),
)
CATEGORY_LINE = "Pages: {scored_pages}/{total_pages} scored; missing {missing_pages}, crashed {crashed_pages}, timeout {timeout_pages}."
FAILURE_LINE = "- `{status}` `{document_id}/{page_id}`: {message}"


def render_markdown(report: dict) -> str:
    """A compact view of a report, numbers with four decimals."""
    categories = [line for c in report["category_breakdown"] for line in (f"### `{c['category']}`", "", CATEGORY_LINE.format(**c["summary"]), "", *_table(c["metrics"]), "")]
    sections = {
        "# Scoring report": [*(f"- {label}: {value.format(**report)}" for label, value in HEAD_LINES), ""],
        "## Metrics": [*_table(report["metrics"]), ""],
        "## Category breakdown": categories,
        "## Failures": [FAILURE_LINE.format(**f) for f in report["failures"]] or ["None."],
    }
    return "\n".join(line for title, lines in sections.items() for line in (title, "", *lines)) + "\n"


def write_markdown(report: dict, path: str | Path) -> Path:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(render_markdown(report), encoding="utf-8", newline="\n")
    return target
