"""Run a system as a black box on many machines: a shard of a manifest's pages at a time, a process each, on the executors.

A shard has about ``pages_per_shard`` pages, dealt by a hash of (document, page), so the pages of a long document spread.
Each gets a folder with its own ``manifest.json`` in the task's scratch space, which is gone when the process has ended: nothing in it is
read by another task, and a task that is lost runs its shards again. What the systems leave is a table of samples in the
shared folder; a shard without a usable file gives a failure for each of its pages, as runner.run_system does.

A page without a sample in a usable file stays without one (scoring counts it as missing); samples of pages that aren't the shard's make
the file invalid. An empty manifest gives no samples. Pages that are listed twice are given to the system once.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import tempfile
import time
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written
from . import runner, shapes
from . import schemas as S

#: One shard's outcome for a page: its sample as JSON (null: the file has none), how the shard ended, attempts and milliseconds.
_RESULT = "document_id string, page_id string, shard long, sample string, status string, attempts int, duration_ms double"


def _listed(manifest: DataFrame, shards: int) -> DataFrame:
    """shard, document_id, page_id, and the JSON of the head, the document without pages, and the page."""
    options = {"ignoreNullFields": "false"}
    head = F.to_json(F.struct("schema_version", "dataset_revision", "coordinate_system"), options)
    d, p = F.col("d"), F.col("p")
    docs = manifest.select(head.alias("head"), F.posexplode("documents").alias("doc_pos", "d"))
    pages = docs.select("head", "doc_pos", F.to_json(d.dropFields("pages"), options).alias("document"), d.document_id.alias("document_id"), F.posexplode(d.pages).alias("page_pos", "p"))
    rows = pages.select("head", "document", "doc_pos", "page_pos", "document_id", p.page_id.alias("page_id"), F.to_json(p, options).alias("page"))
    keys = ["document_id", "page_id"]
    one = rows.groupBy(*keys).agg(F.min_by(F.struct("doc_pos", "page_pos", "head", "document", "page"), F.struct("doc_pos", "page_pos")).alias("r")).select(*keys, "r.*")
    return one.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)))


def _manifest(rows: list[dict]) -> dict:
    """The manifest of a shard's rows, in the order of the whole one."""
    documents: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc_pos"], r["page_pos"])):
        documents.setdefault(r["document_id"], json.loads(r["document"]) | {"pages": []})["pages"].append(json.loads(r["page"]))
    return json.loads(rows[0]["head"]) | {"documents": list(documents.values()), "reference_sources": [], "notes": []}


def _left(path: Path, known: set[tuple[str, str]], limit: int) -> dict[tuple[str, str], str] | None:
    """The samples of a predictions file by page, or None if it is none that counts."""
    if not path.is_file() or path.stat().st_size > limit:
        return None
    try:
        value = json.loads(path.read_text(encoding="utf-8"))
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict) or next(shapes.faults(value, "prediction"), None):
        return None
    samples = {(s["document_id"], s["page_id"]): json.dumps(s) for s in value["samples"]}
    return samples if len(samples) == len(value["samples"]) and samples.keys() <= known else None


def _tried(rows: list[dict], command: list[str], limits: runner.Limits, attempts: int) -> tuple[dict[tuple[str, str], str], str, int, float]:
    """(samples by page, how it ended, attempts made, milliseconds of the last one)."""
    known = {(r["document_id"], r["page_id"]) for r in rows}
    for k in range(1, attempts + 1):
        with tempfile.TemporaryDirectory() as folder:
            target = Path(folder, "predictions.json")
            Path(folder, "manifest.json").write_text(json.dumps(_manifest(rows), ensure_ascii=False), encoding="utf-8")
            places = {"{bundle}": folder, "{predictions}": str(target)}
            argv = [functools.reduce(lambda a, x: a.replace(*x), places.items(), a) for a in command]
            clock = time.perf_counter()
            _, status = runner._started(argv, Path(folder), os.environ | {"BUNDLE_DIR": folder, "PREDICTIONS_PATH": str(target)}, limits.timeout_seconds)
            took = 1000 * (time.perf_counter() - clock)
            samples = _left(target, known, limits.max_prediction_bytes) if status == "success" else None
            if samples is not None:
                return samples, "success", k, took
            status = "invalid" if status == "success" else status
    return {}, status, attempts, took


def _run(batches: Iterable[pa.RecordBatch], command: list[str], limits: runner.Limits, attempts: int) -> Iterator[pa.RecordBatch]:
    rows = (r for batch in batches for r in batch.to_pylist())
    for shard, own in itertools.groupby(rows, key=lambda r: r["shard"]):  # sorted by shard: one shard is held at a time
        own = list(own)
        samples, status, made, took = _tried(own, command, limits, attempts)
        keys = [(r["document_id"], r["page_id"]) for r in own]
        yield pa.RecordBatch.from_pydict({
            "document_id": pa.array([d for d, _ in keys], pa.string()), "page_id": pa.array([p for _, p in keys], pa.string()), "shard": pa.array([shard] * len(own), pa.int64()),
            "sample": pa.array([samples.get(k) for k in keys], pa.string()), "status": pa.array([status] * len(own), pa.string()),
            "attempts": pa.array([made] * len(own), pa.int32()), "duration_ms": pa.array([took] * len(own), pa.float64()),
        })


def run_shards(manifest: DataFrame, command: list[str], pages_per_shard: int = 500, limits: runner.Limits | None = None, attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """(samples for scoring, a row for each shard: shard, pages, status, attempts, duration_ms) of a typed manifest.

    command: argv with ``{bundle}`` and ``{predictions}``; it must exist on every executor.
    """
    if not command or not all(command):
        raise ValueError("the command is empty or has an empty argument")
    if pages_per_shard < 1 or attempts < 1:
        raise ValueError("pages_per_shard and attempts must be positive")
    spark, limits = manifest.sparkSession, limits or runner.Limits()
    ship_package(spark)
    pages = manifest.select(F.explode("documents").alias("d")).agg(F.sum(F.size("d.pages"))).first()[0] or 0
    shards = max(1, -(-pages // pages_per_shard))
    dealt = _listed(manifest, shards).repartition(shards, "shard").sortWithinPartitions("shard")
    # written at once: each shard is run for one table, not again for each use
    results, _ = written(dealt.mapInArrow(functools.partial(_run, command=list(command), limits=limits, attempts=attempts), _RESULT), "shards")
    error = F.struct(F.concat(F.lit("runner_"), "status").alias("code"), F.concat(F.lit("the system's shard ended as "), "status").alias("message"), F.lit(None).cast("string").alias("stage"), (F.col("status") == "timeout").alias("retryable"))
    failed = F.struct(
        F.col("document_id").alias("document_id"), F.col("page_id").alias("page_id"), F.when(F.col("status") == "timeout", "timeout").otherwise("crashed").alias("status"), F.lit(None).cast(S.PAGE).alias("page"), error.alias("error"),
        F.lit(None).cast("double").alias("runtime_ms"), F.lit(None).cast("double").alias("peak_memory_mb"),
    )
    sample = F.when(F.col("status") == "success", F.from_json("sample", S.SAMPLE)).otherwise(failed.cast(S.SAMPLE))
    samples = results.where("status <> 'success' OR sample IS NOT NULL").select("document_id", "page_id", sample.alias("sample"))
    runs = results.groupBy("shard").agg(F.count(F.lit(1)).alias("pages"), F.first("status").alias("status"), F.first("attempts").alias("attempts"), F.first("duration_ms").alias("duration_ms"))
    return samples, runs
