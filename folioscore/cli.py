"""Command line: python -m folioscore COMMAND."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import report as R
from .sources import adapters, generate, raster, runner
from .sources import contracts as C
from .sources import schemas as S

KINDS = ("manifest", "ground-truth", "prediction", "report", "assets")


def session() -> SparkSession:
    return SparkSession.builder.appName("folioscore").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def predictions_of(corpus: generate.Corpus, head: dict, fail_every: int = 0) -> dict:
    """A predictions contract of the fake system."""
    rows = generate._objects(adapters.fake_predictions(corpus.manifest, corpus.truth, fail_every).select("sample.*"))
    system = {"name": "fake-ground-truth", "version": "1.0.0", "adapter_name": "fake-ground-truth", "adapter_version": "1.0.0", "model_name": None, "model_version": None, "execution_provider": "cpu", "command": None, "git_commit": None, "runtime": {}, "hardware": {}}
    run = {"run_id": "fake-run", "started_at": None, "finished_at": None, "duration_ms": None, "command": None, "dependency_lock_hash": None}
    own = generate._objects(corpus.extractions) if corpus.extractions is not None else []
    return {k: head[k] for k in ("schema_version", "dataset_revision", "coordinate_system")} | {"system": system, "run": run, "samples": [generate._clean(r) for r in rows], "document_extractions": [generate._clean(e) for e in own]}


def write_corpus(corpus: generate.Corpus, folder: Path, dataset_id: str, records: bool = False) -> dict[str, Path]:
    manifest, truth = generate.artifacts(corpus, dataset_id)
    out = {"manifest": R.write_json(manifest, folder / "manifest.json"), "ground-truth": R.write_json(truth, folder / "ground-truth.json")}
    if records:
        for d in truth["documents"]:
            for p in d["pages"]:
                out[f"record {p['page_id']}"] = R.write_json(p, folder / "records" / f"{p['page_id']}.json")
    return out


def _show(paths: dict) -> None:
    for name, path in paths.items():
        print(f"{name}: {path}")


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="folioscore")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        p = sub.add_parser(name)
        for flags, kw in options:
            p.add_argument(*flags, **kw)

    folder = (("--output-dir",), {"type": Path, "required": True})
    command("synthetic", folder, (("--seed",), {"type": int, "default": 17}), (("--documents",), {"type": int, "default": 4}), (("--pages",), {"type": int, "default": 1}), (("--records",), {"action": "store_true"}))
    command("scenarios", folder, (("--seed",), {"type": int, "default": 17}), (("--repeats",), {"type": int, "default": 1}))
    command("invoices", folder, (("--seed",), {"type": int, "default": 23}), (("--repeats",), {"type": int, "default": 1}))
    font = (("--font",), {"default": None, "help": "a font file; without one letters are boxes"})
    command("scenario-images", folder, font, (("--seed",), {"type": int, "default": 17}), (("--repeats",), {"type": int, "default": 1}))
    command("invoice-images", folder, font, (("--seed",), {"type": int, "default": 23}), (("--repeats",), {"type": int, "default": 1}))
    command("smoke", folder, (("--seed",), {"type": int, "default": 17}), (("--fail-every",), {"type": int, "default": 0}))
    command("score", (("--manifest",), {"required": True}), (("--ground-truth",), {"required": True}), (("--predictions",), {"required": True}), (("--output",), {"type": Path, "required": True}))
    command("validate", (("path",), {}), (("--kind",), {"required": True, "choices": KINDS}))
    command("run", (("--bundle",), {"required": True}), (("--output",), {"required": True}), (("--system-name",), {"required": True}), (("--system-version",), {"default": "unknown"}), (("--timeout",), {"type": float, "default": 600}), (("argv",), {"nargs": argparse.REMAINDER}))
    command("schema", (("name",), {"choices": (*KINDS, "common")}))
    a = top.parse_args(argv)
    if a.command == "schema":
        print(C.schema_json(a.name))
        return 0
    spark = session()
    if a.command == "synthetic":
        _show(write_corpus(generate.text_corpus(spark, a.documents, a.pages, a.seed), a.output_dir, "synthetic-text", a.records))
    elif a.command == "scenarios":
        _show(write_corpus(generate.scenario_corpus(spark, a.repeats, a.seed), a.output_dir, "synthetic-scenarios", True))
    elif a.command == "invoices":
        _show(write_corpus(generate.invoice_corpus(spark, a.repeats, a.seed), a.output_dir, "synthetic-invoices"))
    elif a.command == "scenario-images":
        _show(raster.write_bundle(generate.scenario_corpus(spark, a.repeats, a.seed), a.output_dir, "synthetic-scenario-images", "0.1.0", a.font, a.seed))
    elif a.command == "invoice-images":
        _show(raster.write_bundle(generate.invoice_corpus(spark, a.repeats, a.seed), a.output_dir, "synthetic-invoice-images", "0.1.0", a.font, a.seed))
    elif a.command == "smoke":
        corpus = generate.text_corpus(spark, seed=a.seed)
        paths = write_corpus(corpus, a.output_dir, "synthetic-text")
        head = json.loads(paths["manifest"].read_text(encoding="utf-8"))
        paths["predictions"] = R.write_json(predictions_of(corpus, head, a.fail_every), a.output_dir / "predictions.json")
        report = R.score_files(spark, *(str(paths[k]) for k in ("manifest", "ground-truth", "predictions")), str(a.output_dir / "report.json"))
        _show(paths | {"report": a.output_dir / "report.json", "markdown": R.write_markdown(report, a.output_dir / "report.md")})
    elif a.command == "score":
        report = R.score_files(spark, a.manifest, a.ground_truth, a.predictions, str(a.output))
        _show({"report": a.output, "markdown": R.write_markdown(report, a.output.with_suffix(".md"))})
    elif a.command == "validate":
        C.read_artifact(spark, a.kind, a.path)
        print(f"valid {a.kind}: {a.path}")
    elif a.command == "run":
        argv = a.argv[1:] if a.argv[:1] == ["--"] else a.argv
        result = runner.run_system(spark, argv, a.bundle, a.output, a.system_name, a.system_version, runner.Limits(timeout_seconds=a.timeout))
        print(f"status: {result.status}\nduration_ms: {result.duration_ms:.3f}\npredictions: {result.predictions_path}")
        return int(result.status != "success")
    return 0


if __name__ == "__main__":
    sys.exit(main())
