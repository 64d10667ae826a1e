"""Reports end to end: identity, failures, damage, determinism, contracts, runner, HTTP, command line, streaming."""

import hashlib
import io
import json
import re
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscore import api, cli
from folioscore.plans import report as R
from folioscore.plans import scoring as sc
from folioscore.sources import adapters, generate, raster, runner
from folioscore.sources import contracts as C
from folioscore.sources import schemas as S

HEAD = {"dataset_revision": {"dataset_id": "d", "revision": "1"}, "coordinate_system": dict(S.COORDINATES), "system": {"name": "s", "version": "1"}, "run": {"run_id": "r"}}


def report_of(corpus, samples, extractions=None):
    both = (corpus.extractions, extractions if extractions is not None else corpus.extractions) if corpus.extractions is not None else (None, None)
    return R.build_report(sc.Scored(corpus.manifest, corpus.truth, samples, *both), HEAD)


@pytest.fixture(scope="module")
def scenarios(spark):
    corpus = generate.scenario_corpus(spark)
    return generate.Corpus(corpus.manifest.cache(), corpus.truth.cache())


def test_identity_is_perfect(scenarios):
    report = report_of(scenarios, adapters.fake_predictions(scenarios.manifest, scenarios.truth))
    assert report["summary"]["scored_pages"] == 8 and report["failures"] == []
    for spec in S.METRICS[:15]:
        m = report["metrics"][spec.name]
        if spec.name.startswith(("structured", "financial")) or not m["sample_count"]:
            continue
        assert m["micro"] == pytest.approx(1.0 if spec.higher_is_better else 0.0), spec.name
    assert [c["category"] for c in report["category_breakdown"]] == sorted({c for c, _, _ in generate.SCENARIOS})
    assert list(report["metrics"]) == [m.name for m in S.METRICS if not m.optional]


def test_damaged_page(spark, scenarios):
    samples = adapters.fake_predictions(scenarios.manifest, scenarios.truth)

    def damage(b):
        kind = F.when(b.block_type == "title", "caption").otherwise(b.block_type)
        table = F.when(b.table.isNotNull(), b.table.withField("rows", b.table.rows + 1))
        return b.withField("block_type", kind).withField("equation_text", F.concat(b.equation_text, F.lit("!"))).withField("table", table)

    page = F.col("sample.page")
    damaged = samples.withColumn("sample", F.col("sample").withField("page", page.withField("blocks", F.transform(page.blocks, damage))).withField("runtime_ms", F.lit(12.5)).withField("peak_memory_mb", F.lit(42.0)))
    m = report_of(scenarios, damaged)["metrics"]
    assert m["block_type_accuracy"]["micro"] < 1 and 0 < m["equation_text_similarity"]["micro"] < 1 and m["table_structure_similarity"]["micro"] == pytest.approx(0.5)
    assert (m["runtime_ms"]["micro"], m["peak_memory_mb"]["macro"]) == (12.5, 42.0)


def test_failures_count_but_do_not_lower_quality(spark):
    corpus = generate.text_corpus(spark, 5, 1)
    samples = adapters.fake_predictions(corpus.manifest, corpus.truth, 2)  # pages 2 and 4 crash
    samples = samples.where("document_id <> 'doc-000003'")
    bad = F.col("sample").withField("page", F.col("sample.page").withField("page_index", F.lit(9)))
    samples = samples.withColumn("sample", F.when(F.col("document_id") == "doc-000005", bad).otherwise(F.col("sample")))
    report = report_of(corpus, samples)
    assert report["summary"] == {"total_pages": 5, "scored_pages": 1, "missing_pages": 1, "crashed_pages": 2, "timeout_pages": 0, "invalid_pages": 1, "ground_truth_missing_pages": 0}
    assert [f["status"] for f in report["failures"]] == ["crashed", "missing", "crashed", "invalid"]
    assert report["metrics"]["cer"]["sample_count"] == 1 and report["metrics"]["cer"]["micro"] == 0
    without = report_of(generate.Corpus(corpus.manifest, corpus.truth.where("document_id <> 'doc-000002'")), samples)
    assert without["failures"][0]["status"] == "ground_truth_missing"


def test_checksums_are_compared_whole(spark):
    corpus = generate.text_corpus(spark, 1, 1)
    samples = adapters.fake_predictions(corpus.manifest, corpus.truth)
    page = F.col("sample.page")
    sized = samples.withColumn("sample", F.col("sample").withField("page", page.withField("checksum", page.checksum.withField("size_bytes", F.lit(1).cast("bigint")))))
    assert report_of(corpus, sized)["summary"]["invalid_pages"] == 1


def test_invoices(spark):
    corpus = generate.invoice_corpus(spark)
    changed = corpus.extractions.withColumn("fields", F.transform("fields", lambda f: f.withField("normalized_value", F.when(f.field_name == "total_ttc", "0").otherwise(f.normalized_value))))
    m = report_of(corpus, adapters.fake_predictions(corpus.manifest, corpus.truth), changed)["metrics"]
    assert m["structured_field_recall"]["micro"] == pytest.approx(19 / 20) and m["structured_field_coordinate_iou"]["micro"] == 1
    assert m["financial_value_accuracy"]["micro"] == pytest.approx(8 / 9) and m["structured_field_f1"]["sample_count"] == 80


def test_partitioning_and_order_do_not_matter(spark, scenarios):
    samples = adapters.fake_predictions(scenarios.manifest, scenarios.truth, 3)
    one = report_of(scenarios, samples.repartition(1))
    many = report_of(generate.Corpus(scenarios.manifest.repartition(5), scenarios.truth.orderBy(F.desc("page_id"))), samples.repartition(7))
    assert {k: v for k, v in one.items() if k != "generated_at"} == {k: v for k, v in many.items() if k != "generated_at"}


def test_numbering_matches_a_global_order(spark):
    rows = [(d, p) for d in (5, 0, 9, 2) for p in range(d % 3 + 1)]
    pages = spark.createDataFrame(rows, "doc_pos int, page_pos int")
    got = {(r.doc_pos, r.page_pos): r.rn for r in adapters.numbered(pages).collect()}
    assert got == {k: i for i, k in enumerate(sorted(rows), 1)}
    assert adapters.numbered(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        adapters.fake_predictions(pages, pages, -1)


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bundle")
    cli.session = lambda: spark
    assert cli.main(["smoke", "--output-dir", str(folder), "--fail-every", "2"]) == 0
    return folder


def changed(bundle, name, change):
    value = json.loads((bundle / name).read_text(encoding="utf-8"))
    change(value)
    target = bundle / f"changed-{name}"
    target.write_text(json.dumps(value), encoding="utf-8")
    return str(target)


def test_command_line_round_trip(bundle):
    report = json.loads((bundle / "report.json").read_text(encoding="utf-8"))
    assert report["summary"]["crashed_pages"] == 2 and "## Failures" in (bundle / "report.md").read_text(encoding="utf-8")
    for name, kind in (("manifest", "manifest"), ("ground-truth", "ground-truth"), ("predictions", "prediction"), ("report", "report")):
        assert cli.main(["validate", str(bundle / f"{name}.json"), "--kind", kind]) == 0
    assert cli.main(["schema", "manifest"]) == 0


@pytest.mark.parametrize(
    ("name", "kind", "change", "rule"),
    [
        ("manifest.json", "manifest", lambda v: v["documents"][0].update(bogus=1), "closed"),
        ("manifest.json", "manifest", lambda v: v["documents"][0]["checksum"].update(value="zz"), "checksum"),
        ("manifest.json", "manifest", lambda v: v["documents"].append(v["documents"][0]), "V3|V4"),
        ("ground-truth.json", "ground-truth", lambda v: v["documents"][0]["pages"][0]["reading_order"].append("nobody"), "V2"),
        ("predictions.json", "prediction", lambda v: v["samples"][0].update(status="crashed"), "V8"),
        ("predictions.json", "prediction", lambda v: v["samples"].append(v["samples"][0]), "V9"),
        ("predictions.json", "prediction", lambda v: v.pop("samples"), r"required: \$.samples"),
        ("predictions.json", "prediction", lambda v: (v.pop("system"), v.pop("run")), r"required: \$.(run|system)"),
        ("predictions.json", "prediction", lambda v: v["system"].update(name=None), r"type: \$.system.name"),
        ("predictions.json", "prediction", lambda v: next(x for x in v["samples"] if x["error"])["error"].pop("code"), r"required: \$.samples\[2\].error.code"),
        ("predictions.json", "prediction", lambda v: v["samples"][0].update(runtime_ms="fast"), r"type: \$.samples\[0\].runtime_ms"),
        ("predictions.json", "prediction", lambda v: v["samples"][0].update(split="dev"), r"closed: \$.samples\[0\].split"),
        ("predictions.json", "prediction", lambda v: v["samples"][0].update(document_id="../../x"), r"value: \$.samples\[0\].document_id"),
        ("predictions.json", "prediction", lambda v: v["samples"][0].pop("error"), r"required: \$.samples\[0\].error"),
        ("predictions.json", "prediction", lambda v: v["run"].update(started_at="yesterday"), r"value: \$.run.started_at"),
        ("predictions.json", "prediction", lambda v: v["samples"][0]["page"]["blocks"][0]["lines"][0].update(language="xx"), r"value: .*lines\[0\].language"),
        ("predictions.json", "prediction", lambda v: v["samples"][0]["page"]["blocks"][0]["lines"][0].update(spans=[]), r"value: .*spans"),
        ("ground-truth.json", "ground-truth", lambda v: v["annotation_provenance"]["details"].update(a=[1]), r"value: \$.annotation_provenance.details"),
        ("ground-truth.json", "ground-truth", lambda v: v["documents"][0]["pages"][0].update(width=True), r"type: .*width"),
        ("ground-truth.json", "ground-truth", lambda v: v["documents"][0].update(pages=[]), r"value: .*pages"),
        ("manifest.json", "manifest", lambda v: v.update(notes="none"), r"type: \$.notes"),
        ("report.json", "report", lambda v: v["metrics"]["cer"].update(unit="pages"), r"value: \$.metrics.cer.unit"),
        ("report.json", "report", lambda v: v["failures"][0].update(status="lost"), r"value: \$.failures\[0\].status"),
    ],
)
def test_broken_contracts(spark, bundle, name, kind, change, rule):
    with pytest.raises(C.ContractError, match=rule):
        C.read_artifact(spark, kind, changed(bundle, name, change))


def test_shapes_and_typed_schemas_have_the_same_names(spark):
    def compare(shape, kind, place):
        shape = S.SHAPES[shape] if isinstance(shape, str) and shape in S.SHAPES else shape
        if isinstance(shape, list):
            compare(shape[0], kind.elementType, place)
        elif isinstance(shape, dict) and "*" in shape:
            compare(shape["*"], kind.valueType, place)
        elif isinstance(shape, dict):
            assert {n.rstrip("?~!") for n in shape} == set(kind.names), place
            for n, inner in shape.items():
                compare(inner, kind[n.rstrip("?~!")].dataType, f"{place}.{n}")

    for kind in S.ARTIFACTS:
        compare(kind, S.schema_of(kind), kind)


def test_bundle_rules(spark, bundle):
    m, t = (C.read_artifact(spark, k, str(bundle / f"{k}.json")) for k in ("manifest", "ground-truth"))
    p = C.read_artifact(spark, "prediction", changed(bundle, "predictions.json", lambda v: (v["dataset_revision"].update(revision="9"), v["samples"][0].update(page_id="other"))), strict=False)
    assert {r.rule for r in C.bundle_violations(m, t, p).collect()} == {"V10", "V11"}


def test_page_tables_give_the_same_report(spark, bundle, tmp_path):
    m, t, p = (C.read_artifact(spark, k, str(bundle / f"{f}.json")) for k, f in (("manifest", "manifest"), ("ground-truth", "ground-truth"), ("prediction", "predictions")))
    R.save_tables(m, t, p, str(tmp_path / "in"))
    report = json.loads((bundle / "report.json").read_text(encoding="utf-8"))
    got = R.score_tables(spark, str(tmp_path / "in"), str(tmp_path / "out"), {k: report[k] for k in HEAD})
    same = lambda r: {k: v for k, v in r.items() if k not in ("generated_at", "failures")}
    assert same(got) == same(report) and got["failures"] == []
    listed = spark.read.parquet(str(tmp_path / "out/failures")).orderBy("document_id")
    full = got | {"failures": [r.asDict() for r in listed.collect()]}
    assert len(full["failures"]) == 2
    streamed, whole = R.write_report(got, listed, tmp_path / "a.json"), R.write_json(full, tmp_path / "b.json")
    assert streamed.read_text(encoding="utf-8") == whole.read_text(encoding="utf-8")
    assert R.write_report(got, listed.limit(0), tmp_path / "a.json").read_text() == R.write_json(got, tmp_path / "b.json").read_text()


def test_json_arrays_are_rejected(spark, tmp_path):
    (tmp_path / "a.json").write_text("[1]")
    with pytest.raises(C.ContractError, match="object"):
        C.read_artifact(spark, "manifest", str(tmp_path / "a.json"))


@pytest.mark.parametrize(("path", "good"), [("images/a.png", True), ("/a", False), ("a/../b", False), ("..", False), ("a\\b", False), ("", False), ("a..b/c", True)])
def test_asset_paths(spark, path, good):
    assert spark.range(1).select(C.safe_path(F.lit(path))).first()[0] is good


def test_assets_update_the_corpus(spark, tmp_path):
    corpus = generate.text_corpus(spark, 1, 1)
    (tmp_path / "p.png").write_bytes(b"not really a picture")
    sums = generate.image_checksums(spark, str(tmp_path))
    assets = corpus.manifest.select("document_id", "page_id").join(sums.select("checksum", F.lit(10).alias("width"), F.lit(20).alias("height")))
    new = generate.with_assets(corpus, assets)
    row, page = new.manifest.first(), new.truth.first().truth
    assert row.source_kind == "image" and "image" in row.tags and row.checksum == page.checksum and page.height == 20 and row.checksum.size_bytes == 20


def test_image_bundles(spark, tmp_path):
    cli.session = lambda: spark
    assert cli.main(["scenario-images", "--output-dir", str(tmp_path / "a")]) == 0
    made = {k: C.read_artifact(spark, k, str(tmp_path / f"a/{k}.json")) for k in ("manifest", "ground-truth", "assets")}
    records = json.loads((tmp_path / "a/records.json").read_text())
    assert {r["scan_quality"] for r in records} == set(generate.QUALITIES) and len(records) == 8
    for r in records:
        content = (tmp_path / "a" / r["image_path"]).read_bytes()
        assert hashlib.sha256(content).hexdigest() == r["image_sha256"] and len(content) == r["image_size_bytes"]
        assert struct.unpack(">II", content[16:24]) == (1200, 1600)
    pages = C.manifest_pages(made["manifest"]).collect()
    assert all(p.source_kind == "image" and "raster-png" in p.tags for p in pages)
    assert {p.page_id: p.checksum.value for p in pages} == {r["page_id"]: r["image_sha256"] for r in records}
    assert {r.truth.page_id: r.truth.checksum.value for r in C.truth_pages(made["ground-truth"]).collect()} == {r["page_id"]: r["image_sha256"] for r in records}
    again = raster.images(generate.scenario_corpus(spark)).select("page_id", F.sha2("content", 256).alias("s")).collect()
    assert {r.page_id: r.s for r in again} == {r["page_id"]: r["image_sha256"] for r in records}


def test_scan_qualities():
    page = np.full((200, 60), 255, np.float32)
    page[10:190, 10:40] = 25
    seen = {q: raster.degraded(page, q, 1) for q in generate.QUALITIES}
    assert (seen["clean"] == page).all() and all(not np.array_equal(seen[q], page) for q in generate.QUALITIES if q != "clean")
    assert np.array_equal(seen["photographed"], raster.degraded(page, "photographed", 1)) and not np.array_equal(seen["photographed"], raster.degraded(page, "photographed", 2))
    rows = zlib.decompress(raster.png(page)[41:-16])
    assert len(rows) == 200 * 61 and rows[12 * 61 + 1 + 15] == 25 and rows[1] == 255
    with pytest.raises(ValueError):
        raster.degraded(page, "torn", 1)


def test_letters_fit_their_box():
    lines = raster.fitted("one two three four five six seven " * 9, 200, 150, 28, raster.Boxes())
    assert sum(m.shape[0] for m in lines) <= 150 and all(m.shape[1] <= 200 for m in lines) and len(lines) > 3
    assert raster.block_text({"equation_text": "", "lines": [{"raw_text": "a"}, {"raw_text": "b"}]}) == "a\nb" and raster.has_arabic("x ب")
    with pytest.raises((RuntimeError, FileNotFoundError)):
        raster.glyphs("/no/such/font.ttf")


def test_generators_are_deterministic(spark):
    a, b = (generate.artifacts(generate.text_corpus(spark, 2, 2, seed=3), "x") for _ in range(2))
    assert a == b and generate.artifacts(generate.text_corpus(spark, 2, 2, seed=4), "x") != a
    with pytest.raises(ValueError):
        generate.text_corpus(spark, 0)


def test_runner(spark, bundle, tmp_path):
    def run(*code, **limits):
        return runner.run_system(spark, [sys.executable, *code], bundle, tmp_path / "out.json", "sys", "1", runner.Limits(**limits) if limits else None)

    copied = "import shutil, sys; shutil.copy(sys.argv[1] + '/predictions.json', sys.argv[2])"
    assert run("-c", copied, "{bundle}", "{predictions}").status == "success"
    crashed = run("-c", "raise SystemExit(7)")
    assert (crashed.status, crashed.return_code) == ("crashed", 7)
    out = json.loads((tmp_path / "out.json").read_text())
    assert {s["error"]["code"] for s in out["samples"]} == {"runner_crashed"} and not out["samples"][0]["error"]["retryable"]
    assert run("-c", "import sys; open(sys.argv[1], 'w').write('[]')", "{predictions}").status == "invalid"
    assert run("-c", "pass").status == "invalid"  # an earlier run's file does not count
    slow = run("-c", "import time; time.sleep(30)", timeout_seconds=0.5)
    assert slow.status == "timeout" and json.loads((tmp_path / "out.json").read_text())["samples"][0]["status"] == "timeout"
    C.read_artifact(spark, "prediction", str(tmp_path / "out.json"))
    with pytest.raises(ValueError):
        runner.Limits(timeout_seconds=0)
    with pytest.raises(ValueError):
        runner.run_system(spark, ["true", ""], bundle, tmp_path / "x.json", "sys")
    broken = "import json, sys; v = json.load(open(sys.argv[1] + '/predictions.json')); del v['run']; json.dump(v, open(sys.argv[2], 'w'))"
    assert run("-c", broken, "{bundle}", "{predictions}").status == "invalid"
    copy = [sys.executable, "-c", copied, "{bundle}", "{predictions}"]
    both = runner.run_systems(spark, {"one": copy, "two": [sys.executable, "-c", "raise SystemExit(3)"]}, bundle, tmp_path / "many")
    assert {n: r.status for n, r in both.items()} == {"one": "success", "two": "crashed"} and all(r.predictions_path.is_file() for r in both.values())


def test_http(spark, bundle):
    app, said = api.application(spark), []

    def call(method, path, body=b"", kind=""):
        out = b"".join(app({"REQUEST_METHOD": method, "PATH_INFO": path, "CONTENT_LENGTH": str(len(body)), "CONTENT_TYPE": kind, "wsgi.input": io.BytesIO(body)}, lambda status, _: said.append(status)))
        return said[-1][:3], json.loads(out)

    def form(**parts):
        return b"".join(b'--x\r\nContent-Disposition: form-data; name="%s"\r\n\r\n%s\r\n' % (k.encode(), v) for k, v in parts.items()) + b"--x--\r\n"

    files = {"manifest": "manifest", "ground_truth": "ground-truth", "predictions": "predictions"}
    parts = {k: (bundle / f"{f}.json").read_bytes() for k, f in files.items()}
    assert call("GET", "/healthz") == ("200", {"status": "ok"})
    status, report = call("POST", "/v1/score", form(**parts), "multipart/form-data; boundary=x")
    assert status == "200" and report["summary"]["scored_pages"] == 2
    assert call("POST", "/v1/score", form(**(parts | {"predictions": b"[]"})), "multipart/form-data; boundary=x")[0] == "422"
    assert call("POST", "/v1/score", form(manifest=b"{}"), "multipart/form-data; boundary=x")[0] == "422"


def test_streamed_status(spark, tmp_path):
    from folioscore.streaming import incremental as inc

    rows = [("d1", "p1", ("success",), "2026-01-01 00:00:00"), ("d1", "p1", ("success",), "2026-01-01 00:01:00"), ("d1", "p2", ("crashed",), "2026-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "document_id string, page_id string, sample struct<status: string>, arrived string").withColumn("arrived", F.to_timestamp("arrived"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = inc.running_status(inc.first_samples(stream)).writeStream.outputMode("complete").format("memory").queryName("status").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.status: r["count"] for r in spark.table("status").collect()} == {"success": 1, "crashed": 1}


def test_named_fields_are_those_of_the_extractions(spark):
    corpus = generate.invoice_corpus(spark, 2)
    want = corpus.extractions.select("document_id", F.explode("fields").alias("f")).select("document_id", "f.field_name", "f.value", "f.value_type")
    assert corpus.named.columns == want.columns and sorted(corpus.named.collect()) == sorted(want.collect())
    plan = corpus.named._jdf.queryExecution().optimizedPlan().toString()
    assert "provenance" not in plan and "bbox" not in plan


@pytest.mark.parametrize("kind", ["ground-truth", "prediction"])
def test_rules_find_the_same_without_what_they_do_not_read(spark, kind):
    from folioscore.plans import artifact_queries as made

    texts = [r.value for r in made.texts(spark, "/root/testdata/sf0.001", kind, made.RULE_FAULTS[kind]).limit(60).collect()]
    raw = spark.createDataFrame([(x,) for x in texts], "value string")
    found = [C.artifact_violations(raw.select(F.from_json("value", schema).alias("a")).select("a.*"), kind) for schema in (S.schema_of(kind), C.rule_schema(kind))]
    assert sorted(found[0].collect()) == sorted(found[1].collect()) and found[0].count() > 10
    assert len(C.rule_schema(kind).json()) < 0.7 * len(S.schema_of(kind).json())


@pytest.mark.parametrize("kind", ["manifest", "ground-truth", "prediction", "assets", "report"])
def test_rules_are_compiled_and_read_only_their_names(spark, kind):
    from folioscore.plans import artifact_queries as made

    df = made.texts(spark, "/root/testdata/sf0.001", kind, []) if kind in made.RULE_FAULTS else spark.createDataFrame([("r", "{}")], "path string, value string")
    assert kind == "report" or df.rdd.getNumPartitions() > 4  # of a table of one small file
    typed = df.select(F.from_json("value", C.rule_schema(kind)).alias("a")).select("a.*")
    found = C.artifact_violations(typed, kind)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # an array that a Generate or a higher-order function makes of the rules would be interpreted
    assert "explode(found#" in plan and "knownnotcontainsnull" not in plan.lower() and "filter(concat" not in plan
    keys = [x for x in plan.splitlines() if "Aggregate [" in x]
    assert keys and all("message" not in x for x in keys)
    assert not {"source", "search_text", "notes", "calibrated"} & set(re.findall(r'"name":"(\w+)"', C.rule_schema(kind).json()))
    assert kind != "report" or {r.message for r in found.collect()} == {"schema_version", "dataset_revision", "coordinate_system"}  # though there are no metrics
