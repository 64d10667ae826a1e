"""What a cluster needs: shards of a black-box run, bucketed page tables, files against their index; corpora of given tables."""

import hashlib
import json
import sys

import pytest
from pyspark.sql import functions as F

from folioscore.plans import artifact_queries
from folioscore.plans import report as R
from folioscore.plans import scoring as sc
from folioscore.plans.queries import SQL
from folioscore.sources import adapters, generate, records, runner, shapes, shards
from folioscore.sources import contracts as C
from folioscore.sources import schemas as S

HEAD = {"dataset_revision": {"dataset_id": "d", "revision": "1"}, "coordinate_system": dict(S.COORDINATES), "system": {"name": "s", "version": "1"}, "run": {"run_id": "r"}}

#: A system that reports every page of its shard as crashed, in a file that keeps the contract; it sleeps where a marked page is.
SYSTEM = """
import json, os, sys, time
m = json.load(open(sys.argv[1] + "/manifest.json"))
keys = [(d["document_id"], p["page_id"]) for d in m["documents"] for p in d["pages"]]
assert len(keys) == len(set(keys))
marked = any(k[1] == sys.argv[3] for k in keys)
if marked and sys.argv[4] == "sleep":
    time.sleep(60)
if marked and sys.argv[4] == "once":
    try:
        os.mkdir(sys.argv[5])
        raise SystemExit(3)
    except FileExistsError:
        pass
if marked and sys.argv[4] == "foreign":
    keys.append(("other", "page"))
samples = [{"document_id": d, "page_id": p, "status": "crashed", "page": None, "error": {"code": "own", "message": "m", "stage": None, "retryable": False}, "runtime_ms": 1.0, "peak_memory_mb": None} for d, p in keys]
system = {"name": "n", "version": "1", "adapter_name": "a", "adapter_version": "1", "model_name": None, "model_version": None, "execution_provider": "cpu", "command": None, "git_commit": None, "runtime": {}, "hardware": {}}
run = {"run_id": "r", "started_at": None, "finished_at": None, "duration_ms": 1.0, "command": None, "dependency_lock_hash": None}
json.dump({k: m[k] for k in ("schema_version", "dataset_revision", "coordinate_system")} | {"system": system, "run": run, "samples": samples, "document_extractions": []}, open(sys.argv[2], "w"))
"""


@pytest.fixture(scope="module")
def manifest(spark, tmp_path_factory):
    value, _ = generate.artifacts(generate.text_corpus(spark, 6, 2), "many")
    path = tmp_path_factory.mktemp("shards") / "manifest.json"
    path.write_text(json.dumps(value))
    return C.read_artifact(spark, "manifest", str(path))


def run(manifest, tmp_path, page, how, **more):
    argv = [sys.executable, "-c", SYSTEM, "{bundle}", "{predictions}", page, how, str(tmp_path / "once")]
    samples, runs = shards.run_shards(manifest, argv, pages_per_shard=3, **more)
    return samples.collect(), {r.shard: r for r in runs.collect()}


def test_a_shard_that_times_out_fails_alone(manifest, tmp_path):
    pages = {(r.document_id, r.page_id) for r in C.manifest_pages(manifest).collect()}
    found, runs = run(manifest, tmp_path, "page-000002-001", "sleep", limits=runner.Limits(timeout_seconds=4), attempts=1)
    assert len(found) == len(pages) == 12 and {(r.document_id, r.page_id) for r in found} == pages
    assert len(runs) > 1 and sorted(r.status for r in runs.values())[-1] == "timeout" and sum(r.status == "timeout" for r in runs.values()) == 1
    late = [r.sample for r in found if r.sample.status == "timeout"]
    assert len(late) == next(r.pages for r in runs.values() if r.status == "timeout") and "page-000002-001" in {s.page_id for s in late}
    assert {(s.error.code, s.error.retryable) for s in late} == {("runner_timeout", True)}
    assert {r.sample.error.code for r in found if r.sample.status != "timeout"} == {"own"}


def test_shards_are_tried_again_and_checked(manifest, tmp_path):
    found, runs = run(manifest, tmp_path, "page-000003-001", "once")
    assert {r.status for r in runs.values()} == {"success"} and sorted(r.attempts for r in runs.values())[-2:] == [1, 2] and {r.sample.error.code for r in found} == {"own"}
    found, runs = run(manifest, tmp_path, "page-000003-001", "foreign")
    assert sum(r.status == "invalid" for r in runs.values()) == 1 and {r.sample.error.code for r in found} == {"own", "runner_invalid"} and len(found) == 12
    found, runs = run(manifest.where("false"), tmp_path, "x", "none")
    assert not found and not runs
    for bad in ({"pages_per_shard": 0}, {"attempts": 0}):
        with pytest.raises(ValueError):
            shards.run_shards(manifest, ["true"], **bad)


def test_bucketed_tables_are_joined_without_a_shuffle(spark, tmp_path):
    corpus = generate.text_corpus(spark, 30, 2)
    sides = {"manifest": corpus.manifest, "truth": corpus.truth, "samples": adapters.fake_predictions(corpus.manifest, corpus.truth, 5)}
    nothing = spark.createDataFrame([], S.EXTRACTION.removeprefix("struct<").removesuffix(">"))
    for name in R.PAGE_TABLES:
        sides.get(name, nothing).write.parquet(str(tmp_path / name))
    R.bucket_tables(spark, str(tmp_path), "many", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = sc.classify(*(spark.read.parquet(str(tmp_path / n)) for n in R.PAGE_TABLES[:3]))
        bucketed = sc.classify(*(spark.table(f"many_{n}") for n in R.PAGE_TABLES[:3]))
        shown = [x._jdf.queryExecution().executedPlan().toString() for x in (plain, bucketed)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" in shown[0] and "Exchange" not in shown[1] and shown[1].count("SortMergeJoin") == 2
    reports = [R.score_tables(spark, str(tmp_path), str(tmp_path / "a"), HEAD), R.score_bucketed(spark, "many", str(tmp_path / "b"), HEAD)]
    assert reports[0]["summary"] == reports[1]["summary"] and reports[0]["metrics"] == reports[1]["metrics"] and reports[0]["summary"]["crashed_pages"] == 12
    for name in R.PAGE_TABLES:
        spark.sql(f"DROP TABLE many_{name}")


def test_files_against_their_index(spark, tmp_path):
    folder = tmp_path / "bundle with space"
    (folder / "images").mkdir(parents=True)
    files = {f"images/{n}.png": n.encode() * 50 for n in ("same", "changed", "grown", "gone", "unsized")}
    index = [{"document_id": "d", "page_id": p[7:-4], "media_type": "image/png", "relative_path": p, "checksum": {"algorithm": "sha256", "value": hashlib.sha256(b).hexdigest().upper(), "size_bytes": None if "unsized" in p else len(b)}, "width": 1, "height": 1} for p, b in files.items()]
    for p, b in files.items():
        (folder / p).write_bytes(b)
    (folder / "images/changed.png").write_bytes(b"x" + files["images/changed.png"][1:])
    (folder / "images/grown.png").write_bytes(files["images/grown.png"] + b"x")
    (folder / "images/gone.png").unlink()
    (folder / "images/surplus.png").write_bytes(b"s")
    (folder / "notes.txt").write_text("no image")
    assets = spark.createDataFrame([(index,)], f"assets array<{S.ASSET}>")
    found = {(r.key, r.message) for r in C.asset_files(spark, assets, str(folder), "*.png").collect()}
    assert {(k.split("/")[1], m.split()[-1] if "another" in m else m.split()[0]) for k, m in found} == {("changed.png", "SHA-256"), ("grown.png", "size"), ("gone.png", "listed,"), ("surplus.png", "a")}


def test_pages_of_given_texts(spark):
    texts = ["# Head\n\n a | b |c\nd|e\nplain\nx = 1\n \t\n|", "", None, "one line", "a|b\n\nc|d\n", "\n\n", "t\n" * 3]
    docs = spark.createDataFrame([(f"d{i}", i, t, "en" if i else None, "clean") for i, t in enumerate(texts)], "document_id string, doc_pos long, text string, category string, quality string")
    corpus = records.text_pages(docs.withColumn("given", F.lit(1)).withColumn("tags", F.lit("x")))
    pages = {r.document_id: r.truth for r in corpus.truth.collect()}
    first = pages["d0"].blocks
    assert [b.block_type for b in first] == ["title", "table", "paragraph", "equation", "table"]
    assert (first[1].table.rows, first[1].table.columns, [c.raw_text for c in first[1].table.cells]) == (2, 3, ["a", "b", "c", "d", "e"])
    assert first[3].equation_text == "x = 1" and first[4].table.columns == 2 and [len(pages[f"d{i}"].blocks) for i in range(7)] == [5, 0, 0, 1, 2, 0, 3]
    manifest, truth = generate.artifacts(corpus, "given")
    assert not list(shapes.faults(json.loads(json.dumps(manifest)), "manifest")) and not list(shapes.faults(json.loads(json.dumps(truth)), "ground-truth"))
    report = R.build_report(sc.Scored(corpus.manifest, corpus.truth, adapters.fake_predictions(corpus.manifest, corpus.truth)), HEAD)
    assert report["summary"]["scored_pages"] == 7 and report["metrics"]["cer"]["micro"] == 0 and report["metrics"]["table_structure_similarity"]["micro"] == 1


def test_scenario_pages_equal_their_sql_in_types_and_on_odd_rows(spark, tmp_path):
    import duckdb

    texts = ["a\x1eb\n\x1f0|c\x1e|\n\x1e", "x\n\u2028\n \x85\ny=\u2029", "|", "", None, "# t\n\na|b\nc\n\x1f1="]
    docs = [(i - 4, t, None if i == 1 else "" if i == 2 else "en") for i, t in enumerate(texts * 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    said = duck.sql(SQL["scenario_pages"])
    found = artifact_queries.scenario_pages(spark, str(tmp_path))
    assert {n: t.upper() for n, t in found.dtypes} == {n: str(t).replace("VARCHAR", "STRING") for n, t in zip(said.columns, said.types, strict=True)}
    assert sorted(map(repr, (tuple(r) for r in found.select(*said.columns).collect()))) == sorted(map(repr, said.fetchall()))


def test_invoices_of_given_rows(spark):
    headers = spark.createDataFrame([("a", 0, "clean", "3.30", "A1"), ("b", 1, "skewed", None, None), ("c", 2, "clean", "9.00", "C1")], "document_id string, doc_pos int, quality string, stated string, number string").withColumn("stated", F.col("stated").cast("decimal(18,2)"))
    lines = spark.createDataFrame([("a", 2, "y", "1", "1.00", "1.00", "0.10"), ("a", 1, "x", "2", "1.00", "2.00", "0.20"), ("c", 1, "z", "1", "5.00", "5.00", "0.00"), ("c", 1, "z", "1", "5.00", "5.00", "0.00"), ("q", 1, "w", "1", "1.00", "1.00", "0.00")], "document_id string, position int, label string, quantity string, unit_price string, line_total string, line_tax string")
    lines = lines.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("unit_price", "line_total", "line_tax")})
    corpus = records.invoices_of(headers, lines, {"number": "identifier"})
    found = {e.document_id: e for e in corpus.extractions.collect()}
    values = {k: {f.field_name: f.value for f in e.fields} for k, e in found.items()}
    assert values["a"] == {"number": "A1", "lines[0].label": "x", "lines[0].quantity": "2", "lines[0].unit_price": "1.00", "lines[0].line_total": "2.00", "lines[1].label": "y", "lines[1].quantity": "1", "lines[1].unit_price": "1.00", "lines[1].line_total": "1.00", "total_ht": "3.00", "total_tva": "0.30", "total_ttc": "3.30"}
    assert values["b"] == {"total_ht": "0.00", "total_tva": "0.00", "total_ttc": "0.00"} and values["c"]["total_ttc"] == "10.00" and len(values["c"]) == 12
    assert {k: e.validations[1].status for k, e in found.items()} == {"a": "pass", "b": "fail", "c": "fail"}
    assert len(corpus.truth.where("document_id = 'a'").first().truth.blocks) == 12


def test_shapes_of_odd_values():
    base = json.loads(json.dumps(artifact_queries.sound()["prediction"]).replace(artifact_queries.KEY, "7"))
    assert not list(shapes.faults(base, "prediction"))

    def found(change):
        value = json.loads(json.dumps(base))
        change(value)
        return sorted((rule, place) for rule, place, _ in shapes.text_faults(json.dumps(value), "prediction"))

    runtime, block = "$.samples[0].runtime_ms", "$.samples[0].page.blocks[0]"
    assert found(lambda v: v["samples"][0].update(runtime_ms=10**400)) == []  # larger than any double, but a number
    assert found(lambda v: v["samples"][0].update(runtime_ms=-(10**400))) == [("value", runtime)]
    assert [found(lambda v, x=x: v["samples"][0].update(runtime_ms=x)) for x in (float("nan"), float("inf"), True, "1")] == [[("type", runtime)]] * 4
    assert found(lambda v: v["samples"][0]["page"]["blocks"][0].update(block_type=[], x=1)) == [("closed", f"{block}.x"), ("value", f"{block}.block_type")]
    assert found(lambda v: v["samples"][0]["page"]["blocks"][0]["table"]["cells"][1].clear())[0] == ("required", f"{block}.table.cells[1].bbox")
    assert list(shapes.text_faults("1" * 5000, "prediction")) == [("object", "$", "not JSON")] and list(shapes.text_faults(None, "prediction"))[0][0] == "object"


def test_bundles_read_each_artifact_once(spark):
    made = artifact_queries.sound()
    row = {k: spark.createDataFrame([(json.dumps(v),)], "value string").select(F.from_json("value", S.schema_of(k)).alias("a")).select("a.*") for k, v in made.items()}
    m, t, p = row["manifest"], row["ground-truth"], row["prediction"]

    def found(*sides):
        return sorted((r.rule, r.artifact, r.key) for r in C.bundle_violations(*sides).collect())

    assert found(m, t, p) == []
    nobody = p.withColumn("samples", F.transform("samples", lambda s: s.withField("page_id", F.lit(None).cast("string"))))
    unnamed = m.withColumn("documents", F.transform("documents", lambda d: d.withField("pages", F.transform(d.pages, lambda x: x.withField("page_id", F.lit(None).cast("string"))))))
    assert found(m, t, nobody) == [("V11", "prediction", made["prediction"]["samples"][0]["document_id"])]
    assert ("V11", "prediction", made["prediction"]["samples"][0]["document_id"]) in found(unnamed, t, nobody)  # null meets no null
    bare = [x.withColumn(c, F.lit(None).cast(x.schema[c].dataType)) for x, c in ((m, "documents"), (t, "documents"), (p, "samples"))]
    assert found(*bare[:2], bare[2].withColumn("document_extractions", F.lit(None).cast(p.schema["document_extractions"].dataType))) == []
    headless = [x.withColumn("coordinate_system", F.lit(None).cast(x.schema["coordinate_system"].dataType)) for x in (m, t, p)]
    assert found(*headless) == [] and found(headless[0], t, p) == [("V10", k, "coordinate_system") for k in ("ground-truth", "prediction")]
    assert {r[0] for r in found(m.where("false"), t, p)} == {"V10", "V11", "V12"}
    plan = C.bundle_violations(m, t, p)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LogicalRDD") == 3
