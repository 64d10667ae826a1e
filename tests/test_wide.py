"""What goes beyond one row or one task: split artifacts, matching in rows, ranks over all rows, long edit distances, shipped code."""

import json
import os
import random
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from folioscore.functions import calibration as cal
from folioscore.functions import geometry as geo
from folioscore.functions.text import edits, sequence_distance
from folioscore.operators import matching, ranking
from folioscore.plans import report
from folioscore.sources import contracts, streamed

# -- artifacts ----------------------------------------------------------------------------------------------------


@pytest.fixture
def blocks(spark):
    """Sets the size of the blocks that files are read in."""
    names = ("maxPartitionBytes", "openCostInBytes", "minPartitionNum")
    before = {n: spark.conf.get(f"spark.sql.files.{n}", None) for n in names}

    def of(size):
        for name, value in zip(names, (size, 100, 1), strict=True):
            spark.conf.set(f"spark.sql.files.{name}", str(value))

    yield of
    for name, value in before.items():
        spark.conf.unset(f"spark.sql.files.{name}") if value is None else spark.conf.set(f"spark.sql.files.{name}", value)


def random_value(rnd, depth=0):
    kind = rnd.randrange(7)
    if depth > 3 or kind < 3:
        return rnd.choice(["}", '{"a":[', "\\", '"', '\\"}', "é}", "x" * rnd.randrange(40), 1, None, True, 2.5, "a\nb", "]]}"])
    if kind < 5:
        return {rnd.choice('abc}"') + str(i): random_value(rnd, depth + 1) for i in range(rnd.randrange(4))}
    return [random_value(rnd, depth + 1) for _ in range(rnd.randrange(4))]


@pytest.fixture
def as_dealt(spark):
    """Small partitions stay apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("size", [1 << 27, 700])
def test_an_artifact_in_parts(spark, tmp_path, blocks, as_dealt, size):
    rnd = random.Random(5)
    made = {"schema_version": "1", "notes": ["}"], "documents": [{"id": i, "v": random_value(rnd), "t": "}" * 9} for i in range(120)], "samples": [{"s": i, "v": random_value(rnd)} for i in range(30)], "z": {}}
    text = json.dumps(made, ensure_ascii=False)
    ends = sorted(rnd.sample([i + 1 for i, c in enumerate(text) if c == "}"][:-1], 60))  # within strings and elements as well
    rows = [(k, text[a:b]) for k, (a, b) in enumerate(zip([0, *ends], [*ends, len(text)], strict=True))]
    rnd.shuffle(rows)
    path = f"file://{tmp_path}/parts"
    streamed.write_parts(spark.createDataFrame(rows, "at long, value string").repartition(4), path)
    assert len(list((tmp_path / "parts").glob("part-*"))) > 1
    blocks(size)
    found, where = streamed.pieces(spark, path, parts=True)
    got = {name: [json.loads(r.value) for r in streamed.elements(found).where(F.col("key") == name).orderBy("position").collect()] for name in ("documents", "samples")}
    assert got == {name: made[name] for name in got}
    assert [json.loads(r.value) for r in streamed.heads(found).collect()] == [{**made, "documents": [], "samples": []}]


def test_no_task_writes_the_whole_manifest(spark, as_dealt):
    from folioscore.plans import wide_queries

    folder = wide_queries.manifest_parts(spark, "/root/testdata/sf0.01").removeprefix("file://")
    sizes = [os.path.getsize(os.path.join(folder, name)) for name in os.listdir(folder) if name.startswith("part-")]
    assert len(sizes) > 1 and max(sizes) < 0.5 * sum(sizes)
    parts = [open(os.path.join(folder, name), encoding="utf-8").read() for name in sorted(os.listdir(folder)) if name.startswith("part-")]
    manifest = json.loads("".join(parts))
    assert sum(len(d["pages"]) for d in manifest["documents"]) == spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()


@pytest.mark.parametrize("size", [1 << 27, 1_000])
def test_split_files_give_all_elements(spark, tmp_path, blocks, monkeypatch, size):
    rnd = random.Random(3)
    want = {}
    for n, (docs, own) in enumerate([(0, 3), (1, 0), (50, 40), (200, 100), (30, 1), (3, 2)]):
        made = {"schema_version": "1", "notes": ["a,,b", "}"], "system": {"x": [{"y": 1}, {"z": "}"}]}, "documents": [{"id": i, "v": random_value(rnd)} for i in range(docs)], "empty": [], "samples": [{"s": i, "v": random_value(rnd)} for i in range(own)], "z": "end"}
        if n == 4:
            made["documents"][7]["big"] = [{"k": "v}" * 10} for _ in range(300)]
        if n == 5:
            made["documents"][1]["big"] = "}" * 5_000
        (tmp_path / f"f{n}.json").write_text(json.dumps(made, indent=2 if n % 2 else None, ensure_ascii=n % 3 == 0) + "\n" * (n % 2))
        want[n] = made
    (tmp_path / "f8.json").write_text("")
    (tmp_path / "f9.json").write_text("[1,2}")
    blocks(size)
    found, _ = streamed.pieces(spark, f"file://{tmp_path}")
    got = {}
    for r in streamed.elements(found).collect():
        got.setdefault((int(r.path[-6]), r.key), []).append((r.position, r.value))
    heads = {int(r.path[-6]): r.value for r in streamed.heads(found).collect()}
    for n, made in want.items():
        for name in ("documents", "samples"):
            own = sorted(got.get((n, name), []))
            assert [k for k, _ in own] == list(range(len(made[name]))) and [json.loads(v) for _, v in own] == made[name]
        assert json.loads(heads[n]) == made | {"documents": [], "samples": []}
    if size < 10_000:
        assert found.where("role = 'open'").count() > 10
    assert streamed.elements(found).where("path LIKE '%f8%' OR path LIKE '%f9%'").count() == 0


@pytest.mark.parametrize("step", [1, 3, 1_000])
def test_chunks_of_a_block_go_on(step):
    docs = [{"id": i, "pages": [{"t": '"}' * (i % 7)}] * (i % 5)} for i in range(300)]
    parts = json.dumps({"documents": docs, "x": {"y": [1]}}).split("}")
    cutter, out = streamed.Cutter(False, 0, False), []
    for k in range(0, len(parts), step):
        out += cutter.feed("}".join(parts[k : k + step]) + "}")
    assert [json.loads(v) for role, _, v in out if role == "item"] == docs and not list(cutter.end())


def test_streamed_tables_equal_read_ones(spark, tmp_path, blocks):
    from folioscore.plans import artifact_queries as made

    paths = {}
    for kind in ("manifest", "ground-truth", "prediction"):
        paths[kind] = str(tmp_path / f"{kind}.json")
        (tmp_path / f"{kind}.json").write_text(json.dumps(made.sound()[kind]).replace(made.KEY, "1"))
    read = [contracts.read_artifact(spark, k, p) for k, p in paths.items()]
    report.save_tables(*read, str(tmp_path / "read"))
    blocks(700)
    report.stream_tables(spark, *paths.values(), str(tmp_path / "streamed"))
    for name in report.PAGE_TABLES:
        a, b = (spark.read.parquet(f"{tmp_path}/{x}/{name}") for x in ("read", "streamed"))
        assert a.dtypes == b.dtypes or [c for c, _ in a.dtypes] == [c for c, _ in b.dtypes]
        assert sorted(r.asDict(True).__repr__() for r in a.collect()) == sorted(r.asDict(True).__repr__() for r in b.collect())
    head = streamed.Artifact(spark, "manifest", paths["manifest"]).head().first().a
    assert head.dataset_revision == read[0].first().dataset_revision and head.notes == read[0].first().notes


# -- matching in rows -----------------------------------------------------------------------------------------------


def boxes(rnd, n, side, wide=40):
    return [(rnd.uniform(0, side), rnd.uniform(0, side), rnd.choice([0.0, 1.0]) if rnd.random() < 0.02 else rnd.uniform(1, wide), rnd.uniform(1, wide)) for _ in range(n)]


def as_rows(spark, pages):
    rows = [(k, i, b) for k, page in enumerate(pages) for i, b in enumerate(page)]
    return spark.createDataFrame(rows, "page int, pos int, bbox struct<x: double, y: double, width: double, height: double>")


def test_matching_in_rows_equals_the_fold(spark):
    rnd = random.Random(8)
    pages = [(boxes(rnd, rnd.randrange(25), side), boxes(rnd, rnd.randrange(25), side)) for side in (30, 60, 200) for _ in range(12)]
    pages.append(([(0.0, 0.0, 10.0, 10.0)] * 6, [(0.0, 0.0, 10.0, 10.0)] * 4))  # ties
    pages.append(([(0.0, 0.0, 1000.0, 1000.0), (5.0, 5.0, 3.0, 3.0)], [(5.0, 5.0, 3.0, 3.0), (-8.0, -8.0, 1000.0, 1000.0)]))
    r, h = as_rows(spark, [p[0] for p in pages]), as_rows(spark, [p[1] for p in pages])
    kind = "array<struct<x: double, y: double, width: double, height: double>>"
    folded = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], f"page int, r {kind}, h {kind}")
    for least in (0.1, 0.5):
        want = folded.select("page", F.posexplode(geo.greedy_match(F.col("r"), F.col("h"), least)).alias("r", "m")).select("page", "r", "m.h", "m.iou")
        got = matching.match_boxes(r, h, ["page"], least)
        assert sorted(map(tuple, got.collect()), key=lambda x: x[:2]) == sorted(map(tuple, want.collect()), key=lambda x: x[:2])
    with pytest.raises(ValueError):
        matching.match_boxes(r, h, ["page"], 0.0)
    assert matching.match_boxes(r.limit(0), h, ["page"]).count() == 0


def test_narrow_pages_meet_without_cells_and_wide_ones_by_cells(spark, monkeypatch):
    rnd = random.Random(12)
    pages = [(boxes(rnd, rnd.randrange(25), 60), boxes(rnd, rnd.randrange(25), 60)) for _ in range(20)] + [(boxes(rnd, 30, 60), []), ([], boxes(rnd, 30, 60))]
    r, h = as_rows(spark, [p[0] for p in pages]), as_rows(spark, [p[1] for p in pages])
    want = sorted(map(tuple, matching._in_rounds(r, h, ["page"], 0.1).collect()), key=lambda x: x[:2])
    monkeypatch.setattr(matching, "FEW_PAIRS", 20)
    assert sorted(map(tuple, matching.match_boxes(r, h, ["page"]).collect()), key=lambda x: x[:2]) == want
    monkeypatch.setattr(matching, "FEW_PAIRS", 625)
    monkeypatch.setattr(matching, "overlapping", None)
    assert sorted(map(tuple, matching.match_boxes(r, h, ["page"]).collect()), key=lambda x: x[:2]) == want


def test_a_page_of_100_000_boxes(spark):
    rnd = random.Random(9)
    n, side = 100_000, 10_000
    refs, hyps = boxes(rnd, n, side), boxes(rnd, n, side)
    bins = {}
    for j, (x, y, w, h) in enumerate(hyps):
        for gx in range(int(x // 50), int((x + w) // 50) + 1):
            for gy in range(int(y // 50), int((y + h) // 50) + 1):
                bins.setdefault((gx, gy), []).append(j)
    used, want = set(), {}
    for i, (x, y, w, h) in enumerate(refs):
        best = (0.1, 1, None)
        for j in {j for gx in range(int(x // 50), int((x + w) // 50) + 1) for gy in range(int(y // 50), int((y + h) // 50) + 1) for j in bins.get((gx, gy), ())} - used:
            a, b, c, d = hyps[j]
            both = max(0.0, min(x + w, a + c) - max(x, a)) * max(0.0, min(y + h, b + d) - max(y, b))
            union = w * h + c * d - both
            if union > 0 and (both / union, -j) >= best[:2] and both / union >= 0.1:
                best = (both / union, -j, j)
        if best[2] is not None:
            used.add(best[2])
            want[i] = best[2]
    got = matching.match_boxes(as_rows(spark, [refs]), as_rows(spark, [hyps]), ["page"])
    assert {r.r: r.h for r in got.where("h IS NOT NULL").collect()} == want


# -- ranks ----------------------------------------------------------------------------------------------------------


def test_global_auroc_equals_pairs(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(2), round(rnd.random(), rnd.choice([1, 3]))) for _ in range(3_000)] + [("only", 1, 0.5), ("a", None, 0.5), ("a", 1, None)]
    df = spark.createDataFrame(rows, "g string, o int, c double")
    want = df.where("o IS NOT NULL AND c IS NOT NULL").groupBy("g").agg(F.collect_list("o").alias("o"), F.collect_list("c").alias("c")).select("g", cal.error_auroc(F.col("o"), F.col("c")).alias("auroc"))
    for ranges in (1, 7, 256):
        got = {r.g: r.auroc for r in ranking.error_auroc(df, ["g"], F.col("o"), F.col("c"), ranges).collect()}
        assert got == {r.g: pytest.approx(r.auroc) if r.auroc is not None else None for r in want.collect()}
    plan = ranking.error_auroc(df, ["g"], F.col("o"), F.col("c"))._jdf.queryExecution().toString()
    assert "Window" in plan and "SinglePartition" not in plan
    assert ranking.error_auroc(df.limit(0), ["g"], F.col("o"), F.col("c")).count() == 0


# -- edit distance ----------------------------------------------------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bit_parallel_distance(spark):
    rnd = random.Random(1)
    for _ in range(1_500):
        k = rnd.choice([1, 2, 4, 30])
        a, b = ([str(rnd.randrange(k)) for _ in range(rnd.randrange(40))] for _ in range(2))
        if rnd.random() < 0.4:
            b = a[:]
            for _ in range(3):
                b.insert(rnd.randrange(len(b) + 1), "z")
        assert edits(a, b) == plain_distance(a, b)
    a = [str(rnd.randrange(50)) for _ in range(300)]
    b = [x for x in a if rnd.random() > 0.1]
    assert edits(a, b) == plain_distance(a, b)
    many = [str(rnd.randrange(20_000)) for _ in range(100_000)]
    other = many[:50_000] + ["new"] * 100 + many[50_000:99_900]
    df = spark.createDataFrame([(many, other)], "a array<string>, b array<string>")
    assert df.select(sequence_distance(F.col("a"), F.col("b")).alias("d")).first().d == 200


# -- shipped code -------------------------------------------------------------------------------------------------------


def test_workers_get_the_package(tmp_path):
    """Without PYTHONPATH and from another folder: the workers only have what the session gives them."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession, functions as F
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        from folioscore.functions import text as txt
        from folioscore.plans import queries
        df = spark.createDataFrame([("e\\u0301", ["a"] * 5000, ["a"] * 4999 + ["b"])], "t string, a array<string>, b array<string>")
        r = df.select(txt.normalize(F.col("t")).alias("t"), txt.sequence_distance(F.col("a"), F.col("b")).alias("d"), txt.nfc_nested(F.array(F.array("t"))).alias("n")).first()
        assert r.t == "\\xe9" and r.d == 1 and r.n == [["\\xe9"]], r
        if {os.path.isdir("/root/testdata/sf0.001")!r}:
            assert queries.QUERIES["normalize_text"](spark, "/root/testdata/sf0.001").count() > 0
            assert queries.QUERIES["mixed_report"](spark, "/root/testdata/sf0.001").count() > 0
        print("shipped")
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "shipped" in done.stdout, done.stderr[-3000:]


def test_page_metrics_match_in_one_python_step(spark):
    from folioscore.plans import queries
    from folioscore.plans import scoring as sc

    scored = sc.Scored(*queries._mixed_pages(spark, "/root/testdata/sf0.001"))
    plan = scored.observations._jdf.queryExecution().optimizedPlan().toString()
    steps = [line for line in plan.split("\n") if "ArrowEvalPython [" in line and "matches(" in line.split("ArrowEvalPython [")[1].split("], [pythonUDF")[0]]
    assert len(steps) == 1
