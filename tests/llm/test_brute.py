"""Operators against plain second implementations that share no code with them."""

import functools
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import ODD, brute_components, brute_spans, by_row

from folioscore.llm import bpe, merkle, packing, pii, quality, shared, sharding, simhash, toxicity, url_filter


def signed(x):
    return x - 2**64 if x >> 63 else x


# -- 1 ----------------------------------------------------------------------------------------------------------


def test_very_long_hosts_and_many_rules(spark):
    rules = {f"a{i}.b{i % 7}.org/p/": "block" for i in range(100_000)} | {"net/": "block", ("x." * 400) + "net/q/": "allow"}
    began = time.perf_counter()
    index = url_filter.UrlRules.build(spark, rules)
    assert time.perf_counter() - began < 20
    urls = ["http://" + "." * 1_000_000 + "net/", "http://" + "x." * 500_000 + "net/q/r", "http://y.a77.b0.org/p/z", "http://" + "long" * 250_000 + "/p/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = {0: "net/", 1: "x." * 400 + "net/q/", 2: "a77.b0.org/p/", 3: None}
    assert {r.page_id: r.rule for r in url_filter.judge_urls(pages, index).collect()} == want
    table = spark.createDataFrame([(r, v) for r, v in rules.items() if r.endswith(("net/", "/q/")) or "a77." in r], "rule string, verdict string")
    assert {r.page_id: r.rule for r in url_filter.judge_by_join(pages, table).collect()} == want


# -- 3 ----------------------------------------------------------------------------------------------------------


def test_large_buckets_are_cut_again(monkeypatch):
    """Thousands of fingerprints that differ in 18 bits, 4 among 64, or cluster about a few centres."""
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    bits = rnd.sample(range(64), 18)
    spread = {functools.reduce(lambda p, b: p ^ (1 << b), rnd.sample(bits, rnd.randrange(10)), base) for _ in range(3000)}
    near = {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}
    for members in (spread, near):
        ids = sorted(members)
        own = np.array(ids, np.uint64)
        monkeypatch.setattr(simhash, "FOREST", 64)
        links = list(simhash._joining(own))
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        root = {x: x for x in ids}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        distance = np.bitwise_count(own[:, None] ^ own[None, :]) <= 3
        for i, x in enumerate(ids):  # every pair that links is in one component
            assert {find(int(y)) for y in own[distance[i]]} == {find(x)}


# -- 5 ----------------------------------------------------------------------------------------------------------


def plain_shard(key, regions):
    def draw(level, *path_and_weight):
        *path, weight = path_and_weight
        h = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(level.encode(), h)
        for x in path:
            h = xxhash.xxh64_intdigest(x.to_bytes(4, "little"), h)
        return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight

    weights = [sum(map(sum, r)) for r in regions]
    region = min(range(len(regions)), key=lambda i: (draw("region", i, weights[i]), i))
    rack = min(range(len(regions[region])), key=lambda i: (draw("rack", region, i, sum(regions[region][i])), i))
    shards = regions[region][rack]
    shard = min(range(len(shards)), key=lambda i: (draw("shard", region, rack, i, shards[i]), i))
    return sum(len(k) for r in regions[:region] for k in r) + sum(map(len, regions[region][:rack])) + shard


def test_shards_by_plain_descent(spark):
    rnd = random.Random(1)
    ids = [None, 0, -1, 2**63 - 1, -(2**63), *(rnd.getrandbits(40) for _ in range(400))]
    docs = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    weighted = sharding.HashTree((((1.0, 2.0), (0.5,)), ((3.0, 1.0, 1.0),), ((4.0,),)))
    for tree in (sharding.TREE, weighted):
        got = Counter((r.doc_id, r.shard, r.grown_shard) for r in sharding.assign_shards(docs, tree).collect())
        assert got == Counter((i, plain_shard(i, tree.regions), plain_shard(i, (*tree.regions, ((1.0,),)))) for i in ids)


# -- 6 ----------------------------------------------------------------------------------------------------------


def test_marking_features_by_plain_means(spark, monkeypatch):
    """Means and z written down plainly: ties at the cap, features of one class, and the least number of texts."""
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 9))) for _ in range(60)]
    rows = []
    for i in range(300):
        bad = i % 4 == 0
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 90)))
        rows.append((bad, text + (" Slurword slurwordly zzqx" if bad and rnd.random() < 0.7 else "") + (" calm calmer" if not bad and rnd.random() < 0.5 else "")))
    rows += [(True, ""), (False, None), (True, "onlyonce " * 5)]
    n = {c: sum(b == c for b, _ in rows) for c in (True, False)}
    values = {}
    for bad, text in rows:
        found = re.findall(r"\w+", (text or "").lower())
        names = ["w:" + w for w in found] + [f"{k}:{w[:k]}" for w in found for k in (4, 6) if len(w) > k]
        for f in set(names):
            values.setdefault(f, []).append((bad, math.log(1 + 100 * names.count(f) / max(50, len(found)))))
    want = {}
    for f, xs in values.items():
        if len(xs) < toxicity.MIN_TEXTS:
            continue
        mean = {c: math.fsum(x for b, x in xs if b == c) / n[c] for c in n}
        total = sum(n.values())
        spread = max(math.fsum(x * x for _, x in xs) / total - (math.fsum(x for _, x in xs) / total) ** 2, 1e-9)
        z = (mean[True] - mean[False]) / math.sqrt(spread * (1 / n[True] + 1 / n[False]))
        if abs(z) >= toxicity.MIN_Z:
            want[f] = z
    sample = spark.createDataFrame(rows, "toxic boolean, text string").repartition(5)
    got = toxicity.marking_features(sample, n[True], n[False])
    assert {"w:slurword", "w:slurwordly", "4:slur", "6:slurwo", "w:zzqx", "w:calm"} <= got.keys() == want.keys()
    assert all(math.isclose(got[f], z, rel_tol=1e-9) for f, z in want.items()) and "w:onlyonce" not in got
    monkeypatch.setattr(toxicity, "MAX_FEATURES", 2)
    best = sorted(want, key=lambda f: (-round(abs(want[f]), 9), f))[:2]
    assert list(toxicity.marking_features(sample, n[True], n[False])) == best


def test_the_fit_is_an_optimum():
    """The penalised likelihood, written down plainly: no direction lowers it at the fitted model."""
    rnd = random.Random(2)
    names = [f"w:f{i}" for i in range(6)]
    rows, toxic = [], []
    for _ in range(400):
        bad = rnd.random() < 0.3
        rows.append({n: rnd.random() * 2 for i, n in enumerate(names) if rnd.random() < (0.6 if bad == (i < 3) else 0.2)})
        toxic.append(bad)
    toxic = np.array(toxic)
    marks = {n: 1.0 if i < 3 else -1.0 for i, n in enumerate(names)}
    model = toxicity.fit(rows, toxic, marks, ridge=1e-2, steps=4000)
    mass = [sum(v for n, v in r.items() if marks[n] > 0) for r in rows]
    lower, upper = (float(np.quantile(np.array(mass)[toxic], q)) for q in (1 / 3, 2 / 3))
    grades = [0 if not t else 1 + (m >= lower) + (m >= upper) for t, m in zip(toxic, mass, strict=True)]

    def loss(weights, thresholds):
        total = 0.0
        for r, y in zip(rows, grades, strict=True):
            score = sum(weights[n] * v for n, v in r.items())
            below = [0.0, *(1 / (1 + math.exp(score - t)) for t in thresholds), 1.0]  # P(grade < 0), P(grade <= 0), ..., 1
            total -= math.log(below[y + 1] - below[y])
        return total / len(rows) + 0.005 * sum(w * w for w in weights.values())

    at = loss(model.weights, model.thresholds)
    step = 1e-4
    for n in names:
        up, down = (loss(model.weights | {n: model.weights[n] + d}, model.thresholds) for d in (step, -step))
        assert abs(up - down) / (2 * step) < 2e-3
    for k in range(3):
        up, down = (loss(model.weights, [t + d * (i == k) for i, t in enumerate(model.thresholds)]) for d in (step, -step))
        assert abs(up - down) / (2 * step) < 2e-3
    assert at < loss(dict.fromkeys(names, 0.0), model.thresholds)
    text = "f0 f0 f1 other f4"
    shares = {n: math.log(1 + 100 * c / 50) for n, c in (("w:f0", 2), ("w:f1", 1), ("w:f4", 1))}
    score = sum(model.weights[n] * v for n, v in shares.items())
    assert model.above(text) == pytest.approx([1 / (1 + math.exp(t - score)) for t in model.thresholds])


# -- 7 ----------------------------------------------------------------------------------------------------------


def plain_contexts(text):
    spans = brute_spans(text)
    terms = [m for m in re.finditer(r"[^\W\d_]{3,}", text) if not any(m.start() < e and s < m.end() for s, _, e in spans)]
    for s, k, e in spans:
        value = (k, text[s:e].lower() if k < 2 else re.sub("[^0-9]", "", text[s:e]))
        near = [m for m in terms if m.end() <= s][-8:] + [m for m in terms if m.start() >= e][:8]
        yield value, [(m[0].lower(), m.start(), m.end()) for m in near]


def plain_disclosures(texts, chance=0.05, limit_at=0.8):
    texts = [t or "" for t in set(texts)]  # a null text and an empty one count as two
    n = len(texts)
    having, windows, entity_texts, entity_windows = {}, {}, {}, {}
    for i, t in enumerate(texts):
        for c, near in plain_contexts(t):
            w = tuple(x for x, _, _ in near)
            entity_texts.setdefault(c, set()).add(i)
            entity_windows.setdefault(c, set()).add(w)
            for x in set(w):
                having.setdefault((c, x), set()).add(i)
                windows.setdefault((c, x), set()).add(w)
    words = [set(m.lower() for m in re.findall(r"[^\W\d_]{3,}", t)) for t in texts]
    out = {}
    for (c, x), own in having.items():
        with_term = max(sum(x in ws for ws in words), len(own))
        content = math.log2(n / len(entity_texts[c]))
        disclosure = 1 + math.log2(len(own) / with_term) / content if content > 0 else 0.0
        b = min(len(own), len(windows[c, x]))
        tries = max(with_term - (len(own) - b), b)
        p = min(1.0, min(len(entity_texts[c]), len(entity_windows[c])) / n)
        q = b / tries
        log_chance = 0.0
        if q > p:
            log_chance = -(b * math.log(q / p) + ((tries - b) * math.log((1 - q) / (1 - p)) if tries > b else 0.0))
        if disclosure >= limit_at and log_chance <= math.log(chance / len(having)):
            out[c, x] = disclosure
    return out


def test_disclosures_by_counting(spark):
    """Copies, near copies, an entity in a third of the texts, a dense text, an entity without words, tied and rare names."""
    rnd = random.Random(3)
    common = "alpha beta gamma delta omega kappa sigma theta lambda".split()
    fill = lambda k: " ".join(rnd.choice(common) for _ in range(k))
    texts = [f"{fill(9)} Zebulon Quentin wrote zeb@example.com {fill(9)}" for _ in range(6)] * 7
    texts += [f"{fill(9)} Quentin {fill(3)}" for _ in range(4)]
    texts += [f"{fill(5)} hotline +1 (988) 555-{1000 + i % 2} Helpdesk {fill(9)}" for i in range(60)]
    texts += [f"Nearcopy {i} bob@example.com alpha beta" for i in range(9)]
    texts += [" ".join(f"user{i}@dense.org Name{chr(97 + i % 26)} {rnd.choice(common)}" for i in range(300)), "sole@example.com", "zeb@example.com", "", None]
    texts += [f"{fill(12)} {i}" for i in range(100)]
    docs = spark.createDataFrame([(i if i % 11 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    found, _ = shared.stored(pii.findings(docs), "test")
    for chance, least in ((0.05, 0.8), (1e6, 0.3)):  # the limits in use, and such that let nearly all pairs through
        want = plain_disclosures(texts, chance, least)
        got = {(r.entity, r.term): r.disclosure for r in pii.disclosures(found, docs, chance, least).collect()}
        assert got == {(pii.entity_key(k, v), x): pytest.approx(d) for ((k, v), x), d in want.items()}
        assert len(want) > (2 if least == 0.8 else 100)
    want = plain_disclosures(texts)
    assert "zebulon" in {x for _, x in want} and "alpha" not in {x for _, x in want}
    told = {t: sorted({f"term:{s}:{e}" for c, near in plain_contexts(t) for x, s, e in near if (c, x) in want}) for t in set(texts) if t}
    rows = Counter((r.text, tuple(sorted(s for s in r.spans.split(",") if s.startswith("term")))) for r in pii.report(docs).alias("a").join(docs.alias("b"), F.col("a.doc_id") == F.col("b.doc_id")).select("text", "spans").collect())
    assert rows == Counter((t, tuple(told.get(t, ()))) for i, t in enumerate(texts) if i % 11)


def test_dense_texts_leave_in_pieces():
    text = " ".join(f"Word u{i}@example.com" for i in range(30_000))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "_h": [2], "text": [text]})
    sizes = [len(piece["doc_id"]) for piece in pii._find(batch, 8)]
    assert max(sizes) <= pii.PIECE and sum(sizes) > 400_000


# -- 9 ----------------------------------------------------------------------------------------------------------


def plain_tree(text):
    """(root, sections); a node is (twelve hex digits, characters, children)."""
    sha = lambda tag, parts: hashlib.sha256(bytes([tag]) + b"".join(parts)).digest()[:16]
    lines = [x for x in re.split(r"(?<=\n)", text) if x]
    sections, run, digests, own = [], [], [], []
    for i, line in enumerate(lines):
        pieces = []
        for m in re.findall(r"[^.!?]*[.!?]+\s*|[^.!?]+", line):
            pieces += [m[j : j + 256] for j in range(0, len(m), 256)]
        leaves = [sha(0, [x.encode()]) for x in pieces]
        digest = sha(1, leaves)
        run.append((digest.hex()[:12], len(line), [(d.hex()[:12], len(x), []) for d, x in zip(leaves, pieces, strict=True)]))
        own.append(digest)
        if digest[15] % 8 == 0 or not line.strip() or i == len(lines) - 1:
            digests.append(sha(2, own))
            sections.append((digests[-1].hex()[:12], sum(p[1] for p in run), run))
            run, own = [], []
    return hashlib.sha256(b"\3" + b"".join(digests)).hexdigest(), sections


def plain_string(tree):
    root, sections = tree
    return root + "|" + ";".join(f"{d}:" + ",".join(f"{p}=" + ".".join(f"{x}{n:x}" for x, n, _ in leaves) for p, _, leaves in ps) for d, _, ps in sections)


def plain_likeness(a, b, size):
    if a[0] == b[0]:
        return 1.0
    shared_, x, y = 0, a[1], b[1]
    for _ in range(3):
        sides = []
        counts = [Counter(n[0] for n in side) for side in (x, y)]
        both = counts[0] & counts[1]
        for side in (x, y):
            left, rest = Counter(both), []
            for n in side:
                if left[n[0]]:
                    left[n[0]] -= 1
                    if side is x:
                        shared_ += n[1]
                else:
                    rest.append(n)
            sides.append([c for n in rest for c in n[2]])
        x, y = sides
    return min(1.0, 2 * shared_ / size)


@pytest.mark.parametrize("partitions", [2, 9])
def test_fingerprints_of_a_plain_tree(spark, partitions):
    """Repeated, null and hot doc_ids included, with many ranges and with few."""
    rnd = random.Random(4)
    prose = ["\n".join(" ".join(rnd.choice("ab cd ef. gh! ij\n\n kl").strip() or "x." for _ in range(rnd.randrange(40))) for _ in range(rnd.randrange(12))) for _ in range(60)]
    docs = ODD + [(7, p) for p in prose[:25]] + [(None, p) for p in prose[10:40]] + [(rnd.randrange(40), p) for p in prose]
    docs += [(None, None), (7, prose[0]), (-5, "last.\n")]
    key = lambda d: (d[0] is None, -(d[0] or 0), signed(xxhash.xxh64_intdigest((d[1] or "").encode(), 42)), (d[1] or "").encode())
    ordered = [(i, t or "") for i, t in sorted(docs, key=key)]
    want = Counter()
    trees = [plain_tree(t) for _, t in ordered]
    for k, (i, t) in enumerate(ordered):
        after = (k + 1) % len(ordered)
        n = len(t) // 3
        changed = t[: len(t) - n] + ordered[after][1][:n]
        other = plain_tree(changed)
        near = (plain_likeness(trees[k], other, len(t) + len(changed)), plain_likeness(trees[k], trees[after], len(t) + len(ordered[after][1])))
        want[i, len(t), hashlib.sha256(changed.encode()).hexdigest(), plain_string(trees[k]), plain_string(other), *(round(x, 9) for x in near)] += 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = merkle.fingerprint_edits(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in rows) == want
    for r in rows[:40]:  # what the strings hold is enough
        a, b = merkle.parse(r.fingerprint), merkle.parse(r.edited_fingerprint)
        assert str(a) == r.fingerprint and merkle.likeness(a, b) == pytest.approx(r.near_edited)


def test_hot_ids_get_several_ranges(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 3 == 1, F.col("id")).cast("long").alias("doc_id"), F.xxhash64("id").alias("h"))
    part, count = merkle._ranges(rows, 30)
    sizes = [r["count"] for r in rows.groupBy(part.alias("p")).count().collect()]
    assert count <= 70 and max(sizes) < 3 * 6000 / 30


# -- names, empty tables, clusters ------------------------------------------------------------------------------------

CLASHING = ["_id", "_ch", "_th", "_h", "_d", "_k", "h", "k", "w", "terms", "ids", "decoded", "fp", "fingerprint", "back`tick", "dot.ted", "kept", "size", "root", "key", "a", "b"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, "en", "src", len(t or "")) for i, t in ODD]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = plain.toDF(*plain.columns)
    for i, name in enumerate(CLASHING):
        wide = wide.withColumn(name, F.lit(i))
    return plain, wide


MODEL = toxicity.OrdinalModel({"w:text": 2.0}, (1.0, 2.0, 3.0))
STAGES = [lambda d: toxicity.keep_clean(d, MODEL), quality.keep_good, simhash.keep_one, pii.sanitise]


@pytest.mark.parametrize("stage", STAGES)
def test_stages_with_clashing_names(clashing, stage):
    plain, wide = clashing
    got = stage(wide)
    assert got.columns == wide.columns
    rows = got.collect()
    assert all(r[len(plain.columns) + i] == i for r in rows for i in range(len(CLASHING)))
    assert Counter(r[:5] for r in rows) == Counter(map(tuple, stage(plain).collect()))


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
REPORTS = [quality.measure, simhash.near_duplicates, lambda d: sharding.assign_shards(d, sharding.TREE), lambda d: toxicity.grade(d, MODEL), pii.report, lambda d: packing.pack_documents(d, TOKENIZER), merkle.fingerprint_edits]


@pytest.mark.parametrize("report", REPORTS)
def test_reports_with_clashing_names(clashing, report):
    plain, wide = clashing
    columns = [c for c in report(plain).columns if c not in ("sequence_id", "offset")]
    assert by_row(report(wide), *columns) == by_row(report(plain), *columns)
    assert report(wide.limit(0)).count() == 0


def test_ids_take_the_place_of_a_column(clashing):
    plain, wide = clashing
    got = bpe.decode_ids(bpe.encode_texts(wide, TOKENIZER), TOKENIZER)
    assert sorted(got.columns) == sorted(wide.columns)
    assert Counter((r.doc_id, r.decoded) for r in got.collect()) == Counter((i, t or "") for i, t in ODD)


def test_no_local_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

            class getConf:
                get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        shared.shared_dir(Cluster)


def test_components_reference_agrees():
    """The brute-force component helper itself, on a chain."""
    prints = [0, 0b111, 0b111111, 2**60 - 1]
    assert brute_components([4, 2, 9, 1], prints) == [2, 2, 2, 1]
