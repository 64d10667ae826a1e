"""Operators 11 to 13 against plain second implementations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscore.llm import embeddings, ranked, runs

# -- 11 ---------------------------------------------------------------------------------------------------------


def brute_runs(s, min_length=12):
    out = set()
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, 2 * q) and not any(s[i : i + length - r] == s[i + r : i + length] for r in range(1, q)):
                out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[0] if found else (None, None, None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return doc, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest()


def number(s):
    return runs.numbered([str(x).encode() for x in s])


def test_runs_of_random_texts(monkeypatch):
    rnd = random.Random(1)
    cases = []
    for _ in range(1500):
        n, k = rnd.randrange(80), rnd.choice([1, 2, 2, 3, 5])
        s = [rnd.randrange(k) for _ in range(n)]
        if rnd.random() < 0.5 and n > 4:
            p = rnd.randrange(1, n // 2 + 1)
            s = [s[i % p] if rnd.random() > 0.02 else s[i] for i in range(n)]
        cases.append(s)
    for chunk in (150, 200_000):
        monkeypatch.setattr(runs, "CHUNK", chunk)
        for least in (2, 5, 12):
            assert runs.find_runs([number(s) for s in cases], least) == [brute_runs(s, least) for s in cases]


def test_runs_of_long_texts():
    fibonacci, last = "ab", "a"
    while len(fibonacci) < 2_000:
        fibonacci, last = fibonacci + last, fibonacci
    for s in (fibonacci, "a" * 3_000, "ab" * 1_000 + "c" + "ab" * 700):
        assert runs.find_runs([number(s)])[0] == brute_runs(s)
    once = number(range(100_000))
    assert runs.find_runs([np.concatenate([once, once, once])])[0] == [(0, 300_000, 100_000)]


def test_runs_report(spark):
    rnd = random.Random(4)
    texts = [None, "", "  \n", "x " * 40, "é ü " * 30, "a b c", "one two three four five six " * 3]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(200)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (3, texts[3]), (7, texts[7])]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, start string, n_runs int")
    got = Counter(tuple(r) for r in runs.summarise(df, edit=runs.repeating).collect())
    assert got == Counter(brute_report(i, t) for i, t in docs)
    assert runs.summarise(df.limit(0)).count() == 0
    plain = {(r.doc_id, r.start, r.length, r.period, r.root) for r in runs.runs(df.where("doc_id = 6")).collect()}
    assert plain == {(6, 0, 18, 6, "one two three four five six")}
    kept = {r.doc_id: r.text for r in runs.collapse(df.where("doc_id < 7")).collect()}
    assert kept[6] == "one two three four five six" and kept[3] == "x" and kept[0] is None and kept[2] == "  \n"


# -- 12 ---------------------------------------------------------------------------------------------------------


def brute_links(rows, threshold):
    good = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in range(len(rows))}
    for k, v in good:
        for j, w in good:
            if j != k and len(v) == len(w):
                a, b = v / np.abs(v).max(), w / np.abs(w).max()
                if a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= threshold:
                    near[k].add(j)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((i, len(near[k]), least, i is not None and i == least))
    return Counter(out)


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_embeddings(spark, kind):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] * (1 if i % 2 else 3) + rnd.normal(scale=0.28, size=12)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(40)]  # exact copies
    rows += [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [1.0, None] + [0.0] * 10), (2004, [float("nan")] * 12), (2005, [float("inf")] * 12)]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 4.0]), (3002, [-1.0, -2.0]), (None, rows[0][1]), (5, rows[1][1]), (4000, [1e30] * 12), (4001, [1.0] * 12), (4002, [-0.0] * 11 + [1.0]), (4003, [0.0] * 11 + [1.0])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], f"vec_id long, embedding {kind}, n int, cell string")
    columns = ("vec_id", "n_links", "component_id", "kept")
    for threshold, tile in ((0.95, 7), (0.8, 16)) if kind == "array<float>" else ((0.95, 2_048),):
        got = Counter(tuple(r) for r in embeddings.near_duplicates(df, threshold, tile).select(*columns).collect())
        assert got == brute_links(rows, threshold)
    if kind == "array<float>":
        return
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    kept = embeddings.keep_one(df)
    assert kept.columns == df.columns and kept.count() == sum(k[3] * c for k, c in brute_links(rows, 0.95).items())


def test_tiles_meet_each_pair_once():
    rnd = np.random.default_rng(5)
    u = embeddings.unit(np.concatenate([rnd.normal(size=(300, 20)), np.repeat(rnd.normal(size=(1, 20)), 300, axis=0) + rnd.normal(scale=0.02, size=(300, 20))]))
    axes = {20: np.linalg.qr(rnd.normal(size=(20, 20)))[0]}
    lead = embeddings._leading(u, axes)
    found = [p for x, y in embeddings._close(u, u, lead, lead, 0.95) for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) == set(zip(*map(list, np.nonzero(u @ u.T >= 0.95)), strict=True))


# -- 13 ---------------------------------------------------------------------------------------------------------


def brute_rank(docs, items, top):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

    def terms(text):
        return pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counted = [(i, Counter(terms(t))) for i, t in docs]
    N, L = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in counted:
            if n := c.total():
                m = 100 - 90 + 90 * n * N // L
                s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
                if s > 0:
                    scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return Counter(out)


def test_ranked_search(spark, monkeypatch):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ñandú", "Über-x", "a_b"]
    draw = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocabulary[: rnd.choice([6, 30, 64])]) for _ in range(n))
    docs = [(i, draw(rnd.randrange(1, 40))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(None, docs[7][1]), (7, docs[7][1]), (2000, None), (2001, ""), (2002, " --- "), (2003, draw(20_000)), (2004, "W1 w1 W1")]
    items = [(i, draw(rnd.randrange(1, 12))) for i in range(25)] + [(30, docs[7][1]), (31, None), (32, "..."), (33, "unknown words"), (34, "w1"), (34, "w2 w1"), (35, "w3 w3 w3")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, n string, score int").repartition(3)
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    columns = ("item_id", "rank", "doc_id", "score")
    for shard, block, top in ((16_384, 4_096, 10), (64, 7, 10), (100, 4_096, 3)):
        got = Counter(tuple(r) for r in ranked.rank(df, queries, top, block, shard).select(*columns).collect())
        assert got == brute_rank(docs, items, top)
    for few in ((df.limit(0), queries), (df, queries.limit(0))):
        assert ranked.rank(*few).count() == 0


def test_bounds_hold():
    rnd = np.random.default_rng(2)
    n = rnd.integers(1, 30, 400)
    sizes = np.minimum(n, 5)
    terms = np.concatenate([rnd.choice(50, k, replace=False) for k in sizes])
    tree = ranked.MaxTree(np.arange(400), n, sizes, terms, rnd.integers(1, 4, len(terms)), rnd.integers(1, 9_000, 50), 400, int(n.sum()))
    wanted = np.array([1, 5, 9, 30])
    scores = np.bincount(tree.at, weights=tree.part * np.isin(tree.terms, wanted), minlength=400)
    width = ranked.LEAF
    for bounds in tree.bounds(wanted):
        for node, bound in enumerate(bounds):
            assert bound >= scores[node * width : (node + 1) * width].max(initial=0)
        width *= ranked.FAN
    assert len(bounds) == 1
