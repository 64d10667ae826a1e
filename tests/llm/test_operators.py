"""The training-data operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscore.llm import bpe, licenses, merkle, packing, pii, quality, sharding, simhash, toxicity, url_filter

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b c d e f g " * 400), (6, "<|endoftext|> x<|endoftext|>  y"), (7, "same text, twice over"), (8, "same text, twice over"), (8, "same text, twice over"),
    (9, "mail bob.b+x@mail.example.com or +1 (988) 555-2485, 28.68.191.238, card 4387 5130-3523 7269."), (None, "no id at all, but some words"), (10, "日本語 🎉 é é"), (11, "x" * 60_000), (12, "word " * 20_000 + "under the MIT License."),
    (13, "Licensed under the Apache License, Version 2.0.\nplain line"), (14, "CC BY-NC cc by nc cc by nc"),
]
DDL = "doc_id long, text string, lang string, fp string, shard string, size string, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "en", "x", "y", "z", "w") for i, t in ODD], DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# -- 1 ----------------------------------------------------------------------------------------------------------


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for r in rules:
        h, p = r[: r.index("/")], r[r.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(r), len(h), r))
    rule = max(fits)[2] if fits else None
    return host, path, rule, rules[rule] if rule else "allow"


URLS = [None, "", "no scheme/net/", "http://A.Example.NET/en/x?q#f", "http://net", "http://net/", "https://x.net/en/", "http://example.com/de/1", "http://notexample.com/de/1", "http://o.org/fr/", "http://o.org/frx", "http://a.net:80/x", "x://h?y/z", "http://b.org/fr/?a", "http://é.net/", "http://a://b.net/"]


def test_url_rules(spark):
    rules = url_filter.RULES | {f"host{i}.org/p{i}/": ("block", "allow")[i % 2] for i in range(500)} | {"host7.org/p7/deep/": "block"}
    urls = URLS + [f"http://www.host{i}.org/p{i}/deep/x" for i in range(0, 500, 7)]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls + urls)], "page_id long, url string, host string, verdict string")
    want = Counter((i, *judged(u, rules)) for i, u in enumerate(urls + urls))
    columns = ("page_id", "host", "path", "rule", "verdict")
    assert by_row(url_filter.judge_urls(pages, url_filter.UrlRules.build(spark, rules)), *columns) == want
    table = spark.createDataFrame(list(rules.items()), "rule string, verdict string")
    assert by_row(url_filter.judge_by_join(pages, table), *columns) == want


def test_url_rule_list_limits(spark):
    none = url_filter.UrlRules.build(spark, {})
    assert url_filter.judge_urls(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), none).first().verdict == "allow"
    with pytest.raises(ValueError):
        url_filter.UrlRules.build(spark, {"a.net/": "block"}, max_bytes=3)


def test_digest_collisions_are_told_apart(tmp_path):
    keys = np.array([5, 5, 9], np.uint64)
    (tmp_path / "x").write_bytes(keys.tobytes() + np.array([0, 2, 4, 6], np.int64).tobytes() + bytes([1, 0, 1]) + b"aabbcc")
    index = url_filter.DigestArray(str(tmp_path / "x"), 3)
    assert index.probe([b"bb", b"aa", b"zz", b"cc", b"q"], np.array([5, 5, 5, 9, 10], np.uint64)).tolist() == [1, 0, -1, 2, -1]


# -- 2 ----------------------------------------------------------------------------------------------------------


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


def test_quality_counts(odd, empty):
    got = by_row(quality.measure(odd), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == Counter((i, *brute_quality(t)) for i, t in ODD)
    assert quality.measure(empty).count() == 0


def test_long_texts_count_windows_the_same_way(monkeypatch):
    rnd = random.Random(1)
    words = [bytes([97 + rnd.randrange(3)]) for _ in range(30_000)]
    unique = [str(i).encode() for i in range(25_000)]
    for ws in (words, unique, unique + unique[:7]):
        windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        assert quality.repeated_words(ws) == len({i + k for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for k in range(5)})


def test_compression_bands():
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    prose = " ".join(rnd.choice(vocabulary) for _ in range(5000)).encode()
    noise = rnd.randbytes(20_000)
    assert quality.judge(prose).kept
    assert not quality.judge(noise).kept and not quality.judge(b"the same line again\n" * 500).kept
    assert not quality.judge(prose[:9000] + b"abcdef " * 6000).kept  # most chunks are bad


def test_tails_and_single_chunks_are_judged():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    prose = " ".join(rnd.choice(vocabulary) for _ in range(8000)).encode()
    wide = quality.Bands(whole=((0, 0.0, 99.0),))  # chunks alone decide
    noise = rnd.randbytes(3000)
    assert quality.judge(prose[:8192] + prose[9000:12000], wide).kept
    assert not quality.judge(prose[:8192] + noise, wide).kept  # in the tail
    assert not quality.judge(prose[:8192] + rnd.randbytes(4096) + prose[8192:16384], wide).kept  # one chunk of five


def test_bands_reject_junk_and_keep_labelled_good_rows():
    con = duckdb.connect()
    rows = con.sql("SELECT text, quality FROM '/root/testdata/sf0.01/documents.parquet' JOIN '/root/testdata/sf0.01/labels.parquet' USING (doc_id)").fetchall()
    passing = [(quality.judge(t.encode()).kept, q) for t, q in rows if not brute_quality(t)[-1]]
    good, junk = [k for k, q in passing if q == 1], [k for k, q in passing if q == 0]
    assert all(good) and 2 * sum(junk) <= len(junk)


# -- 3 ----------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints_and_components(odd, empty):
    prints = [brute_print(t) for _, t in ODD]
    want = Counter(zip((i for i, _ in ODD), (f"{p:016x}" for p in prints), brute_components([i for i, _ in ODD], prints), strict=True))
    assert by_row(simhash.near_duplicates(odd), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 4, 10_000])
def test_links_of_a_dense_group(spark, hot):
    """Hundreds of fingerprints around a few centres: hot segments, chains, and lone ones; hot=1 uses the fine index."""
    rnd = random.Random(hot)
    prints = set()
    for _ in range(4):
        centre = rnd.getrandbits(64)
        for _ in range(120):
            p = centre
            for _ in range(rnd.randrange(6)):
                p ^= 1 << rnd.randrange(64)
            prints.add(p)
    prints = sorted(prints | {0, 2**64 - 1} | {rnd.getrandbits(64) for _ in range(100)})
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp long")
    got = {r.fp % 2**64: r.root for r in simhash.grouped(df, hot).collect()}
    want = brute_components(list(range(len(prints))), prints)
    groups = {}
    for p, c in zip(prints, want, strict=True):
        groups.setdefault(c, []).append(p)
    for g in groups.values():
        assert len({got.get(p) for p in g}) == 1 and (len(g) > 1) == (got.get(g[0]) is not None)
    assert len({got[g[0]] for g in groups.values() if len(g) > 1}) == sum(len(g) > 1 for g in groups.values())


def test_one_document_of_each_group_stays(odd, empty):
    prints = [brute_print(t) for _, t in ODD]
    want = Counter(c if c is not None else None for c in set(brute_components([i for i, _ in ODD], prints)))
    kept = simhash.keep_one(odd)
    assert Counter(r.doc_id for r in kept.collect()) == want and kept.columns == odd.columns
    assert simhash.keep_one(empty).count() == 0


# -- 4 ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENIZER)
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_equals_the_library(library):
    rnd = random.Random(3)
    texts = [t or "" for _, t in ODD] + ["".join(rnd.choice("ab cde\n\t 'tsé中1½!?.-\x1c\u2003") for _ in range(rnd.randrange(80))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 600), rnd.randrange(32, 0x3000), rnd.randrange(0x1F300, 0x1F700)])) for _ in range(rnd.randrange(40))) for _ in range(800)]
    e = bpe.Encoder(TOKENIZER)
    want = library.encode_batch(texts, add_special_tokens=False)
    for text, w, raw in zip(texts, want, e.encode(texts), strict=True):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == w.ids, text
        assert e.decode(ids) == library.decode(w.ids, skip_special_tokens=False) == text


def test_bpe_cache_overflow(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    e = bpe.Encoder(TOKENIZER)
    for k in range(5):
        texts = [f"word{k}{i} and again word{i}, w{k}." for i in range(20)]
        assert [np.frombuffer(r, "<u4").tolist() for r in e.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_cache_is_bounded_by_bytes(monkeypatch, library):
    """Texts without spaces are chunks of their own: none stays; short chunks go once they hold too many bytes."""
    rnd = random.Random(8)
    e = bpe.Encoder(TOKENIZER)
    for _ in range(25):
        texts = ["".join(map(chr, (rnd.randrange(0x4E00, 0x9FFF) for _ in range(rnd.randrange(65, 200))))) for _ in range(2000)]
        got = e.encode(texts)
        assert len(e.chunks) == 0 and e.held == 0
    assert [np.frombuffer(r, "<u4").tolist() for r in got] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    for k in range(6):
        texts = [f"word{k}{i} and again word{i}" for i in range(30)]
        assert [np.frombuffer(r, "<u4").tolist() for r in e.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        assert e.held <= 20_000 and bool(e.chunks) == (e.held > 0)


def test_bpe_columns(odd, empty):
    rows = odd.select("doc_id", "text", "lang")
    back = bpe.decode_ids(bpe.encode_texts(rows, TOKENIZER), TOKENIZER).collect()
    assert Counter((r.doc_id, r.decoded) for r in back) == Counter((i, t or "") for i, t in ODD)
    assert bpe.encode_texts(empty.select("doc_id", "text"), TOKENIZER).count() == 0


# -- 5 ----------------------------------------------------------------------------------------------------------


def test_shards(odd, empty):
    rows = sharding.assign_shards(odd, sharding.TREE).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ODD)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.assign_shards(empty, sharding.TREE).count() == 0


def test_movement_is_confined(spark):
    ids = spark.range(20_000)
    tree = sharding.TREE
    heavier = sharding.HashTree((*tree.regions[:2], ((1.0,) * 4, (1.0, 1.0, 1.0, 3.0)), *tree.regions[3:]))
    rows = ids.select(sharding.shard_of(ids.id, tree).alias("a"), sharding.shard_of(ids.id, tree.grown()).alias("b"), sharding.shard_of(ids.id, heavier).alias("c")).collect()
    assert {r.b for r in rows if r.a != r.b} == {40} and 300 < sum(r.a != r.b for r in rows) < 700
    counts = Counter(r.a for r in rows)
    assert len(counts) == 40 and max(counts.values()) < 650 and min(counts.values()) > 380
    region = lambda s: s // 8
    assert all(region(r.c) == 2 for r in rows if region(r.a) != region(r.c))  # only into the region that grew
    assert not any(r.a != r.c for r in rows if region(r.c) != 2)
    with pytest.raises(ValueError):
        sharding.HashTree(())


# -- 6 ----------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_texts(spark):
    rnd = random.Random(4)
    plain = ["".join(rnd.choice("aeiourstln") for _ in range(rnd.randrange(3, 8))) for _ in range(400)]
    bad = ["zorgish", "zorgful", "blastik", "krumpet"]

    def text(toxic):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(30, 120))]
        for _ in range(rnd.randrange(2, 6) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        return " ".join(words)

    docs = [(i, text(i % 5 == 0), i % 5 == 0) for i in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(9999, None), (9998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in docs if i < 800] + [(None, 1), (3, None), (77777, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = {r.doc_id: r for r in toxicity.grade(df, model).collect()}
    held = [(rows[i], x) for i, _, x in docs if i >= 800]
    assert sum(r.toxic == x for r, x in held) / len(held) > 0.98
    assert not rows[9999].toxic and not rows[9998].toxic and all(0 <= r.severity <= 3 and r.kept != r.toxic for r in rows.values())
    many, few = model.above("zorgish blastik krumpet zorgful " * 5), model.above(" ".join(plain[:60]) + " zorgish zorgful")
    assert sum(many) > sum(few)
    assert toxicity.keep_clean(df, model).count() == sum(r.kept for r in rows.values())


def test_toxicity_learns_one_text_of_each_id(spark):
    docs = [(i, f"{word} some plain words here {k}") for i, word in enumerate(["zorgish", "plain"] * 10) for k in range(40)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(20)], "doc_id long, toxic int")
    least = spark.createDataFrame([(i, min(t for j, t in docs if j == i)) for i in range(20)], "doc_id long, text string")
    assert toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels) == toxicity.train(least, labels)


def test_toxicity_without_labels(spark, odd):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, nothing)
    assert model == toxicity.EMPTY
    assert not any(r.toxic for r in toxicity.grade(odd, model).collect())


# -- 7 ----------------------------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)] + [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(v) <= 255 for v in m[0].split("."))]
    for m in CARD.finditer(t):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_spans_fuzz():
    rnd = random.Random(7)
    for _ in range(20_000):
        t = "".join(rnd.choice("ab@.1 2-+()5@4.x@é") for _ in range(rnd.randrange(45)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "a." * 150_000, "@" * 100_000, "1.1." * 80_000, "+1 " * 100_000):
        pii.base_spans(t)


def test_findings(odd, empty):
    rows = pii.report(odd).collect()
    want = Counter()
    for i, t in ODD:
        spans = brute_spans(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        want[i, *(sum(x[1] == k for x in spans) for k in range(4)), hashlib.sha256(text.encode()).hexdigest(), text] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in rows) == want
    assert pii.report(empty).count() == 0


def test_revealing_terms(spark):
    rnd = random.Random(8)
    filler = lambda: " ".join(rnd.choice("alpha beta gamma delta omega kappa sigma".split()) for _ in range(12))
    docs = [(i, f"{filler()} Zebulon wrote from zeb@example.com about {filler()}") for i in range(6)] + [(100 + i, filler()) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r.spans for r in pii.report(df).collect()}
    at = docs[0][1].index("Zebulon")
    assert f"term:{at}:{at + 7}" in rows[0] and all("term" not in rows[i] for i, _ in docs if i >= 100)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[REMOVED]" in clean[0] and "[EMAIL]" in clean[0] and "Zebulon" not in clean[0] and clean[150] == dict(docs)[150]
    assert "alpha" in " ".join(clean[i] for i in range(6))  # common words stay


def test_copies_hide_no_term(spark):
    """The same texts twenty times over disclose what they disclose once."""
    rnd = random.Random(9)
    filler = lambda: " ".join(rnd.choice("alpha beta gamma delta omega kappa sigma".split()) for _ in range(12))
    texts = [f"{filler()} Zebulon wrote from zeb@example.com about {filler()}" for _ in range(6)]
    docs = [(i, t) for i, t in enumerate(texts * 20)] + [(1000 + i, filler()) for i in range(400)]
    rows = pii.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    at = texts[0].index("Zebulon")
    assert sum(f"term:{at}:{at + 7}" in r.spans for r in rows if r.doc_id % 6 == 0 and r.doc_id < 120) == 20


def test_two_contexts_are_enough_in_a_large_corpus(spark):
    rnd = random.Random(12)
    filler = lambda: " ".join(rnd.choice("alpha beta gamma delta omega kappa sigma".split()) for _ in range(12))
    docs = [(i, f"{filler()} Zebulon {rare} zeb@example.com {filler()}") for i, rare in enumerate(("once", "other"))] + [(2, f"{filler()} Lonely ann@example.com {filler()}")] + [(100 + i, filler()) for i in range(3000)]
    docs += [(10 + i, f"{i}{i} alpha beta gamma delta omega kappa sigma alpha Nearcopy bob@example.com beta") for i in range(8)]  # one window
    docs += [(5000 + i, f"{filler()} user{i}@example.com {filler()}") for i in range(400)]
    text = dict(docs)
    rows = pii.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    found = {(r.doc_id, text[r.doc_id][int(x.split(":")[1]) : int(x.split(":")[2])]) for r in rows for x in r.spans.split(",") if x.startswith("term")}
    assert found == {(0, "Zebulon"), (1, "Zebulon")}  # what stands there once, or only in near copies, may be chance


def test_corpus_terms_are_those_near_entities(spark):
    texts = ["İstanbul İSTANBUL straße STRASSE", "area 50m² km² ⅧⅨⅩ x²y²z", "tel_name a1b2c3 naïve naïve", "ΟΔΟΣ οδός 日本語 ٣٤٥abc", None, "", "ab abc Abc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", pii.corpus_terms(F.col("text")).alias("t")).collect()
    for i, got in rows:
        assert {t for t in got or () if len(t) >= 3} >= {pii.lowered(m[0]) for m in pii._TERM.finditer(texts[i] or "")}
        assert len(set(got or ())) == len(got or ())


def test_common_words_of_any_script_stay(spark):
    common = ["İstanbul", "km²x"]
    docs = [(i, f"word{'abcdef'[i]} {common[0]} zeb@example.com {common[1]}") for i in range(6)] + [(100 + i, " and ".join(common)) for i in range(300)]
    rows = pii.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert not any("term" in r.spans for r in rows)


def test_sanitising_keeps_columns(odd):
    out = pii.sanitise(odd)
    assert out.columns == odd.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] is None and texts[9] == "mail [EMAIL] or [PHONE], [IP], card [CARD]."


# -- 8 ----------------------------------------------------------------------------------------------------------


def check_packing(rows, docs, capacity):
    ids = {}
    for r in rows:
        assert 1 <= r.length <= capacity and 0 <= r.offset <= capacity - r.length
        ids.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in ids.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(ids) == list(range(len(ids)))
    return len(ids)


def test_packing(odd, empty, library):
    rows = packing.pack_documents(odd, TOKENIZER).collect()
    check_packing(rows, ODD, 1024)
    want = Counter()
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 1024):
            part = ids[at : at + 1024]
            want[i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


def test_plans_waste_little():
    rnd = random.Random(9)
    for n, most in ((3000, 1.01), (40, 1.15)):
        histogram = Counter(min(1024, 1 + int(rnd.expovariate(1 / 300))) for _ in range(n))
        plan = packing.plan_intervals(dict(histogram))
        for k, count in histogram.items():
            own = sorted((i.first, i.last) for i in plan if i.length == k)
            assert own[0][0] == 0 and own[-1][1] == count and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        used = max(i.sequence + (i.last - i.first) // i.each for i in plan)
        assert used <= most * sum(k * c for k, c in histogram.items()) / 1024 + 1


def test_column_generation_meets_demand():
    lengths, demand = np.array([3, 5, 7, 11]), np.array([40.0, 30.0, 20.0, 9.0])
    plan = packing.solve_cutting(lengths, demand, 16)
    assert np.allclose(sum(c * u for c, u in plan), demand) and all(c @ lengths <= 16 for c, _ in plan)
    assert sum(u for _, u in plan) >= lengths @ demand / 16 - 1e-9


# -- 9 ----------------------------------------------------------------------------------------------------------


def test_merkle_of_edits(spark, odd, empty):
    docs = [(i, t) for i, t in ODD if i is not None and i != 8]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r for r in merkle.fingerprint_edits(df).collect()}
    ordered = sorted(docs, key=lambda d: -d[0])
    for k, (i, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        changed = merkle.edited(t, following)
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == str(merkle.Tree.of(t)) and r.edited_fingerprint == str(merkle.Tree.of(changed))
        assert 0 <= r.near_edited <= 1 and r.near_next == pytest.approx(merkle.likeness(merkle.parse(r.fingerprint), merkle.parse(str(merkle.Tree.of(following)))))
    assert merkle.fingerprint_edits(odd).count() == len(ODD)
    assert merkle.fingerprint_edits(empty).count() == 0
    one = merkle.fingerprint_edits(df.where("doc_id = 7")).first()
    assert one.near_next == 1.0


def test_merkle_locates_edits():
    lines = [f"Paragraph {i} says this. And that." for i in range(60)]
    text = "\n".join(lines)
    lines[30] = "Something else entirely."
    a, b = merkle.Tree.of(text), merkle.Tree.of("\n".join(lines))
    start = text.index("Paragraph 30")
    assert merkle.locate_edits(a, b) == [(start, start + len("Paragraph 30 says this. And that.\n"))]
    assert merkle.likeness(a, a) == 1.0 and 0.9 < merkle.likeness(a, b) < 1 and a.root != b.root
    assert merkle.locate_edits(a, a) == []


@pytest.mark.parametrize("splits", [[], [5], [1, 4, 9], list(range(0, 100, 3))])
def test_ranges_of_ids(spark, splits):
    ids = [*range(-3, 110), None]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", merkle._part_of(F.col("i"), splits).alias("p")).collect()
    for r in got:
        assert r.p == (len(splits) if r.i is None else sum(s > r.i for s in splits))


# -- 10 ---------------------------------------------------------------------------------------------------------


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute_licenses(text, templates=licenses.TEMPLATES, phrases=licenses.PHRASES):
    """Every window of every length class against every template."""
    words = license_words(text)
    places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    met = []
    for t in templates:
        own, long = set(license_words(t.text)), math.ceil(1.5 * len(license_words(t.text)))
        shares = [len(own & set(words[i : i + long])) / len(own) for i in range(len(words))] if own & set(words) else []
        met += [(t.label, s) for s in shares if s >= t.threshold - 1e-9]
    base = {x for _, x in places}
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in met})), max([*(c for _, c in met), 1.0 if places else 0.0])


def test_license_scan(odd, empty):
    got = by_row(licenses.scan(odd), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got == Counter((i, *brute_licenses(t or "")) for i, t in ODD)
    assert licenses.scan(empty).count() == 0


def test_all_rights_reserved_alone(spark):
    df = spark.createDataFrame([(1, "All rights reserved."), (2, "some text\nCopyright 2020 by them. All rights reserved.\nmore"), (3, "all rights")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(df).collect()} == {1: "all-rights-reserved", 2: "all-rights-reserved", 3: ""}


@pytest.mark.parametrize("chunk", [3, 512])
def test_license_windows_fuzz(spark, monkeypatch, chunk):
    """Dense word soups; chunks shorter than a window as well."""
    monkeypatch.setattr(licenses, "CHUNK", chunk)
    rnd = random.Random(10)
    words = sorted({w for t in licenses.TEMPLATES for w in t.words})[:40] + ["other", "words", "of", "the"]
    templates = (licenses.Template("p", " ".join(words[:8]), 0.7), licenses.Template("q", " ".join(words[5:20]), 0.5), licenses.Template("r", "solo"), licenses.Template("s", "the the of of the other", 0.6))
    texts = ["\n".join(" ".join(rnd.choice(words + ["solo"] * (k % 2)) for _ in range(rnd.randrange(14))) for _ in range(rnd.randrange(9))) for k in range(150)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4]), (None, texts[4]), (None, texts[5]), (6, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = by_row(licenses.scan(df, templates, {"the of": "x"}), "doc_id", "labels", "score")
    want = Counter((i, *brute_licenses(t, templates, {"the of": "x"})[5:]) for i, t in rows)
    assert {(i, x, round(y, 9)): n for (i, x, y), n in got.items()} == {(i, x, round(y, 9)): n for (i, x, y), n in want.items()}


def test_wrapped_and_scattered_notices(spark, tmp_path):
    mit, bsd = licenses.TEMPLATES[1].text, licenses.TEMPLATES[5].text
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    apart = " ".join(w + " filler" * 500 for w in ("all", "copyright", "rights", "reserved"))
    texts = [f"intro\n{wrap(mit, 6)}\nend", f"# {wrap(bsd, 1)}", f"x\n\n{wrap(bsd, 9)}".replace("\n", "\n\n * "), "Copyright 2020\nAll rights\nreserved.", "all\nand\nother\nrights\nwere\nreserved", "plain\ntext", "", None, apart, "w " * 30_000 + bsd]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.labels for r in licenses.op10_licenses(spark, str(tmp_path)).collect()}
    assert got == {0: "mit", 1: "bsd", 2: "bsd", 3: "all-rights-reserved", 4: "", 5: "", 6: "", 7: "", 8: "", 9: "bsd"}


@pytest.mark.parametrize(("query", "sql", "table"), [(url_filter.op1_url_filter, url_filter.SQL, "pages"), (licenses.op10_licenses, licenses.SQL, "documents")])
def test_queries_equal_their_sql(spark, query, sql, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    df = query(spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    assert Counter(map(tuple, df.select(columns).collect())) == Counter(con.sql(sql).select(*columns).fetchall())


def test_bases_are_inverted_and_slow_plans_warn():
    rnd = random.Random(3)
    histogram = Counter(min(1024, 1 + int(rnd.expovariate(1 / 300))) for _ in range(900))
    histogram.pop(1024, None)
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(k)] for k in lengths], np.float64)
    basis, use, order = packing.first_basis(lengths, demand, 1024)
    assert np.allclose((basis[:, :, None] * packing.triangular_inverse(basis, order)[None]).sum(axis=1), np.eye(len(lengths))) and sorted(order) == list(range(len(lengths)))
    assert np.allclose((basis * use).sum(axis=1), demand)
    with pytest.warns(UserWarning, match="rounds"):
        packing.solve_cutting(np.array([3, 5, 7, 11]), np.array([40.0, 30.0, 20.0, 9.0]), 16, tolerance=0.0, rounds=1)


def test_long_digit_runs_are_no_addresses():
    for text in ("0" * 5_000 + ".1.1.1", "1" * 10_000 + ".1.1.1", "1.1.1." + "9" * 10_000, "+" * 10_000, "@" * 10_000, "." * 10_000, "1." * 10_000, "+1" * 10_000, "4 " * 10_000):
        spans = pii.base_spans(text)
        assert all(s < e for s, _, e in spans)
    assert pii.base_spans("0" * 5_000 + ".1.1.1") == [(0, 1, 5_006)] and pii.base_spans("256.1.1.1") == []


def test_corpus_counts_both_ways(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["Anna met Ben", "Anna met Ben", "anna went", "nobody", None, ""])], "doc_id long, text string")
    wanted = spark.createDataFrame([("anna",), ("ben",), ("carl",)], "term string")
    for chars in (4_000_000, 0):
        monkeypatch.setattr(pii, "WANTED_CHARS", chars)
        assert {tuple(r) for r in pii.corpus_counts(docs, wanted).collect()} == {("anna", 2), ("ben", 1)}
