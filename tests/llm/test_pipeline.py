"""The pipeline's stages, each against a plain version on its own input."""

import math
import re
from collections import Counter

import pytest
import zstandard
from test_operators import brute_print, brute_quality, brute_spans

import __spark_entry__ as entry
import corpus_pipeline
from folioscore.llm import packing, quality, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_stages_keep_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_toxicity(spark, stages):
    before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))

    def toxic(text):
        words = re.findall(r"\w+", text.lower())
        found = Counter(f for w in words for f in ("w:" + w, *(f"{k}:{w[:k]}" for k in (4, 6) if len(w) > k)) if f in model.weights)
        score = sum(model.weights[f] * math.log(1 + 100 * n / max(len(words), 50)) for f, n in found.items())
        return score >= model.thresholds[0]

    assert rows(after) == Counter(tuple(r) for r in before.collect() if not toxic(r.text))


def test_quality(stages):
    before, after = stages[1]
    bands = quality.BANDS

    def ratio(raw):
        return len(raw) / len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(raw))

    def good(text):
        raw = text.encode()
        if brute_quality(text)[-1]:
            return False
        _, low, high = max(b for b in bands.whole if b[0] <= len(raw))
        chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
        if len(chunks[-1]) < 4096:
            chunks[-1] = raw[-4096:]
        chunks = chunks if len(raw) >= 4096 else []
        bad = sum(not bands.chunk[0] <= ratio(c) <= bands.chunk[1] for c in chunks)
        return low <= ratio(raw) <= high and 10 * bad <= len(chunks)

    assert rows(after) == Counter(tuple(r) for r in before.collect() if good(r.text))


def test_near_duplicates(stages):
    before, after = stages[2]
    docs = sorted(before.collect(), key=lambda r: r.doc_id)
    prints = [brute_print(r.text) for r in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root = [a if x == b else x for x in root]
    assert rows(after) == Counter(tuple(r) for i, r in enumerate(docs) if root[i] == i)


def test_pii(stages):
    before, after = stages[3]
    clean = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        assert clean[r.doc_id].n_chars == len(clean[r.doc_id].text)
        assert not brute_spans(clean[r.doc_id].text)
        if not brute_spans(r.text):
            assert clean[r.doc_id].text == r.text
    assert len(clean) == before.count()


def test_packing(stages):
    before, after = stages[4]
    ids = {r.doc_id: r.text for r in before.collect()}
    own: dict = {}
    for r in after.collect():
        own.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    encoder = packing.fast_encoder(packing.public_tokenizers.path("byte_bpe_50k.json"))
    for doc, text in ids.items():
        n = len(encoder.encode(text, allowed_special="all")) + 1
        pieces = sorted(own[doc])
        assert sum(x[1] for x in pieces) == n and all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:]))


def test_run_is_the_registered_query(spark, stages):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][1].count()
