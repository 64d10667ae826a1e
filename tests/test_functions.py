"""Hand-computed values, and a plain-Python oracle written from the definitions, fuzzed against the expressions."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioscore.functions import calibration as cal
from folioscore.functions import fields as fld
from folioscore.functions import geometry as geo
from folioscore.functions import text as txt

BOX = "struct<x: double, y: double, width: double, height: double>"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_normal(t):
    return unicodedata.normalize("NFC", t).replace("\r\n", "\n").replace("\r", "\n")


def test_known_text_values(spark):
    row = spark.createDataFrame([("abc", "adc")], "r string, h string").select(
        txt.character_error_rate(F.col("r"), F.col("h")).alias("cer"), txt.edit_similarity(F.col("r"), F.col("h")).alias("nes"), txt.word_error_rate(F.lit("one two three"), F.lit("one too three")).alias("wer"),
        txt.order_score(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("a"), F.lit("c"))).alias("order"),
    ).first()
    assert (row.cer, row.nes, row.wer, row.order) == pytest.approx((1 / 3, 2 / 3, 1 / 3, 2 / 3))


def test_normalisation_keeps_marks_and_directions(spark):
    text = "a\r\nb\rc é ‮ مَ"
    got = spark.createDataFrame([(text,)], "t string").select(txt.normalize(F.col("t"))).first()[0]
    assert got == plain_normal(text)
    assert "‮" in got and "é" in got and "\r" not in got


def test_digits_of_all_scripts(spark):
    rows = [("page ١٢", "page 12"), ("x 7", "x 8"), ("", "none"), ("\U0001d7d9", "1")]
    got = spark.createDataFrame(rows, "r string, h string").select(txt.digit_exact(F.col("r"), F.col("h")), txt.has_digit(F.col("r"))).collect()
    assert [tuple(g) for g in got] == [(1.0, True), (0.0, True), (1.0, False), (1.0, True)]


def test_text_fuzz(spark):
    rnd = random.Random(5)
    alphabet = ["a", "b", " ", "\r", "\n", "é", "é", "٣", "7", "\x1d", " ", "𝔸", "word"]
    rows = [tuple("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(25))) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "r string, h string").select("r", "h", txt.normalize(F.col("r")).alias("rn"), txt.normalize(F.col("h")).alias("hn"))
    got = df.select("r", "h", F.levenshtein("rn", "hn"), txt.words(F.col("rn")), txt.sequence_distance(txt.words(F.col("rn")), txt.words(F.col("hn"))), txt.digits(F.col("rn"))).collect()
    for r, h, d, words, dw, digits in got:
        r, h = plain_normal(r), plain_normal(h)
        assert d == plain_distance(r, h) and words == r.split() and dw == plain_distance(r.split(), h.split())
        assert digits == "".join(str(unicodedata.decimal(c)) for c in r if c.isdecimal())


@pytest.mark.parametrize("bands", [(1, 3, 7), txt.BANDS])
def test_banded_distance_is_the_distance(spark, monkeypatch, bands):
    monkeypatch.setattr(txt, "BANDS", bands)
    rnd = random.Random(11)
    rows = [("", ""), ("", "ab"), ("ab", ""), (None, "a"), ("a", None), ("a" * 300, "b" * 300), ("ab" * 150, "ba" * 150)]
    for n in [rnd.randrange(30) for _ in range(150)] + [400] * 12:
        text = [rnd.choice("abcé\U0001d538") for _ in range(n)]
        other = text[rnd.randrange(3) :]
        for _ in range(rnd.choice([0, 1, 3, n // 8, n])):  # edits at both sides of the bands' limits
            at = rnd.randrange(len(other) + 1)
            other[at : at + rnd.randrange(2)] = [rnd.choice("abcé")] * rnd.randrange(3)
        rows.append(("".join(text), "".join(other)))
    rows += [(b, a) for a, b in rows]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", txt.distance(F.col("a"), F.col("b"))).collect()
    for a, b, d in got:
        assert d == (None if a is None or b is None else plain_distance(a, b))


def test_long_sequences_go_through_python(spark, monkeypatch):
    monkeypatch.setattr(txt, "MAX_INTERNED", 3)
    rows = [(list("abcdef"), list("abxdefg")), (list("ab"), list("ba")), ([], list("abcd"))]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(txt.sequence_distance(F.col("a"), F.col("b"))).collect()
    assert [g[0] for g in got] == [plain_distance(a, b) for a, b in rows]


def plain_iou(a, b):
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union > 0 else 0.0


def plain_greedy(refs, hyps, least=0.1):
    used, out = set(), []
    for r in refs:
        best = max(((plain_iou(r, h), -j) for j, h in enumerate(hyps) if j not in used), default=None)
        if best and best[0] >= least:
            used.add(-best[1])
            out.append((-best[1], best[0]))
        else:
            out.append((None, 0.0))
    return out


def test_greedy_matching_fuzz(spark):
    rnd = random.Random(6)
    box = lambda: (float(rnd.randrange(5)), float(rnd.randrange(5)), float(rnd.randrange(1, 5)), float(rnd.randrange(1, 5)))
    rows = [([box() for _ in range(rnd.randrange(6))], [box() for _ in range(rnd.randrange(6))]) for _ in range(150)]
    rows.append(([(0.0, 0.0, 1.0, 1.0)], [(0.0, 0.0, 1.0, 1.0)] * 2))  # a tie: the first wins
    got = spark.createDataFrame(rows, f"r array<{BOX}>, h array<{BOX}>").select(geo.greedy_match(F.col("r"), F.col("h"))).collect()
    for (r, h), (m,) in zip(rows, got, strict=True):
        assert [(x.h, pytest.approx(x.iou)) for x in m] == plain_greedy(r, h)
    assert got[-1][0][0].h == 0


def test_minimum_iou_is_checked():
    with pytest.raises(ValueError):
        geo.greedy_match(F.col("r"), F.col("h"), 1.5)


def test_table_with_another_row_count(spark):
    table = "struct<rows: int, columns: int, cells: array<struct<row_index: int, column_index: int, row_span: int, column_span: int>>>"
    cells = [(0, 0, 1, 1), (0, 1, 1, 1)]
    got = spark.createDataFrame([((1, 2, cells), (2, 2, cells)), ((1, 2, cells), None), ((1, 2, cells), (1, 2, cells))], f"a {table}, b {table}").select(geo.table_similarity(F.col("a"), F.col("b"))).collect()
    assert [g[0] for g in got] == [0.5, 0.0, 1.0]


def test_reading_order_of_tied_and_repeated_ids(spark):
    block = f"array<struct<block_id: string, bbox: {BOX}, reading_order_index: int>>"
    a, b = (0.0, 0.0, 1.0, 1.0), (5.0, 0.0, 1.0, 1.0)
    rows = [([("x", a, 0), ("y", b, 1)], [("p", b, 1), ("q", a, 0)]), ([("x", a, 0), ("y", b, 0)], [("p", a, 0), ("p", b, 0)]), ([], [("p", a, 0)])]
    got = [g[0] for g in spark.createDataFrame(rows, f"r {block}, h {block}").select(geo.comparable_orders(F.col("r"), F.col("h"))).collect()]
    assert (got[0].reference, got[0].hypothesis) == (["x", "y"], ["x", "y"])
    assert got[1].hypothesis == ["y", "y"]
    assert (got[2].reference, got[2].hypothesis) == ([], ["unmatched:0"])


def test_calibration_values_and_edges(spark):
    rows = [([1, 0], [0.8, 0.2]), ([], []), ([1, 1], [0.5, 0.5]), ([0, 1, 0], [0.3, 0.3, 0.1])]
    got = spark.createDataFrame(rows, "o array<int>, c array<double>").select(cal.brier(F.col("o"), F.col("c")), cal.calibration_error(F.col("o"), F.col("c"), 2), cal.error_auroc(F.col("o"), F.col("c"))).collect()
    assert tuple(got[0]) == pytest.approx((0.04, 0.2, 1.0))
    assert tuple(got[1]) == (None, None, None)
    assert got[2][2] is None
    assert got[3][2] == pytest.approx(0.75)
    edge = spark.createDataFrame([(0.8999999999999999,), (0.9,), (1.0,), (0.0,)], "c double").select(cal.bin_of(F.col("c"))).collect()
    assert [e[0] for e in edge] == [8, 9, 9, 0]
    with pytest.raises(ValueError):
        cal.bin_of(F.lit(0.5), 0)


def test_field_scores(spark):
    field = f"array<struct<field_name: string, normalized_value: string, bbox: {BOX}>>"
    box = (0.0, 0.0, 1.0, 1.0)
    rows = [
        ([("total_ttc", "10", box), ("name", "A", box)], [("total_ttc", "11", box), ("name", "A", box), ("extra", "z", None)]),
        ([("flight_number", "1", None)], []),
        ([], [("x", "1", None)]),
        ([("a", "1", box), ("a", "2", None)], [("a", "1", None), ("a", "2", box)]),
    ]
    got = [g[0] for g in spark.createDataFrame(rows, f"r {field}, h {field}").select(fld.field_scores(F.col("r"), F.col("h"))).collect()]
    s = got[0]
    assert (s.precision, s.recall, s.exact_accuracy, s.hallucination_rate, s.coordinate_iou, s.financial_accuracy) == pytest.approx((1 / 3, 1 / 2, 1 / 2, 1 / 3, 1.0, 0.0))
    assert (got[1].n_financial, got[1].recall) == (0, 0.0)
    assert (got[2].precision, got[2].hallucination_rate) == (0.0, 1.0)
    assert (got[3].recall, got[3].coordinate_iou) == (1.0, 0.0)


@pytest.mark.parametrize(("name", "amount"), [("total_ht", True), ("shipping_weight", False), ("flight_number", False), ("lines[0].quantity", True), ("TVA", True)])
def test_names_of_amounts(spark, name, amount):
    assert spark.range(1).select(fld.is_financial(F.lit(name))).first()[0] is amount


def test_block_text_rules(spark):
    block = "struct<equation_text: string, lines: array<struct<normalized_text: string>>>"
    rows = [(("", [("a",), ("b",)]),), ((None, [("a",)]),), (("e", []),)]
    got = spark.createDataFrame(rows, f"b {block}").select(geo.block_text(F.col("b")), geo.block_text(F.col("b"), True)).collect()
    assert [tuple(g) for g in got] == [("a\nb", ""), ("a", "a"), ("e", "e")]


@pytest.mark.parametrize("limit", [3, 65_536])
def test_batches_of_pages_are_matched_like_single_pages(monkeypatch, limit):
    pa = pytest.importorskip("pyarrow")
    monkeypatch.setattr(geo, "MAX_BOXES", limit)
    rnd = random.Random(5)
    page = lambda: None if rnd.random() < 0.05 else [(float(rnd.randint(0, 6)), float(rnd.randint(0, 3)), float(rnd.randint(0, 4)), float(rnd.randint(0, 4))) for _ in range(rnd.choice([0, 1, 2, 5, 12]))]
    flat = lambda pages: pa.array([None if p is None else [v for b in p for v in b] for p in pages], pa.list_(pa.float64()))
    r, h = [page() for _ in range(300)], [page() for _ in range(300)]
    for least in (0.0, 0.1, 1.0):
        got = geo.match_pages(flat(r), flat(h), least).slice(7).to_pylist()
        for m, x, y in list(zip(got, r[7:], h[7:], strict=True)):
            assert m is None if x is None else [(v["h"], pytest.approx(v["iou"])) for v in m] == plain_greedy(x, y or [], least)
    assert len(geo.match_pages(flat([]), flat([]), 0.1)) == 0


def test_like_texts_are_compared_by_diagonals():
    rnd = random.Random(6)
    for _ in range(300):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40)))
        b = "".join(rnd.choice("abc") if rnd.random() < 0.1 else c * rnd.choice([1, 1, 1, 1, 0, 2]) for c in a)
        want = plain_distance(a, b)
        assert txt.edits(a, b) == want
        assert [txt.near_edits(a, b, most) for most in (want - 1, want, want + 3)] == [None, want, want]


def test_matching_and_long_texts_leave_the_interpreted_plan(spark):
    block = f"array<struct<block_id: string, bbox: {BOX}, reading_order_index: int>>"
    rows = spark.createDataFrame([([], [], "a", "b")], f"r {block}, h {block}, a string, b string")
    for column, name in ((geo.comparable_orders(F.col("r"), F.col("h")), "matches"), (txt.distance(F.col("a"), F.col("b")), "_text_distance")):
        plan = rows.select(column.alias("o"))._jdf.queryExecution().optimizedPlan().toString()
        assert f"ArrowEvalPython [{name}(" in plan


def test_texts_that_are_composed_as_they_are_do_not_reach_python(spark):
    assert all(unicodedata.normalize("NFC", chr(c)) == chr(c) for c in range(0x300))
    texts = [[["plain", None, "caf\u00e9"]], [["e\u0301", "plain"], None], None]
    got = spark.createDataFrame([(t,) for t in texts], "t array<array<string>>").select(txt.nfc_nested(F.col("t")).alias("n"))
    assert [g.n for g in got.collect()] == [texts[0], [["\u00e9", "plain"], None], None]
    assert "_nfc_nested(CASE WHEN" in got._jdf.queryExecution().optimizedPlan().toString()
