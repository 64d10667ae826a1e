"""Toxicity grades by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(t_k - w.x): ordered thresholds t_1 < t_2 < ... share one weight vector w over sparse
features. A feature is a word or a word start (of PREFIXES letters: inflected and compound words share it), its value
log(1 + occurrences in a hundred words). The model gives P(grade >= 1), and the expected severity, the sum of
P(grade >= k).

Training uses a sample of at most SAMPLE labelled rows a class (documented bound, taken in the order of a hash
of doc_id, copies counting once). Labels tell toxic from not; the grades 1 to 3 of toxic texts are thirds by the
mass of features that mark toxic texts. Features enter the model if their mean among toxic texts differs from
that among the others by MIN_Z standard errors, so a long text gathers no noise; that is computed by Spark. At most
MAX_FEATURES enter: the model is bounded and travels with the tasks. Scoring reads every whole text.

Edge cases: null and empty texts have no features and the severity of the base rate. Without labelled rows of both
classes nothing is toxic (severity 0). A doc_id with several labels counts as toxic if one of them says so; null
labels are not used; of a doc_id with several texts the first in order is learned from, so that the sample stays
bounded. Repeated rows get equal rows, an empty table none. Very long texts are read whole. Other columns, whatever their names,
are ignored by ``grade`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, documents, map_batches, stored

SAMPLE = 4_000
MAX_FEATURES = 4_096
MIN_Z = 5.0
MIN_TEXTS = 5
GRADES = 3
LIMIT = 0.5
PREFIXES = (4, 6)
_WORD = re.compile(r"\w+")


def counted(text: str | None) -> tuple[Counter, int]:
    """Lower-cased words and their number, 50 at least, so that one word in a tiny text isn't a flood."""
    words = _WORD.findall((text or "").lower())
    return Counter(words), max(len(words), 50)


def features(text: str | None) -> dict[str, float]:
    """All features: ``w:word``, ``4:start``, ``6:start``."""
    words, n = counted(text)
    out: Counter = Counter()
    for w, c in words.items():
        out["w:" + w] += c
        for k in PREFIXES:
            if len(w) > k:
                out[f"{k}:{w[:k]}"] += c
    return {f: float(np.log1p(100 * c / n)) for f, c in out.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    @functools.cached_property
    def _tables(self) -> tuple[dict, list[tuple[int, dict]]]:
        def of(kind: str) -> dict[str, str]:
            return {f[2:]: f for f in self.weights if f.startswith(kind)}

        return of("w:"), [(k, of(f"{k}:")) for k in PREFIXES]

    def values(self, text: str | None) -> dict[str, float]:
        """The model's own features of a text."""
        words, n = counted(text)
        whole, starts = self._tables
        out: Counter = Counter()
        for w in words.keys() & whole.keys():
            out[whole[w]] += words[w]
        for k, table in starts:
            for w, c in words.items():
                if len(w) > k and (f := table.get(w[:k])):
                    out[f] += c
        return {f: float(np.log1p(100 * c / n)) for f, c in sorted(out.items())}  # sorted: the same sums everywhere

    def above(self, text: str | None) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        score = sum(self.weights[f] * x for f, x in self.values(text).items())
        return [float(_sigmoid(np.float64(score - t))) for t in self.thresholds]


#: Nothing is toxic.
EMPTY = OrdinalModel({}, (40.0,) * GRADES)


def fit(rows: list[dict[str, float]], toxic: np.ndarray, marks: dict[str, float], ridge: float = 1e-3, steps: int = 600) -> OrdinalModel:
    """Maximum likelihood with a ridge, by accelerated gradient descent on the mean loss.

    marks: the model's features, with the sign that tells which class they mark.
    """
    if not len(toxic) or not toxic.any() or toxic.all() or not marks:
        return EMPTY
    column = {f: i for i, f in enumerate(marks)}
    count = np.fromiter(map(len, rows), np.int64, len(rows))
    at = np.fromiter((column[f] for r in rows for f in r), np.int64, int(count.sum()))
    x = np.fromiter((v for r in rows for v in r.values()), np.float64, len(at))
    row = np.repeat(np.arange(len(rows)), count)
    n, m = len(rows), len(column)
    sign = np.fromiter((z > 0 for z in marks.values()), bool, m)
    mass = np.bincount(row, weights=x * sign[at], minlength=n)
    edges = np.quantile(mass[toxic], np.arange(1, GRADES) / GRADES)
    y = np.where(toxic, 1 + np.searchsorted(edges, mass, side="right"), 0)
    share = np.array([np.clip((y >= k).mean(), 1e-4, 1 - 1e-4) for k in range(1, GRADES + 1)])
    theta = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(GRADES))
    state = np.concatenate([np.zeros(m), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])  # thresholds stay ordered
    v = np.ones(m)
    for _ in range(30):  # the largest eigenvalue of the features' second moments bounds the curvature
        v /= np.linalg.norm(v)
        v = np.bincount(at, weights=x * np.bincount(row, weights=x * v[at], minlength=n)[row], minlength=m) / n + 1e-12
    rate = 1.0 / (0.5 * (np.linalg.norm(v) + 2.0))

    def unpack(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return s[:m], np.cumsum(np.concatenate([s[m : m + 1], np.exp(s[m + 1 :])]))

    def slope(s: np.ndarray) -> np.ndarray:
        w, t = unpack(s)
        score = np.bincount(row, weights=x * w[at], minlength=n)
        low = np.concatenate([[-np.inf], t])[y]  # the thresholds below and above the grade
        high = np.concatenate([t, [np.inf]])[y]
        a, b = _sigmoid(high - score), np.where(y > 0, _sigmoid(low - score), 0.0)
        a = np.where(y < GRADES, a, 1.0)
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        up = np.bincount(y, weights=da / n, minlength=GRADES + 1)
        down = np.bincount(y, weights=db / n, minlength=GRADES + 1)
        own = down[1:] - up[:GRADES]  # t_k is above grade k - 1 and below grade k
        tail = np.cumsum(own[::-1])[::-1]
        g_theta = np.concatenate([tail[:1], tail[1:] * np.exp(s[m + 1 :])])
        return np.concatenate([np.bincount(at, weights=x * ((da - db) / n)[row], minlength=m) + ridge * w, g_theta])

    ahead, before = state.copy(), state
    for k in range(steps):
        now = ahead - rate * slope(ahead)
        ahead = now + k / (k + 3) * (now - before)
        before = now
    w, t = unpack(before)
    return OrdinalModel({f: float(w[i]) for f, i in column.items()}, tuple(map(float, t)))


def _exploded(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {"toxic": [], "feature": [], "x": []}
    for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        own = features(text)
        out["toxic"] += [toxic] * len(own)
        out["feature"] += own
        out["x"] += own.values()
    return out


def _rows(batch: pa.RecordBatch, model: OrdinalModel) -> dict:
    own = [model.values(t) for t in batch.column(1).to_pylist()]
    return {"toxic": batch.column(0), "feature": [list(o) for o in own], "x": [list(o.values()) for o in own]}


def marking_features(sample: DataFrame, n_toxic: int, n_other: int) -> dict[str, float]:
    """Features whose mean differs between the classes, with the z of the difference."""
    each = map_batches(sample, _exploded, "toxic boolean, feature string, x double")

    def total(of, toxic: bool):
        return F.sum(F.when(F.col("toxic") == toxic, of).otherwise(0.0))

    sums = each.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), total(F.col("x"), True).alias("a"), total(F.col("x"), False).alias("b"), F.sum(F.col("x") * F.col("x")).alias("q")).where(F.col("n") >= MIN_TEXTS)
    n = n_toxic + n_other
    spread = F.col("q") / n - F.pow((F.col("a") + F.col("b")) / n, F.lit(2))
    z = (F.col("a") / n_toxic - F.col("b") / n_other) / F.sqrt(F.greatest(spread, F.lit(1e-9)) * (1 / n_toxic + 1 / n_other))
    top = sums.select("feature", z.alias("z")).where(F.abs("z") >= MIN_Z).orderBy(F.abs("z").desc(), "feature").limit(MAX_FEATURES)
    return {r[0]: r[1] for r in top.collect()}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents of either class."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [one.where(f"toxic {c} 0").orderBy(*order).limit(sample) for c in ("<>", "=")]
    # 2 x sample rows at most, so the labels may be broadcast
    # one text for each doc_id keeps the bound where doc_ids are repeated
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).select((F.col("toxic") != 0).alias("toxic"), "text").dropDuplicates()
    rows, path = stored(chosen, "labelled")
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    model = EMPTY
    if len(sizes) == 2:
        marks = marking_features(rows, sizes[True], sizes[False])
        table = map_batches(rows, functools.partial(_rows, model=OrdinalModel(marks, ())), "toxic boolean, feature array<string>, x array<double>").toArrow()
        own = sorted((tuple(f), tuple(x), t) for f, x, t in zip(table["feature"].to_pylist(), table["x"].to_pylist(), table["toxic"].to_pylist(), strict=True))
        model = fit([dict(zip(f, x, strict=True)) for f, x, _ in own], np.array([t for *_, t in own], bool), marks)
    discard(docs.sparkSession, path)
    return model


def _grade(batch: pa.RecordBatch, model: OrdinalModel, limit: float) -> dict:
    above = [model.above(t) for t in batch.column(1).to_pylist()]
    toxic = [p[0] >= limit for p in above]
    return {
        "doc_id": batch.column(0), "severity": [sum(p) for p in above], "p_toxic": [p[0] for p in above],
        "grade": [sum(x >= 0.5 for x in p) for p in above], "toxic": toxic, "kept": [not t for t in toxic],
    }


def grade(docs: DataFrame, model: OrdinalModel, limit: float = LIMIT) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade, toxic, kept of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, functools.partial(_grade, model=model, limit=limit), "doc_id long, severity double, p_toxic double, grade int, toxic boolean, kept boolean")


def _keep(batch: pa.RecordBatch, model: OrdinalModel, limit: float) -> pa.RecordBatch:
    texts = batch.column(batch.schema.names.index("text")).to_pylist()
    return batch.filter(pa.array([model.above(t)[0] < limit for t in texts], pa.bool_()))


def keep_clean(docs: DataFrame, model: OrdinalModel, limit: float = LIMIT) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns."""
    return map_batches(docs, functools.partial(_keep, model=model, limit=limit), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return grade(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
