"""Scoring: join, classify, measure, aggregate.

Pages meet their ground truth and their sample in two left joins on (document_id, page_id). The classification runs
before any text or geometry, so only scored pages reach the expensive projection. Each observation is a row of a
long table (category, metric, value, num, den, n); every number of the report is one GROUPING SETS aggregate of it.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calibration as cal
from ..functions import fields as fld
from ..functions import geometry as geo
from ..functions import text as txt
from ..session import discard, written
from ..sources.schemas import METRICS

KEYS = ["document_id", "page_id"]
EXTRACTION_KEYS = ["document_id", "schema_name", "schema_version"]
OBSERVATION = "struct<metric: string, value: double, num: double, den: double, n: bigint>"
#: Messages of failures without one of their own.
MESSAGES = {
    "ground_truth_missing": "manifest page has no ground-truth page",
    "missing": "prediction sample was not supplied",
    "invalid": "prediction page metadata does not match the manifest",
}
COUNTERS = ("scored", "missing", "crashed", "timeout", "invalid", "ground_truth_missing")


def last_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the last one by order."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_w")).select(*keys, "_w.*")


def classify(manifest: DataFrame, truth: DataFrame, samples: DataFrame) -> DataFrame:
    """Manifest pages with ``truth`` and ``sample`` (structs or null), ``outcome`` and ``message``.

    manifest: document_id, page_id, page_index, checksum, category, doc_pos, page_pos; truth and samples have
    KEYS and a struct column ``truth`` or ``sample``.
    """
    rows = manifest.join(truth.select(*KEYS, "truth"), KEYS, "left").join(samples.select(*KEYS, "sample"), KEYS, "left")
    page = F.col("sample.page")
    same = page.isNotNull() & (page.page_id == F.col("page_id")) & (page.page_index == F.col("page_index")) & page.checksum.eqNullSafe(F.col("checksum"))
    status = F.col("sample.status")
    outcome = (
        F.when(F.col("truth").isNull(), "ground_truth_missing")
        .when(F.col("sample").isNull() | (status == "missing"), "missing")
        .when(status.isin("crashed", "timeout"), status)
        .when(~F.coalesce(same, F.lit(False)), "invalid")
        .otherwise("scored")
    )
    own = F.coalesce(F.col("sample.error.message"), status)
    fixed = reduce(lambda c, kv: c.when(F.col("outcome") == kv[0], kv[1]), MESSAGES.items(), F.when(F.col("outcome").isin("crashed", "timeout"), own))
    return rows.withColumn("outcome", outcome).withColumn("message", fixed)


def outcomes(classified: DataFrame) -> DataFrame:
    """The classified pages without their contents: what counters, failures and measurements read.

    The joins below then move keys, checksums and numbers only, as Parquet scans read no other field.
    """
    return classified.select(*KEYS, "category", "doc_pos", "page_pos", "outcome", "message", F.col("sample.runtime_ms").alias("runtime_ms"), F.col("sample.peak_memory_mb").alias("peak_memory_mb"))


def failures(classified: DataFrame) -> DataFrame:
    """document_id, page_id, status, message of the pages not scored, in manifest order."""
    rows = classified.where("outcome <> 'scored'").orderBy("doc_pos", "page_pos")
    return rows.select(*KEYS, F.col("outcome").alias("status"), "message")


def summaries(classified: DataFrame) -> DataFrame:
    """Counters for each category, and for all (category null)."""
    counts = [F.count(F.lit(1)).alias("total_pages"), *[F.count_if(F.col("outcome") == c).alias(f"{c}_pages") for c in COUNTERS]]
    return classified.rollup("category").agg(F.grouping("category").alias("is_total"), *counts)


def _observed(metric: str, value: Column, num: Column, den: Column, n: Column, when: Column | None = None) -> Column:
    row = F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"), num.cast("double").alias("num"), den.cast("double").alias("den"), n.cast("bigint").alias("n"))
    return row if when is None else F.when(when, row)


def _lean(blocks: Column, composed: Column) -> Column:
    """Blocks with only what metrics read, and with composed texts; a Parquet scan skips the rest.

    composed: for each block its equation text and its lines' texts.
    """
    def block(b: Column, i: Column) -> Column:
        texts = F.get(composed, i)
        lines = F.transform(F.coalesce(b.lines, F.array()), lambda x, j: F.struct(F.get(texts, j + 1).alias("normalized_text"), x.reading_order_index.alias("reading_order_index")))
        cells = F.transform(b.table.cells, lambda c: F.struct(c.row_index.alias("row_index"), c.column_index.alias("column_index"), c.row_span.alias("row_span"), c.column_span.alias("column_span")))
        return F.struct(
            b.block_id.alias("block_id"), b.block_type.alias("block_type"), b.bbox.alias("bbox"), b.reading_order_index.alias("reading_order_index"), b.confidence.score.alias("score"),
            F.get(texts, F.lit(0)).alias("equation_text"), lines.alias("lines"),
            F.when(b.table.isNotNull(), F.struct(b.table.rows.alias("rows"), b.table.columns.alias("columns"), cells.alias("cells"))).alias("table"),
        )

    return F.transform(blocks, block)


def _with_texts(pages: DataFrame, side: str, blocks: Column) -> DataFrame:
    """{side}_blocks, lean and composed, {side}_text, and texts of blocks and equations, normalised."""
    raw = F.transform(blocks, lambda b: F.concat(F.array(b.equation_text), F.transform(F.coalesce(b.lines, F.array()), lambda x: x.normalized_text)))
    own = F.col(f"{side}_blocks")
    rows = pages.withColumn(f"{side}_raw", raw).withColumn(f"{side}_nfc", txt.nfc_nested(F.col(f"{side}_raw"))).drop(f"{side}_raw")
    return rows.withColumn(f"{side}_blocks", _lean(blocks, F.col(f"{side}_nfc"))).withColumns({
        f"{side}_text": txt.line_ends(geo.page_text(own)),
        f"{side}_block_texts": F.transform(own, lambda b: txt.line_ends(geo.block_text(b))),
        f"{side}_equation_texts": F.transform(own, lambda b: txt.line_ends(geo.block_text(b, True))),
    }).drop(f"{side}_nfc")


def _equations(side: str) -> Column:
    pairs = F.arrays_zip(F.col(f"{side}_blocks").alias("b"), F.col(f"{side}_equation_texts").alias("t"))
    return F.transform(F.filter(pairs, lambda p: p.b.block_type == "equation"), lambda p: F.struct(p.b.bbox.alias("bbox"), p.t.alias("text")))


def page_observations(scored: DataFrame) -> DataFrame:
    """Long table of scored pages (``category``, ``truth``, ``sample``).

    Spark doesn't merge equal higher-order expressions, so each costly intermediate is a column of its own and the
    last projection only reads columns.
    """
    pages = scored.select(*KEYS, "category", F.col("truth.blocks").alias("t"), F.col("sample.page.blocks").alias("s"))
    pages = _with_texts(_with_texts(pages, "r", F.col("t")), "h", F.col("s")).drop("t", "s")
    r, h, rt, ht = map(F.col, ("r_blocks", "h_blocks", "r_text", "h_text"))
    pages = pages.select(
        "*",
        txt.distance(rt, ht).alias("d_chars"),
        txt.words(rt).alias("r_words"),
        txt.words(ht).alias("h_words"),
        geo.ordered_boxes(r).alias("r_order"),
        geo.ordered_boxes(h).alias("h_order"),
        F.filter(r, lambda b: (b.block_type == "table") & b.table.isNotNull()).alias("r_tables"),
        geo.of_types(h, "table").alias("h_tables"),
        _equations("r").alias("r_equations"),
        _equations("h").alias("h_equations"),
    )
    # all matching in one projection: Python gets a batch of pages once
    r_order, h_order = F.col("r_order"), F.col("h_order")
    pages = pages.select(
        "*",
        geo.greedy_match(geo.boxes(r), geo.boxes(h)).alias("matches"),
        geo.partner_orders(r_order, h_order, geo.greedy_match(geo.boxes(r_order), geo.boxes(h_order))).alias("orders"),
        geo.diagram_counts(r, h).alias("diagrams"),
        geo.equation_page_score(F.col("r_equations"), F.col("h_equations")).alias("equations"),
        geo.table_page_score(F.col("r_tables"), F.col("h_tables")).alias("tables"),
    ).drop("r_order", "h_order")
    # of equal hypothesis ids the last match counts for all of them
    pairs = F.transform(F.filter(F.transform(F.col("matches"), lambda m, i: F.struct(i.alias("r"), m.h.alias("h"), m.iou.alias("iou"))), lambda m: m.h.isNotNull()), lambda m: F.struct(m.r.alias("r"), m.iou.alias("iou"), F.get(h, m.h).block_id.alias("id")))
    pages = pages.withColumn("pairs", F.reverse(pairs))

    def outcome(b: Column, i: Column) -> Column:
        m = F.get(F.filter("pairs", lambda p: p.id == b.block_id), 0)
        right = (m.iou >= 0.5) & (F.get(r, m.r).block_type == b.block_type) & (F.get("r_block_texts", m.r) == F.get("h_block_texts", i))
        return F.coalesce(right, F.lit(False)).cast("int")

    pages = pages.select(
        "*",
        txt.sequence_distance(F.col("r_words"), F.col("h_words")).alias("d_words"),
        txt.sequence_distance(F.col("orders.reference"), F.col("orders.hypothesis")).alias("d_order"),
        geo.layout(r, h, F.col("matches")).alias("layout"),
        F.transform(h, outcome).alias("outcomes"),
        F.transform(h, lambda b: b.score).alias("scores"),
        F.size(F.array_distinct(F.transform("pairs", lambda p: p.id))).alias("known_ids"),
    )
    pages = pages.select(
        "*",
        cal.brier(F.col("outcomes"), F.col("scores")).alias("brier"),
        cal.calibration_error(F.col("outcomes"), F.col("scores")).alias("ece"),
        cal.error_auroc(F.col("outcomes"), F.col("scores")).alias("auroc"),
    )
    one = F.lit(1)
    chars, word_count, H = F.greatest(F.char_length(rt), one), F.greatest(F.size("r_words"), one), F.size(h)
    units = F.greatest(F.char_length(rt), F.char_length(ht), one)
    order_units = F.greatest(F.size("orders.reference"), F.size("orders.hypothesis"), one)
    lay, both = F.col("layout"), F.size(r) + F.size(h)
    N, d = lay.block_count, F.col("diagrams")
    any_blocks, any_diagrams = N > 0, d.reference + d.hypothesis > 0
    exact_digits = txt.digit_exact(rt, ht)
    n_eq, n_tab = F.size("r_equations"), F.size("r_tables")
    wrong = H - F.col("known_ids")
    found = F.array(
        _observed("cer", F.col("d_chars") / chars, F.col("d_chars"), chars, one),
        _observed("wer", F.col("d_words") / word_count, F.col("d_words"), word_count, one),
        _observed("normalized_edit_similarity", 1 - F.col("d_chars") / units, units - F.col("d_chars"), units, one),
        _observed("reading_order_sequence_score", 1 - F.col("d_order") / order_units, order_units - F.col("d_order"), order_units, one),
        _observed("digit_exact_accuracy", exact_digits, exact_digits, one, one, txt.has_digit(rt)),
        _observed("block_type_accuracy", lay.correct_type / N, lay.correct_type, N, N, any_blocks),
        _observed("layout_bbox_iou", lay.iou / N, lay.iou, N, N, any_blocks),
        _observed("layout_match_f1", 2 * lay.matched / both, 2 * lay.matched, both, N, any_blocks),
        _observed("equation_text_similarity", F.col("equations"), F.col("equations") * n_eq, n_eq, n_eq, F.col("equations").isNotNull()),
        _observed("table_structure_similarity", F.col("tables"), F.col("tables") * n_tab, n_tab, n_tab, F.col("tables").isNotNull()),
        *[_observed(name, F.col(c), F.col(c) * H, H, H, F.col(c).isNotNull()) for name, c in (("confidence_brier", "brier"), ("confidence_ece", "ece"), ("error_detection_auroc", "auroc"))],
        _observed("hallucinated_block_rate", wrong / F.greatest(H, one), wrong, F.greatest(H, one), H),
        _observed("diagram_detection_f1", 2 * d.matched / (d.reference + d.hypothesis), 2 * d.matched, d.reference + d.hypothesis, d.reference, any_diagrams),
    )
    return pages.select(*KEYS, "category", F.explode(F.array_compact(found)).alias("o")).select(*KEYS, "category", "o.*")


def performance_observations(pages: DataFrame) -> DataFrame:
    """Runtime and memory of every sample that was given, scored or not, from ``outcomes``."""
    measured = pages.where("outcome NOT IN ('missing', 'ground_truth_missing')")
    found = F.array(*[_observed(m, F.col(m), F.col(m), F.lit(1), F.lit(1), F.col(m).isNotNull()) for m in ("runtime_ms", "peak_memory_mb")])
    return measured.select(*KEYS, "category", F.explode(F.array_compact(found)).alias("o")).select(*KEYS, "category", "o.*")


def scored_extractions(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Full outer join of extractions (EXTRACTION_KEYS, fields) with their scores.

    Without a reference all fields are made up; without a prediction none are found.
    """
    nothing = F.array().cast(truth.schema["fields"].dataType)
    both = truth.select(*EXTRACTION_KEYS, F.col("fields").alias("r")).join(predicted.select(*EXTRACTION_KEYS, F.col("fields").alias("h")), EXTRACTION_KEYS, "full")
    return both.select(*EXTRACTION_KEYS, fld.field_scores(F.coalesce("r", nothing), F.coalesce("h", nothing)).alias("s"))


def extraction_observations(truth: DataFrame, predicted: DataFrame, categories: DataFrame) -> DataFrame:
    """Long table of extractions; categories: document_id, category."""
    s = F.col("s")
    n = F.greatest(s.n_reference, F.lit(1))
    names = {
        "structured_field_precision": s.precision, "structured_field_recall": s.recall, "structured_field_f1": s.f1, "structured_field_exact_accuracy": s.exact_accuracy,
        "structured_field_coordinate_iou": s.coordinate_iou, "structured_hallucination_rate": s.hallucination_rate,
    }
    found = F.array(*[_observed(m, v, v, F.lit(1), n) for m, v in names.items()], _observed("financial_value_accuracy", s.financial_accuracy, s.financial_accuracy, F.lit(1), s.n_financial, s.n_financial > 0))
    rows = scored_extractions(truth, predicted).join(categories, "document_id")
    return rows.select("document_id", F.lit(None).cast("string").alias("page_id"), "category", F.explode(F.array_compact(found)).alias("o")).select(*KEYS, "category", "o.*")


def aggregate(observations: DataFrame) -> DataFrame:
    """category (null: all), is_total, metric, micro, macro, sample_count, in one pass."""
    numbers = [(F.sum("num") / F.greatest(F.sum("den"), F.lit(1.0))).alias("micro"), F.avg("value").alias("macro"), F.sum("n").alias("sample_count")]
    grouped = observations.groupingSets([[F.col("metric"), F.col("category")], [F.col("metric")]], F.col("metric"), F.col("category"))
    return grouped.agg(F.grouping("category").alias("is_total"), *numbers)


def metric_table(aggregated: DataFrame, groups: DataFrame) -> DataFrame:
    """All metrics in their order for each group (category, is_total); quality metrics without a value are 0."""
    spark = aggregated.sparkSession
    spec = spark.createDataFrame(pa.table({"position": list(range(len(METRICS))), "metric": [m.name for m in METRICS], "unit": [m.unit for m in METRICS], "higher_is_better": [m.higher_is_better for m in METRICS], "optional": [m.optional for m in METRICS]}))
    # 24 rows of specification: bounded
    wanted = groups.select("category", "is_total").distinct().join(F.broadcast(spec))
    on = wanted.category.eqNullSafe(aggregated.category) & (wanted.is_total == aggregated.is_total) & (wanted.metric == aggregated.metric)
    full = wanted.join(aggregated, on, "left").select(
        wanted.category, wanted.is_total, "position", wanted.metric, "unit", "higher_is_better", "optional",
        F.coalesce("micro", F.lit(0.0)).alias("micro"), F.coalesce("macro", F.lit(0.0)).alias("macro"), F.coalesce("sample_count", F.lit(0)).cast("bigint").alias("sample_count"),
        aggregated.metric.isNotNull().alias("seen"),
    )
    return full.where("seen OR NOT optional").drop("seen", "optional")


class Scored:
    """The tables of a report: observations, summary, metrics, failures.

    store: write the outcomes to the shared folder once, so that only the page metrics read pages again; ``close``
    deletes them when the tables have been used.
    """

    def __init__(self, manifest: DataFrame, truth: DataFrame, samples: DataFrame, truth_extractions: DataFrame | None = None, extractions: DataFrame | None = None, store: bool = False):
        classified = classify(manifest, truth, samples)
        self.pages, self._path = written(outcomes(classified), "outcomes") if store else (outcomes(classified), None)
        observed = page_observations(classified.where("outcome = 'scored'")).unionByName(performance_observations(self.pages))
        if truth_extractions is not None and extractions is not None:
            categories = manifest.groupBy("document_id").agg(F.min("category").alias("category"))
            observed = observed.unionByName(extraction_observations(truth_extractions, extractions, categories))
        self.observations = observed
        self.summary = summaries(self.pages)
        self.failures = failures(self.pages)
        self.metrics = metric_table(aggregate(observed), self.summary)

    def close(self) -> None:
        if self._path:
            discard(self.pages.sparkSession, self._path)
            self._path = None
