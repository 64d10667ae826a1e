"""Synthetic corpora: text pages, exam-like scenarios, invoices. All rows come from ``range`` and hashes of
(seed, row), so that a corpus of any size is made in parallel and is the same for the same seed.

Each corpus is two DataFrames of typed artifacts (one row each would not scale): manifest pages and truth pages with the
columns that scoring reads; ``artifacts`` gathers them into JSON contracts for small ones.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geometry import grid_cells
from ..functions.text import canonical_checksum, fill_template
from . import schemas as S

WIDTH, HEIGHT = 1200, 1600

# Texts of our own.
LINES = {
    "ar": ["اقرأ السؤال بعناية ثم أجب", "اكتب الجواب في السطر رقم {code}", "اشرح خطوات الحل"],
    "fr": ["Lisez la consigne avant de répondre.", "Notez la réponse à la ligne {code}.", "Expliquez chaque étape."],
    "math": ["Calculer la somme x + {code}.", "Vérifier le résultat obtenu.", "Tracer la courbe demandée."],
    "mixed": ["Exercice {code} : تمرين", "Répondre بالعربية", "النهاية / fin"],
}
SCENARIOS = [
    # category, quality, block types of the page in order
    ("ar", "clean", ["title", "paragraph", "exercise"]),
    ("fr", "compressed", ["title", "instruction", "paragraph"]),
    ("math", "clean", ["title", "equation", "equation"]),
    ("math", "photographed", ["exercise", "equation", "diagram"]),
    ("mixed", "skewed", ["title", "table", "paragraph"]),
    ("physics", "clean", ["title", "table", "figure"]),
    ("physics", "compressed", ["exercise", "diagram", "equation"]),
    ("fr", "skewed", ["title", "paragraph", "table"]),
]
QUALITIES = ("clean", "compressed", "photographed", "skewed")
INVOICE_FIELDS = [
    # name, type, template of the value
    ("invoice_number", "identifier", "INV-{code}"), ("issue_date", "date", "2026-01-15"), ("due_date", "date", "2026-02-15"), ("currency", "string", "DZD"),
    ("seller_name", "string", "Atelier {code}"), ("seller_tax_id", "identifier", "TX{code}"), ("buyer_name", "string", "Client {code}"), ("buyer_tax_id", "identifier", "CX{code}"),
    ("lines[0].label", "string", "Papier"), ("lines[0].quantity", "decimal", "4"), ("lines[0].unit_price", "currency", "250.00"), ("lines[0].line_total", "currency", "1000.00"),
    ("lines[1].label", "string", "Encre"), ("lines[1].quantity", "decimal", "1"), ("lines[1].unit_price", "currency", "500.00"), ("lines[1].line_total", "currency", "500.00"),
    ("total_ht", "currency", "1500.00"), ("total_tva", "currency", "285.00"), ("total_ttc", "currency", "1785.00"), ("payment_terms", "string", "30 days"),
]


@dataclass(frozen=True)
class Corpus:
    """manifest: as contracts.manifest_pages; truth: document_id, page_id, truth; extractions or None; named: the extractions' fields
    as rows (document_id, field_name, value, value_type) without their boxes, confidence and provenance, or None."""

    manifest: DataFrame
    truth: DataFrame
    extractions: DataFrame | None = None
    named: DataFrame | None = None


def script_of(category: Column) -> Column:
    """(language, script, direction) of a category."""
    def tag(a: str, b: str, c: str) -> Column:
        return F.struct(F.lit(a).alias("language"), F.lit(b).alias("script"), F.lit(c).alias("direction"))

    return F.when(category == "ar", tag("ar", "arabic", "rtl")).when(category == "mixed", tag("mixed", "mixed", "mixed")).otherwise(tag("fr", "latin", "ltr"))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _checksum(**parts: Column) -> Column:
    value = canonical_checksum(parts)
    return F.struct(F.lit("sha256").alias("algorithm"), value.alias("value"), _null("bigint").alias("size_bytes"))


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in (("x", x), ("y", y), ("width", w), ("height", h))])


def _sure() -> Column:
    return F.struct(F.lit(1.0).alias("score"), F.lit(True).alias("calibrated"), F.lit("synthetic").alias("method"))


def _made() -> Column:
    return F.struct(F.lit("synthetic_generator").alias("kind"), F.lit("folioscore").alias("source"), *[_null("string").alias(n) for n in ("version", "model", "stage")], _null(S.OPEN_MAP).alias("details"))


def _line(id_: Column, text: Column, tag: Column, box: Column) -> Column:
    texts = [text.alias("raw_text"), text.alias("normalized_text"), _null("string").alias("search_text"), tag.language.alias("language"), tag.script.alias("script"), tag.direction.alias("direction"), box.alias("bbox")]
    ends = [_sure().alias("confidence"), _made().alias("provenance")]
    more = [F.array().cast(f"array<{S.ALTERNATIVE}>").alias("alternatives"), F.array().cast(f"array<{S.WARNING}>").alias("warnings")]
    span = F.struct(F.concat(id_, F.lit("-s")).alias("span_id"), *texts, *ends, *more)
    return F.struct(id_.alias("line_id"), *texts, F.lit(0).alias("reading_order_index"), *ends, F.array(span).alias("spans"), *more)


def _block(id_: Column, kind: Column, at: Column, lines: Column, equation: Column | None = None, table: Column | None = None) -> Column:
    return F.struct(
        id_.alias("block_id"), kind.alias("block_type"), _box(F.lit(80), 100 + at * 200, F.lit(1000), F.lit(160)).alias("bbox"), at.cast("int").alias("reading_order_index"),
        _sure().alias("confidence"), _made().alias("provenance"), lines.cast(f"array<{S.LINE}>").alias("lines"),
        (equation if equation is not None else _null("string")).alias("equation_text"), (table if table is not None else _null(S.TABLE)).cast(S.TABLE).alias("table"),
        F.array().cast(f"array<{S.ALTERNATIVE}>").alias("alternatives"), F.array().cast(f"array<{S.WARNING}>").alias("warnings"),
    )


def _page(blocks: Column) -> Column:
    return F.struct(
        F.col("page_id").alias("page_id"), F.col("page_index").alias("page_index"), F.col("checksum").alias("checksum"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"),
        blocks.alias("blocks"), F.transform(blocks, lambda b: b.block_id).alias("reading_order"), _made().alias("provenance"),
        F.array().cast(f"array<{S.WARNING}>").alias("warnings"), F.array().cast(f"array<{S.EVENT}>").alias("events"),
    ).cast(S.PAGE)


def _corpus(rows: DataFrame, blocks: Column) -> Corpus:
    """rows: document_id, category, split, doc_pos, page_pos, page_id, page_index, tags, checksum."""
    made = rows.withColumn("blocks", blocks)
    manifest = rows.select("document_id", "split", "category", "doc_pos", "page_pos", "page_id", "page_index", "checksum", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit("synthetic_record").alias("source_kind"), F.array_distinct("tags").alias("tags"))
    truth = made.select("document_id", "page_id", _page(F.col("blocks")).alias("truth"))
    return Corpus(manifest, truth)


def _pick(options: list[str], seed: int, *of: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(len(options))).cast("int"))


def text_corpus(spark: SparkSession, documents: int = 4, pages: int = 1, seed: int = 17) -> Corpus:
    """Pages of three lines of a random category, the numbered one among them."""
    if documents < 1 or pages < 1:
        raise ValueError("documents and pages must be positive")
    d, p = F.expr(f"id div {pages}"), F.expr(f"id % {pages}")
    rows = spark.range(documents * pages).select(F.format_string("doc-%06d", d + 1).alias("document_id"), d.cast("int").alias("doc_pos"), p.cast("int").alias("page_pos"), p.cast("int").alias("page_index"), F.lit("dev").alias("split"), F.format_string("page-%06d-%03d", d + 1, p + 1).alias("page_id"))
    rows = rows.withColumn("category", _pick(sorted(LINES), seed, F.col("doc_pos")))
    choice = F.create_map(*[x for c, ls in sorted(LINES.items()) for x in (F.lit(c), F.array(*map(F.lit, ls)))])
    code = F.format_string("%04d", F.pmod(F.xxhash64(F.lit(seed), "doc_pos", "page_pos"), F.lit(10_000)))
    texts = F.transform(F.element_at(choice, F.col("category")), lambda t: fill_template(t, code=code))
    order = F.array_sort(F.transform(texts, lambda t: F.struct(F.xxhash64(F.lit(seed), F.col("doc_pos"), F.col("page_pos"), t).alias("k"), t.alias("t"))))
    rows = rows.withColumn("texts", F.transform(order, lambda x: x.t)).withColumn("tags", F.array(F.lit("synthetic"), "category")).withColumn("checksum", _checksum(seed=F.lit(seed), page=F.col("page_id"), texts=F.col("texts")))
    tag = script_of(F.col("category"))
    blocks = F.transform("texts", lambda t, i: _block(F.concat(F.col("page_id"), F.lit("-b"), i), F.lit("paragraph"), i, F.array(_line(F.concat(F.col("page_id"), F.lit("-l"), i), t, tag, _box(F.lit(80), 100 + i * 200, F.lit(1000), F.lit(160))))))
    return _corpus(rows, blocks)


def scenario_corpus(spark: SparkSession, repeats: int = 1, seed: int = 17) -> Corpus:
    """The balanced scenario set, repeated: equations, tables, diagrams, and all scan qualities."""
    if repeats < 1:
        raise ValueError("repeats must be positive")
    n = len(SCENARIOS)
    table = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(q).alias("quality"), F.array(*map(F.lit, bs)).alias("types")) for c, q, bs in SCENARIOS])
    rows = spark.range(n * repeats).withColumn("s", F.get(table, F.expr(f"id % {n}").cast("int")))
    rows = rows.select(F.format_string("exam-%06d", F.col("id") + 1).alias("document_id"), F.col("id").cast("int").alias("doc_pos"), F.lit(0).alias("page_pos"), F.lit(0).alias("page_index"), F.lit("dev").alias("split"), F.format_string("exam-%06d-p1", F.col("id") + 1).alias("page_id"), "s.*")
    rows = rows.withColumn("tags", F.array(F.lit("synthetic"), "category", F.concat(F.lit("quality:"), "quality"), "category")).withColumn("checksum", _checksum(seed=F.lit(seed), page=F.col("page_id"), types=F.col("types")))
    tag = script_of(F.col("category"))

    def block(kind: Column, i: Column) -> Column:
        id_ = F.concat(F.col("page_id"), F.lit("-b"), i)
        text = F.concat(F.initcap(kind), F.lit(" "), F.pmod(F.xxhash64(F.lit(seed), F.col("doc_pos"), i), F.lit(1000)).cast("string"))
        cells = F.transform(grid_cells(_box(F.lit(80), 100 + i * 200, F.lit(1000), F.lit(160)), F.lit(3), F.lit(2)), lambda c: F.struct(F.concat(id_, F.lit("-c"), c.row_index, c.column_index).alias("cell_id"), c.row_index, c.column_index, c.row_span, c.column_span, c.bbox, text.alias("raw_text"), text.alias("normalized_text")))
        grid = F.when(kind == "table", F.struct(F.lit(3).alias("rows"), F.lit(2).alias("columns"), cells.alias("cells")))
        return _block(id_, kind, i, F.array(_line(F.concat(id_, F.lit("-l")), text, tag, _box(F.lit(80), 100 + i * 200, F.lit(1000), F.lit(160)))), F.when(kind == "equation", F.concat(F.lit("x^2 = "), text)), grid)

    return _corpus(rows, F.transform("types", block))


def invoice_corpus(spark: SparkSession, repeats: int = 1, seed: int = 23) -> Corpus:
    """An invoice in each scan quality, repeated, with twenty typed fields and two validations."""
    if repeats < 1:
        raise ValueError("repeats must be positive")
    n = len(QUALITIES)
    rows = spark.range(n * repeats).select(F.format_string("invoice-%06d", F.col("id") + 1).alias("document_id"), F.col("id").cast("int").alias("doc_pos"), F.lit(0).alias("page_pos"), F.lit(0).alias("page_index"), F.lit("dev").alias("split"), F.format_string("invoice-%06d-p1", F.col("id") + 1).alias("page_id"), F.lit("invoice").alias("category"), F.get(F.array(*map(F.lit, QUALITIES)), F.expr(f"id % {n}").cast("int")).alias("quality"), F.lit(f"{seed:04d}").alias("code"))
    rows = rows.withColumn("tags", F.array(F.lit("synthetic"), F.lit("invoice"), F.concat(F.lit("quality:"), "quality"))).withColumn("checksum", _checksum(seed=F.lit(seed), page=F.col("page_id")))
    given = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), fill_template(F.lit(value), code=F.col("code")).alias("value")) for name, kind, value in INVOICE_FIELDS])
    checks = F.array(*[check(r, F.lit("pass"), m) for r, m in (("lines_sum_to_ht", "line totals add up"), ("ht_plus_tva", "net and tax add up"))])
    return invoices(rows, given, checks)


def check(rule: str, status: Column, message: str) -> Column:
    return F.struct(F.lit(rule).alias("rule"), status.alias("status"), F.lit(message).alias("message"), F.lit(1.0).alias("confidence"))


def invoices(rows: DataFrame, given: Column, checks: Column) -> Corpus:
    """Invoice pages from rows of pages (see _corpus): given are (name, kind, value) in order, a block and a field each."""
    fields = F.transform(given, lambda g, i: F.struct(
        F.concat(F.col("document_id"), F.lit("-f"), i).alias("field_id"), g["name"].alias("field_name"), g["value"].alias("value"), g["value"].alias("normalized_value"), g["kind"].alias("value_type"),
        _sure().alias("confidence"), F.col("page_id").alias("page_id"), _box(F.lit(80), 100 + 60 * i, F.lit(500), F.lit(40)).alias("bbox"), _made().alias("provenance"), F.array().cast(f"array<{S.WARNING}>").alias("warnings"),
    ))
    parts = {"document_id": F.col("document_id"), "schema_name": F.lit("invoice"), "schema_version": F.lit("1.0.0"), "fields": fields, "validations": checks}
    kinds = {f.name: f.dataType for f in StructType.fromDDL(f"e {S.EXTRACTION}")["e"].dataType}
    extractions = rows.select(*[c.cast(kinds[n]).alias(n) for n, c in parts.items()])  # columns, so that a query computes only its own
    tag = script_of(F.col("category"))
    blocks = F.transform(fields, lambda f, i: _block(F.concat(F.col("page_id"), F.lit("-b"), i), F.lit("paragraph"), i, F.array(_line(F.concat(F.col("page_id"), F.lit("-l"), i), F.concat(f.field_name, F.lit(": "), f.value), tag, f.bbox))))
    # an explode takes whole elements, so rows of names and values are not taken from the extractions
    named = rows.select("document_id", F.explode(given).alias("g")).select("document_id", F.col("g")["name"].alias("field_name"), F.col("g")["value"].alias("value"), F.col("g")["kind"].alias("value_type"))
    return replace(_corpus(rows, blocks), extractions=extractions, named=named)


def with_assets(corpus: Corpus, assets: DataFrame, revision_tag: str = "image") -> Corpus:
    """Manifest and truth after rendering: each page takes its asset's checksum and size, kind image and a tag.

    assets: document_id, page_id, checksum, width, height (for example from the images' bytes, see image_checksums).
    """
    new = assets.select("document_id", "page_id", F.col("checksum").alias("_c"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    manifest = corpus.manifest.join(new, ["document_id", "page_id"]).withColumns({"checksum": F.col("_c"), "width": F.col("_w"), "height": F.col("_h"), "source_kind": F.lit("image"), "tags": F.array_distinct(F.array_append("tags", F.lit(revision_tag)))}).drop("_c", "_w", "_h")
    page = F.col("truth").withField("checksum", F.col("_c")).withField("width", F.col("_w")).withField("height", F.col("_h"))
    truth = corpus.truth.join(new, ["document_id", "page_id"]).select("document_id", "page_id", page.alias("truth"))
    return Corpus(manifest, truth, corpus.extractions, corpus.named)


def image_checksums(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """path, checksum of the files of a folder, read on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.struct(F.lit("sha256").alias("algorithm"), F.sha2("content", 256).alias("value"), F.col("length").alias("size_bytes")).alias("checksum"))


# -- small corpora as JSON contracts -------------------------------------------------------------------------------


def _objects(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def _clean(page: dict) -> dict:
    """Open maps that were not given are empty objects in a contract."""
    def walk(x):
        if isinstance(x, dict):
            return {k: {} if k == "details" and v is None else walk(v) for k, v in x.items()}
        return [walk(y) for y in x] if isinstance(x, list) else x

    return walk(page)


def artifacts(corpus: Corpus, dataset_id: str, revision: str = "0.1.0") -> tuple[dict, dict]:
    """(manifest, ground truth) as contract objects: for corpora that fit a JSON file."""
    head = {"schema_version": S.SCHEMA_VERSION, "dataset_revision": {"dataset_id": dataset_id, "revision": revision, "manifest_checksum": None}, "coordinate_system": dict(S.COORDINATES)}
    source = {"kind": "synthetic", "title": dataset_id, "canonical_source_url": None, "source_organization": None, "retrieval_date": None, "license_status": "not_applicable", "redistribution": "synthetic", "notes": None}
    rows = sorted(_objects(corpus.manifest), key=lambda r: (r["doc_pos"], r["page_pos"]))
    truth = {(r["document_id"], r["page_id"]): _clean(r["truth"]) for r in _objects(corpus.truth)}
    extra: dict = {}
    for e in _objects(corpus.extractions) if corpus.extractions is not None else []:
        extra.setdefault(e["document_id"], []).append(_clean(e))
    documents: dict = {}
    truths: dict = {}
    for r in rows:
        doc = documents.setdefault(r["document_id"], {"document_id": r["document_id"], "split": r["split"], "category": r["category"], "checksum": r["checksum"], "source": source, "pages": []})
        doc["pages"].append({k: r[k] for k in ("page_id", "page_index", "checksum", "width", "height", "source_kind", "tags")})
        own = truths.setdefault(r["document_id"], {"document_id": r["document_id"], "pages": [], "extractions": extra.get(r["document_id"], [])})
        own["pages"].append(truth[r["document_id"], r["page_id"]])
    provenance = {"kind": "synthetic_generator", "source": "folioscore", "version": None, "model": None, "stage": None, "details": {}}
    manifest = head | {"documents": list(documents.values()), "reference_sources": [], "notes": []}
    return manifest, head | {"annotation_provenance": provenance, "documents": list(truths.values())}
