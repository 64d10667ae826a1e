"""The registered queries: each operator on the tables at hand, with its SQL.

Roles: orders are pages (of the customer's document, in the category of the market segment), lineitems are blocks,
cells or fields, conversation turns are texts with the next turn as the other side. Both sides of every pair come
from whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calibration as cal
from ..functions import fields as fld
from ..functions import geometry as geo
from ..functions import text as txt
from ..operators import matching as ops
from ..sources import adapters, contracts
from . import scoring as sc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with its SQL if there is one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- pages: orders ---------------------------------------------------------------------------------------------------

_PAGES = """
pages AS (
  SELECT o.*, c.c_mktsegment AS category, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS has_truth,
    CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'O' THEN 'missing' WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN 'timeout'
         WHEN o_orderstatus = 'O' AND o_totalprice < 60000 THEN 'crashed' ELSE 'success' END AS status,
    o_totalprice >= 300000 AS broken
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
outcomes AS (
  SELECT *, CASE WHEN NOT has_truth THEN 'ground_truth_missing' WHEN status <> 'success' THEN status WHEN broken THEN 'invalid' ELSE 'scored' END AS outcome FROM pages
)"""


def _order_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, truth, samples) as classify wants them."""
    def checksum(value: Column) -> Column:
        return F.struct(F.lit("sha256").alias("algorithm"), value.alias("value"), F.lit(None).cast("bigint").alias("size_bytes"))

    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("category")), "o_custkey")
    pages = orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page_id"), "category", F.col("o_custkey").alias("doc_pos"), F.col("o_orderkey").alias("page_pos"), F.lit(0).alias("page_index"), checksum(F.lit("a")).alias("checksum"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    status = F.when(F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") == "O"), "missing").when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100000), "timeout").when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") < 60000), "crashed").otherwise("success")
    page = F.struct(F.col("page_id").alias("page_id"), F.lit(0).alias("page_index"), checksum(F.when(F.col("o_totalprice") >= 300000, "b").otherwise("a")).alias("checksum"))
    error = F.struct(F.concat(F.lit("failed: "), "o_orderpriority").alias("message"))
    sample = F.struct(status.alias("status"), F.when(status == "success", page).alias("page"), F.when(status != "success", error).alias("error"), F.when(status != "missing", F.col("o_totalprice") / 1000).alias("runtime_ms"), F.lit(None).cast("double").alias("peak_memory_mb"))
    samples = pages.select("document_id", "page_id", sample.alias("sample"))
    owner = orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page_id"))
    truth = owner.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id")).distinct(), "page_id").select("document_id", "page_id", F.struct(F.col("page_id").alias("page_id")).alias("truth"))
    return pages.drop("o_orderstatus", "o_orderpriority", "o_totalprice"), truth, samples


@query(f"WITH {_PAGES} SELECT o_custkey AS document_id, o_orderkey AS page_id, category, outcome FROM outcomes")
def classify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.classify(*_order_pages(spark, sf_dir)).select("document_id", "page_id", "category", "outcome")


@query(f"""WITH {_PAGES} SELECT o_custkey AS document_id, o_orderkey AS page_id, outcome AS status,
  CASE outcome WHEN 'ground_truth_missing' THEN 'manifest page has no ground-truth page' WHEN 'missing' THEN 'prediction sample was not supplied'
    WHEN 'invalid' THEN 'prediction page metadata does not match the manifest' ELSE 'failed: ' || o_orderpriority END AS message
FROM outcomes WHERE outcome <> 'scored'""")
def failure_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.failures(sc.classify(*_order_pages(spark, sf_dir)))


@query(f"""WITH {_PAGES} SELECT category, grouping(category)::INT AS is_total, count(*) AS total_pages, {", ".join(f"count(*) FILTER (outcome = '{c}') AS {c}_pages" for c in sc.COUNTERS)}
FROM outcomes GROUP BY ROLLUP (category)""")
def status_counts_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.summaries(sc.classify(*_order_pages(spark, sf_dir))).withColumn("is_total", F.col("is_total").cast("int"))


@query(f"""WITH {_PAGES} SELECT category, grouping(category)::INT AS is_total, 'runtime_ms' AS metric, round(sum(o_totalprice / 1000) / greatest(count(*), 1), 6) AS micro, round(avg(o_totalprice / 1000), 6) AS macro, count(*) AS sample_count
FROM outcomes WHERE outcome NOT IN ('missing', 'ground_truth_missing') GROUP BY GROUPING SETS ((category), ())""")
def runtime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sc.aggregate(sc.performance_observations(sc.outcomes(sc.classify(*_order_pages(spark, sf_dir))))))


def _rounded(aggregated: DataFrame) -> DataFrame:
    return aggregated.select("category", F.col("is_total").cast("int").alias("is_total"), "metric", F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"), "sample_count")


@query("SELECT 'V11' AS rule, 'orders' AS artifact, o_orderkey::VARCHAR AS key, 'unknown to the manifest' AS message FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def key_containment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return contracts.key_containment(known, table(spark, sf_dir, "orders"), ["o_orderkey"], "V11", "orders")


@query("""SELECT 'V9' AS rule, 'lineitem' AS artifact, l_orderkey || '/' || l_linenumber AS key, 'given twice' AS message FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'value', 'customer', c_custkey::VARCHAR, 'balance below 0' FROM customer WHERE NOT c_acctbal >= 0
UNION ALL SELECT 'value', 'customer', c_custkey::VARCHAR, 'name' FROM customer WHERE NOT regexp_matches(c_name, '^[A-Za-z0-9][A-Za-z0-9._:-]{0,199}$')""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = contracts.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "V9", "lineitem", "given twice")
    checks = {"balance below 0": F.col("c_acctbal") >= 0, "name": contracts.identifier(F.col("c_name"))}
    return twice.unionByName(contracts.bad_values(table(spark, sf_dir, "customer"), "customer", F.col("c_custkey"), checks))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_duplicate_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.last_of(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("SELECT page_id, url, NOT (contains(url, chr(92)) OR starts_with(url, '/') OR regexp_matches(url, '(^|/)\\.\\.(/|$)')) AND length(url) > 0 AS safe FROM (SELECT page_id, regexp_replace(url, '^[a-z]+:/', '') AS url FROM pages UNION ALL SELECT page_id, regexp_replace(url, '^[a-z]+://', '') FROM pages UNION ALL SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '..') FROM pages)")
def asset_path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    shapes = F.array(F.regexp_replace("url", "^[a-z]+:/", ""), F.regexp_replace("url", "^[a-z]+://", ""), F.regexp_replace("url", "^[a-z]+://[^/]*", ".."))
    return pages.select("page_id", F.explode(shapes).alias("url")).withColumn("safe", contracts.safe_path(F.col("url")))


@query("SELECT o_custkey AS document_id, o_orderkey AS page_id, CASE WHEN row_number() OVER (ORDER BY o_custkey, o_orderkey) % 7 = 0 THEN 'crashed' ELSE 'success' END AS status FROM orders")
def fake_fail_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("doc_pos"), F.col("o_orderkey").alias("page_pos"))
    return adapters.numbered(pages).select("document_id", "page_id", F.when(F.col("rn") % 7 == 0, "crashed").otherwise("success").alias("status"))


@query("SELECT o_custkey::VARCHAR AS document_id, o_orderkey::VARCHAR AS page_id, 'timeout' AS status, 'runner_timeout' AS code, true AS retryable FROM orders")
def failure_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("document_id"), F.col("o_orderkey").cast("string").alias("page_id"))
    return adapters.failed_samples(pages, "timeout", "runner_timeout", "stopped", True).select("document_id", "page_id", "sample.status", "sample.error.code", "sample.error.retryable")


# -- texts: conversation turns, documents ---------------------------------------------------------------------------


def _bytes(text: str) -> str:
    """SQL: each letter beyond ASCII as one byte, since DuckDB's levenshtein counts bytes."""
    letters = "äöüßñéèêçíóáúàÄÖÜÑÉÈÊÇÍÓÁÚÀ"
    return f"translate({text}, '{letters}', {' || '.join(f'chr({i})' for i in [*range(1, 9), *range(14, 32), 11, 12][: len(letters)])})"


def _distance(a: str, b: str) -> str:
    """SQL: edit distance of two lists, row by row."""
    return f"""list_reduce(list_transform(range(len({a})), lambda i: [i]), lambda row, x: list_reduce(list_transform(range(len({b})), lambda j: [j]),
      lambda new, y: list_append(new, least(new[-1] + 1, row[y[1] + 2] + 1, row[y[1] + 1] + CASE WHEN {a}[x[1] + 1] = {b}[y[1] + 1] THEN 0 ELSE 1 END)), [x[1] + 1]), range(len({b}) + 1))[-1]"""


_TURNS = """turns AS (
  SELECT conv_id, turn, text AS reference, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS hypothesis FROM conversations QUALIFY hypothesis IS NOT NULL
)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("reference"), F.lead("text").over(w).alias("hypothesis")).where("hypothesis IS NOT NULL")


@query(f"WITH {_TURNS} SELECT conv_id, turn, round(levenshtein({_bytes('reference')}, {_bytes('hypothesis')}) / greatest(length(reference), 1), 9) AS cer FROM turns")
def cer_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(txt.character_error_rate(F.col("reference"), F.col("hypothesis")), 9).alias("cer"))


@query(f"WITH {_TURNS} SELECT conv_id, turn, round(1 - levenshtein({_bytes('reference')}, {_bytes('hypothesis')}) / greatest(length(reference), length(hypothesis), 1), 9) AS similarity FROM turns")
def nes_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(txt.edit_similarity(F.col("reference"), F.col("hypothesis")), 9).alias("similarity"))


_SPLIT = "list_filter(regexp_split_to_array({0}, '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+'), lambda w: w <> '')"


@query(f"WITH {_TURNS}, w AS (SELECT conv_id, turn, {_SPLIT.format('reference')} AS r, {_SPLIT.format('hypothesis')} AS h FROM turns) SELECT conv_id, turn, round({_distance('r', 'h')} / greatest(len(r), 1), 9) AS wer FROM w")
def wer_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(txt.word_error_rate(F.col("reference"), F.col("hypothesis")), 9).alias("wer"))


@query("SELECT doc_id, nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), chr(10), chr(13) || chr(10))).replace(chr(13) || chr(10), chr(10)).replace(chr(13), chr(10)) AS normalized FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("é")), F.lit("\n"), F.lit("\r\n"))
    return table(spark, sf_dir, "documents").select("doc_id", txt.normalize(apart).alias("normalized"))


@query("""WITH d AS (SELECT doc_id, text, lead(text) OVER (ORDER BY doc_id) AS following, translate(text, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS arabic FROM documents),
c AS (SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits, translate(regexp_replace(arabic, '[^٠-٩]', '', 'g'), '٠١٢٣٤٥٦٧٨٩', '0123456789') AS other, regexp_replace(following, '[^0-9]', '', 'g') AS after,
  regexp_replace(replace(text, 'a', '3'), '[^0-9]', '', 'g') AS altered FROM d)
SELECT doc_id, digits, digits <> '' AS has_digit, (digits = other)::INT::DOUBLE AS exact, (digits = altered)::INT::DOUBLE AS changed, (digits = after)::INT::DOUBLE AS following FROM c""")
def digit_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text against itself in other digits, against one with more digits, and against the next text."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the next text by a join on its number, not by a window over all rows in one task
    numbered = adapters.numbered(docs.withColumns({"doc_pos": F.col("doc_id"), "page_pos": F.lit(0)}))
    rows = numbered.join(numbered.select((F.col("rn") - 1).alias("rn"), F.col("text").alias("after")), "rn", "left")
    arabic = F.translate(text, "0123456789", "٠١٢٣٤٥٦٧٨٩")
    return rows.select("doc_id", txt.digits(text).alias("digits"), txt.has_digit(text).alias("has_digit"), txt.digit_exact(text, arabic).alias("exact"), txt.digit_exact(text, F.replace(text, F.lit("a"), F.lit("3"))).alias("changed"), txt.digit_exact(text, F.col("after")).alias("following"))


@query("SELECT doc_id, regexp_matches(text, '[\\x{600}-\\x{6ff}]') AS plain, contains(text, ' ') AS marked FROM documents")
def script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", txt.is_arabic(F.col("text")).alias("plain"), txt.is_arabic(F.replace(F.col("text"), F.lit(" "), F.lit("ب"))).alias("marked"))


@query("""SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}') AS checksum, 'run-' || substr(sha256(n_name), 1, 16) AS run_id, replace('nation {name} of region {region}', '{name}', n_name).replace('{region}', n_regionkey::VARCHAR) AS filled FROM nation""")
def canonical_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = txt.fill_template(F.lit("nation {name} of region {region}"), name=F.col("n_name"), region=F.col("n_regionkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", txt.canonical_checksum({"region": F.col("n_regionkey"), "key": F.col("n_nationkey"), "name": F.col("n_name")}).alias("checksum"), txt.run_id(F.col("n_name")).alias("run_id"), filled.alias("filled"))


# -- blocks: lineitems -------------------------------------------------------------------------------------------

_BLOCKS = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos FROM lineitem
),
blocks AS (
  SELECT l_orderkey, pos, l_linenumber AS idx, 'b' || pos AS id, CASE l_returnflag WHEN 'A' THEN 'equation' WHEN 'N' THEN 'diagram' ELSE 'paragraph' END AS kind, 'x' || l_partkey AS text,
    l_linenumber * 8.0 AS x, 0.0 AS y, l_quantity + 8 AS w, 16.0 AS h,
    l_discount > 0.02 AS found, 'h' || pos AS hid, CASE WHEN l_tax < 0.02 THEN 'figure' ELSE kind END AS hkind, 'x' || l_suppkey AS htext,
    l_linenumber * 8.0 + round(l_discount * 100) AS hx, (8 - l_linenumber) AS hidx, 1 - l_discount AS score
  FROM numbered
),
pages AS (
  SELECT l_orderkey, list({'id': id, 'kind': kind, 'text': text, 'idx': idx, 'x': x, 'y': y, 'w': w, 'h': h} ORDER BY pos) AS r,
    coalesce(list({'id': hid, 'kind': hkind, 'text': htext, 'idx': hidx, 'x': hx, 'y': y, 'w': w, 'h': h} ORDER BY pos) FILTER (found), []) AS q,
    coalesce(list(score ORDER BY pos) FILTER (found), []) AS scores
  FROM blocks GROUP BY l_orderkey
)"""


def _overlap(a: str, b: str) -> str:
    """SQL: intersection over union of two boxes whose areas are above 0."""
    both = f"(greatest(0.0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0.0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    return f"({both} / ({a}.w * {a}.h + {b}.w * {b}.h - {both}))"


def _greedy(r: str, q: str) -> str:
    """SQL: greedy matching as a fold; a list of {h, iou} (h null: unmatched, iou 0)."""
    kind = "STRUCT(used BIGINT[], got STRUCT(h BIGINT, iou DOUBLE)[], i BIGINT)"
    best = f"list_max(list_transform(list_filter(range(len({q})), lambda j: NOT list_contains(s.used, j)), lambda j: {{'iou': {_overlap(f'{r}[x.i + 1]', f'{q}[j + 1]')}::DOUBLE, 'back': -j}}))"
    step = f"""list_transform([{best}], lambda b: CASE WHEN coalesce(b.iou >= 0.1, false)
        THEN {{'used': list_append(s.used, -b.back), 'got': list_append(s.got, {{'h': -b.back, 'iou': b.iou}}), 'i': x.i}}
        ELSE {{'used': s.used, 'got': list_append(s.got, {{'h': NULL::BIGINT, 'iou': 0.0::DOUBLE}}), 'i': x.i}} END::{kind})[1]"""
    return f"list_reduce(list_transform(range(len({r})), lambda i: {{'used': []::BIGINT[], 'got': []::STRUCT(h BIGINT, iou DOUBLE)[], 'i': i}}::{kind}), lambda s, x: {step}, {{'used': [], 'got': [], 'i': -1}}::{kind}).got"


#: Whether the other side has a lineitem's block.
_FOUND = "l_discount > 0.02"


def _block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, pos (from 1, the document order), l_discount, r, q: both sides' blocks of each lineitem."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    line = F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "A", "equation").when(F.col("l_returnflag") == "N", "diagram").otherwise("paragraph")

    def box(x: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("l_quantity") + 8).cast("double").alias("width"), F.lit(16.0).alias("height"))

    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", pos)
    p = F.col("pos").cast("string")
    r = F.struct(F.concat(F.lit("b"), p).alias("block_id"), kind.alias("block_type"), box(line * 8).alias("bbox"), line.alias("reading_order_index"), F.concat(F.lit("x"), F.col("l_partkey").cast("string")).alias("text"))
    q = F.struct(F.concat(F.lit("h"), p).alias("block_id"), F.when(F.col("l_tax") < 0.02, "figure").otherwise(kind).alias("block_type"), box(line * 8 + F.round(F.col("l_discount") * 100)).alias("bbox"), (8 - line).alias("reading_order_index"), F.concat(F.lit("x"), F.col("l_suppkey").cast("string")).alias("text"), (1 - F.col("l_discount")).alias("score"))
    return rows.select("l_orderkey", "pos", "l_discount", r.alias("r"), q.alias("q"))


def _block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, r, q (blocks of both sides in document order), scores."""
    rows = _block_rows(spark, sf_dir)
    pages = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("r").alias("b")))).alias("r"), F.array_sort(F.collect_list(F.when(F.expr(_FOUND), F.struct("pos", F.col("q").alias("b"))))).alias("q"))
    return pages.select("l_orderkey", F.transform("r", lambda x: x.b).alias("r"), F.transform("q", lambda x: x.b).alias("q")).withColumn("scores", F.transform("q", lambda b: b.score))


def _matched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, q = F.col("r"), F.col("q")
    return _block_pages(spark, sf_dir).withColumn("m", geo.greedy_match(geo.boxes(r), geo.boxes(q)))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, {'x': l_linenumber * 8.0, 'y': 0.0, 'w': l_quantity + 8, 'h': 16.0} AS r, {'x': l_linenumber * 8.0 + l_quantity, 'y': round(l_discount * 100), 'w': l_quantity + 8, 'h': 16.0} AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(""" + _overlap("r", "q") + ", 9) AS iou FROM b")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def box(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), (F.col("l_quantity") + 8).alias("width"), F.lit(16.0).alias("height"))

    line = F.col("l_linenumber") * 8
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box(line, F.lit(0)).alias("r"), box(line + F.col("l_quantity"), F.round(F.col("l_discount") * 100)).alias("q"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(geo.iou(F.col("r"), F.col("q")), 9).alias("iou"))


@query(f"WITH {_BLOCKS}, m AS (SELECT l_orderkey, {_greedy('r', 'q')} AS m FROM pages) SELECT l_orderkey, (i + 1)::BIGINT AS reference, m[i + 1].h AS hypothesis, round(m[i + 1].iou, 9) AS iou FROM (SELECT l_orderkey, m, unnest(range(len(m))) AS i FROM m)")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _matched_pages(spark, sf_dir).select("l_orderkey", F.posexplode("m").alias("i", "m"))
    return rows.select("l_orderkey", (F.col("i") + 1).cast("long").alias("reference"), F.col("m.h").cast("long").alias("hypothesis"), F.round("m.iou", 9).alias("iou"))


_MATCHED = f"{_BLOCKS}, matched AS (SELECT *, {_greedy('r', 'q')} AS m FROM pages)"


@query(f"""WITH {_MATCHED} SELECT l_orderkey, greatest(len(r), len(q))::BIGINT AS block_count, len(list_filter(range(len(r)), lambda i: m[i + 1].h IS NOT NULL AND r[i + 1].kind = q[m[i + 1].h + 1].kind))::BIGINT AS correct_type,
  round(list_sum(list_transform(m, lambda x: x.iou)), 6) AS iou, len(list_filter(m, lambda x: x.h IS NOT NULL))::BIGINT AS matched FROM matched""")
def layout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _matched_pages(spark, sf_dir).select("l_orderkey", geo.layout(F.col("r"), F.col("q"), F.col("m")).alias("s"))
    return rows.select("l_orderkey", F.col("s.block_count").cast("long").alias("block_count"), F.col("s.correct_type").cast("long").alias("correct_type"), F.round("s.iou", 6).alias("iou"), F.col("s.matched").cast("long").alias("matched"))


@query(f"WITH {_MATCHED} SELECT l_orderkey, round((len(q) - len(list_filter(m, lambda x: x.h IS NOT NULL))) / greatest(len(q), 1), 9) AS rate FROM matched")
def hallucination_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("q")
    return _matched_pages(spark, sf_dir).select("l_orderkey", F.round((n - F.size(geo.matched(F.col("m")))) / F.greatest(n, F.lit(1)), 9).alias("rate"))


@query(f"""WITH {_BLOCKS}, d AS (SELECT l_orderkey, list_filter(r, lambda b: b.kind IN ('diagram', 'figure')) AS r, list_filter(q, lambda b: b.kind IN ('diagram', 'figure')) AS q FROM pages),
m AS (SELECT *, {_greedy('r', 'q')} AS m FROM d WHERE len(r) + len(q) > 0)
SELECT l_orderkey, round(2 * len(list_filter(coalesce(m, []), lambda x: x.h IS NOT NULL)) / (len(r) + len(q)), 9) AS f1 FROM m""")
def diagram_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _block_pages(spark, sf_dir).select("l_orderkey", geo.diagram_counts(F.col("r"), F.col("q")).alias("d")).where("d.reference + d.hypothesis > 0")
    return rows.select("l_orderkey", F.round(2 * F.col("d.matched") / (F.col("d.reference") + F.col("d.hypothesis")), 9).alias("f1"))


@query(f"""WITH {_BLOCKS}, d AS (SELECT l_orderkey, list_filter(r, lambda b: b.kind = 'equation') AS r, list_filter(q, lambda b: b.kind = 'equation') AS q FROM pages),
m AS (SELECT *, {_greedy('r', 'q')} AS m FROM d WHERE len(r) > 0)
SELECT l_orderkey, round(list_sum(list_transform(range(len(r)), lambda i: CASE WHEN m[i + 1].h IS NULL THEN 0.0 ELSE 1 - levenshtein(r[i + 1].text, q[m[i + 1].h + 1].text) / greatest(length(r[i + 1].text), length(q[m[i + 1].h + 1].text), 1) END)) / len(r), 6) AS similarity FROM m""")
def equation_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _block_pages(spark, sf_dir).select("l_orderkey", geo.equation_page_score(geo.of_types(F.col("r"), "equation"), geo.of_types(F.col("q"), "equation")).alias("s"))
    return rows.where("s IS NOT NULL").select("l_orderkey", F.round("s", 6).alias("similarity"))


_ORDERED = "list_transform(list_sort(list_transform(range(len({0})), lambda i: {{'k': {0}[i + 1].idx, 'i': i}})), lambda k: {0}[k.i + 1])"


@query(f"""WITH {_BLOCKS}, o AS (SELECT l_orderkey, {_ORDERED.format('r')} AS r, {_ORDERED.format('q')} AS q FROM pages), m AS (SELECT *, {_greedy('r', 'q')} AS m FROM o),
ids AS (SELECT l_orderkey, list_transform(r, lambda b: b.id) AS a, list_transform(range(len(q)), lambda j: coalesce(list_filter(list_transform(range(len(r)), lambda i: CASE WHEN m[i + 1].h = j THEN r[i + 1].id END), lambda x: x IS NOT NULL)[1], 'unmatched:' || j)) AS b FROM m)
SELECT l_orderkey, round(1 - coalesce({_distance('a', 'b')}, greatest(len(a), len(b))) / greatest(len(a), len(b), 1), 9) AS score FROM ids""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _block_pages(spark, sf_dir).select("l_orderkey", geo.comparable_orders(F.col("r"), F.col("q")).alias("o"))
    return rows.select("l_orderkey", F.round(geo.reading_order_score(F.col("o")), 9).alias("score"))


@query("""WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos FROM lineitem)
SELECT l_orderkey, string_agg('x' || l_partkey, chr(10) ORDER BY l_linenumber, pos) AS text FROM numbered GROUP BY l_orderkey""")
def page_text_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.transform("r", lambda b: F.struct(b.reading_order_index.alias("reading_order_index"), F.array(F.struct(b.text.alias("normalized_text"), F.lit(0).alias("reading_order_index"))).alias("lines")))
    return _block_pages(spark, sf_dir).select("l_orderkey", blocks.alias("blocks")).select("l_orderkey", geo.page_text(F.col("blocks")).alias("text"))


@query("""WITH t AS (
  SELECT l_orderkey, list_distinct(list((l_linenumber, l_suppkey % 4))) AS a, list_distinct(coalesce(list((l_linenumber, l_suppkey % 4)) FILTER (l_discount > 0.02), [])) AS b,
    max(l_linenumber) AS ra, max(l_linenumber) FILTER (l_discount > 0.02) AS rb FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(CASE WHEN rb IS NULL THEN 0.0 ELSE CASE WHEN ra = rb THEN 0.5 ELSE 0.0 END + 0.5 * 2 * len(list_intersect(a, b)) / greatest(len(a) + len(b), 1) END, 9)::DOUBLE AS similarity FROM t""")
def table_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.struct(F.col("l_linenumber").cast("long").alias("row_index"), F.pmod("l_suppkey", F.lit(4)).cast("long").alias("column_index"), F.lit(1).alias("row_span"), F.lit(1).alias("column_span"))
    found = F.col("l_discount") > 0.02
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(cell).alias("a"), F.collect_list(F.when(found, cell)).alias("b"), F.max("l_linenumber").alias("ra"), F.max(F.when(found, F.col("l_linenumber"))).alias("rb"))
    grid = lambda n, cells: F.when(n.isNotNull(), F.struct(n.alias("rows"), F.lit(4).alias("columns"), cells.alias("cells")))
    pair = rows.select("l_orderkey", grid(F.col("ra"), F.col("a")).alias("a"), grid(F.col("rb"), F.col("b")).alias("b"))
    return pair.select("l_orderkey", F.round(geo.table_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


@query("""WITH b AS (SELECT p_partkey, p_size % 3 + 1 AS rows, p_size % 2 + 1 AS columns, p_size * 6.0 AS size FROM part)
SELECT p_partkey, (i // columns)::INT AS row_index, (i % columns)::INT AS column_index, round((i % columns) * size / columns, 6) AS x, round((i // columns) * size / rows, 6) AS y FROM (SELECT *, unnest(range(rows * columns)) AS i FROM b)""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.col("p_size") * 6).cast("double")
    box = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), size.alias("width"), size.alias("height"))
    shaped = table(spark, sf_dir, "part").select("p_partkey", box.alias("box"), (F.col("p_size") % 3 + 1).alias("rows"), (F.col("p_size") % 2 + 1).alias("columns"))
    cells = shaped.select("p_partkey", F.explode(geo.grid_cells(F.col("box"), F.col("rows"), F.col("columns"))).alias("c"))
    return cells.select("p_partkey", "c.row_index", "c.column_index", F.round("c.bbox.x", 6).alias("x"), F.round("c.bbox.y", 6).alias("y"))


# -- calibration ---------------------------------------------------------------------------------------------------

_OUTCOMES = "outcomes AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS o, round(1 - l_tax * 10, 2) AS c FROM lineitem)"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.struct(F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("o"), F.round(1 - F.col("l_tax") * 10, 2).alias("c"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(pair)).alias("p"))
    return rows.select("l_orderkey", F.transform("p", lambda x: x.o).alias("o"), F.transform("p", lambda x: x.c).alias("c"))


@query(f"WITH {_OUTCOMES} SELECT l_orderkey, round(avg((c - o) ** 2), 6) AS brier FROM outcomes GROUP BY l_orderkey")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("l_orderkey", F.round(cal.brier(F.col("o"), F.col("c")), 6).alias("brier"))


@query(f"""WITH {_OUTCOMES}, binned AS (SELECT *, len(list_filter(range(10), lambda i: c >= i / 10)) - 1 AS b FROM outcomes), gaps AS (SELECT l_orderkey, b, abs(sum(o - c)) AS gap, count(*) AS n FROM binned GROUP BY ALL)
SELECT l_orderkey, round(sum(gap) / sum(n), 6) AS ece FROM gaps GROUP BY l_orderkey""")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("l_orderkey", F.round(cal.calibration_error(F.col("o"), F.col("c")), 6).alias("ece"))


@query(f"""WITH {_OUTCOMES} SELECT e.l_orderkey, round(avg(CASE WHEN 1 - e.c > 1 - r.c THEN 1.0 WHEN 1 - e.c = 1 - r.c THEN 0.5 ELSE 0.0 END), 6) AS auroc
FROM outcomes e JOIN outcomes r ON e.l_orderkey = r.l_orderkey AND e.o = 0 AND r.o = 1 GROUP BY e.l_orderkey""")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir).select("l_orderkey", cal.error_auroc(F.col("o"), F.col("c")).alias("a"))
    return rows.where("a IS NOT NULL").select("l_orderkey", F.round("a", 6).alias("auroc"))


# -- structured fields ------------------------------------------------------------------------------------------

_FIELDS = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos FROM lineitem),
fields AS (
  SELECT l_orderkey, pos, 1 AS k, 'line.quantity' AS name, l_quantity::INT::VARCHAR AS value, l_discount, l_tax, l_linenumber FROM numbered
  UNION ALL SELECT l_orderkey, pos, 2, 'line.part' || l_linenumber, l_partkey::VARCHAR, l_discount, l_tax, l_linenumber FROM numbered
),
ref AS (SELECT l_orderkey, name, value, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey, name ORDER BY pos, k) AS occ FROM fields WHERE l_tax < 0.07),
hyp AS (SELECT l_orderkey, name, CASE WHEN l_tax < 0.02 THEN value || '?' ELSE value END AS value, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey, name ORDER BY pos, k) AS occ FROM fields WHERE l_discount > 0.02),
joined AS (
  SELECT coalesce(r.l_orderkey, h.l_orderkey) AS l_orderkey, coalesce(r.name, h.name) AS name, coalesce(r.occ, h.occ) AS occ, r.value AS reference, h.value AS hypothesis, r.line = h.line AS same_box
  FROM ref r FULL JOIN hyp h ON r.l_orderkey = h.l_orderkey AND r.name = h.name AND r.occ = h.occ
)"""


def _extractions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reference, hypothesis): document_id, schema_name, schema_version, fields."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    bbox = F.struct((F.col("l_linenumber") * 8.0).alias("x"), F.lit(0.0).alias("y"), F.lit(8.0).alias("width"), F.lit(8.0).alias("height"))

    def side(keep: Column, change: Column) -> DataFrame:
        def field(name: Column, value: Column) -> Column:
            return F.struct(name.alias("field_name"), F.when(change, F.concat(value, F.lit("?"))).otherwise(value).alias("normalized_value"), bbox.alias("bbox"))

        own = F.array(field(F.lit("line.quantity"), F.col("l_quantity").cast("int").cast("string")), field(F.concat(F.lit("line.part"), F.col("l_linenumber")), F.col("l_partkey").cast("string")))
        kept = rows.where(keep).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", own.alias("f")))).alias("p"))
        return kept.select(F.col("l_orderkey").alias("document_id"), F.lit("form").alias("schema_name"), F.lit("1.0.0").alias("schema_version"), F.flatten(F.transform("p", lambda x: x.f)).alias("fields"))

    return side(F.col("l_tax") < 0.07, F.lit(False)), side(F.col("l_discount") > 0.02, F.col("l_tax") < 0.02)


@query(f"WITH {_FIELDS} SELECT l_orderkey AS document_id, name AS field_name, occ::BIGINT AS occurrence, reference, hypothesis FROM joined")
def field_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.align_fields(*_extractions(spark, sf_dir), ["document_id"])


_FIELD_SCORES = f"""{_FIELDS}, counted AS (
  SELECT l_orderkey, count(reference) AS n_ref, count(hypothesis) AS n_hyp, count(*) FILTER (reference = hypothesis) AS exact, count(*) FILTER (reference = hypothesis AND same_box) AS boxed, count(*) FILTER (reference IS NULL) AS extra,
    count(reference) FILTER (name = 'line.quantity') AS n_fin, count(*) FILTER (reference = hypothesis AND name = 'line.quantity') AS fin FROM joined GROUP BY l_orderkey)"""


@query(f"""WITH {_FIELD_SCORES} SELECT l_orderkey AS document_id, round(exact / greatest(n_hyp, 1), 9) AS precision, round(exact / greatest(n_ref, 1), 9) AS recall,
  round(2 * exact / greatest(n_hyp, 1) * exact / greatest(n_ref, 1) / greatest(exact / greatest(n_hyp, 1) + exact / greatest(n_ref, 1), 1e-12), 9) AS f1,
  round(boxed / greatest(exact, 1), 9) AS coordinate_iou, round(extra / greatest(n_hyp, 1), 9) AS hallucination_rate FROM counted""")
def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sc.scored_extractions(*_extractions(spark, sf_dir))
    return rows.select("document_id", *[F.round(f"s.{c}", 9).alias(c) for c in ("precision", "recall", "f1", "coordinate_iou", "hallucination_rate")])


@query(f"WITH {_FIELD_SCORES} SELECT l_orderkey AS document_id, round(fin / greatest(n_fin, 1), 9) AS accuracy, n_fin::INT AS n_financial FROM counted WHERE n_fin > 0")
def financial_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sc.scored_extractions(*_extractions(spark, sf_dir)).where("s.n_financial > 0")
    return rows.select("document_id", F.round("s.financial_accuracy", 9).alias("accuracy"), "s.n_financial")


@query(f"""WITH {_FIELD_SCORES}, long AS (
  SELECT c_mktsegment AS category, m.metric, m.value, m.n FROM counted JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey,
  LATERAL (VALUES ('structured_field_precision', exact / greatest(n_hyp, 1), greatest(n_ref, 1)), ('structured_field_recall', exact / greatest(n_ref, 1), greatest(n_ref, 1)),
    ('structured_field_f1', 2 * exact / greatest(n_hyp, 1) * exact / greatest(n_ref, 1) / greatest(exact / greatest(n_hyp, 1) + exact / greatest(n_ref, 1), 1e-12), greatest(n_ref, 1)),
    ('structured_field_exact_accuracy', exact / greatest(n_ref, 1), greatest(n_ref, 1)), ('structured_field_coordinate_iou', boxed / greatest(exact, 1), greatest(n_ref, 1)),
    ('structured_hallucination_rate', extra / greatest(n_hyp, 1), greatest(n_ref, 1)), ('financial_value_accuracy', CASE WHEN n_fin > 0 THEN fin / n_fin END, n_fin)) m(metric, value, n) WHERE m.value IS NOT NULL)
SELECT category, grouping(category)::INT AS is_total, metric, round(avg(value), 6) AS micro, round(avg(value), 6) AS macro, sum(n)::BIGINT AS sample_count FROM long GROUP BY GROUPING SETS ((metric, category), (metric))""")
def micro_macro_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    categories = orders.select(F.col("o_orderkey").alias("document_id"), F.col("c_mktsegment").alias("category"))
    return _rounded(sc.aggregate(sc.extraction_observations(*_extractions(spark, sf_dir), categories)))


# -- the whole report -----------------------------------------------------------------------------------------------


def _turn_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns as pages of one block; the system's reading swaps letters and is sure of it."""
    rows = table(spark, sf_dir, "conversations").withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")))
    rows = rows.withColumn("document_id", F.col("conv_id").cast("string")).withColumn("page_id", F.concat_ws("-", "conv_id", "rn"))
    sum_ = F.struct(F.lit("sha256").alias("algorithm"), F.col("page_id").alias("value"), F.lit(None).cast("bigint").alias("size_bytes"))
    manifest = rows.select("document_id", "page_id", F.col("role").alias("category"), F.lit(0).alias("page_index"), sum_.alias("checksum"), F.col("conv_id").alias("doc_pos"), F.col("rn").alias("page_pos"))

    def page(text: Column) -> Column:
        box = F.struct(*[F.lit(v).alias(n) for n, v in (("x", 0.0), ("y", 0.0), ("width", 10.0), ("height", 10.0))])
        line = F.struct(text.alias("normalized_text"), F.lit(0).alias("reading_order_index"))
        cell = "struct<rows: int, columns: int, cells: array<struct<row_index: int, column_index: int, row_span: int, column_span: int>>>"
        block = F.struct(F.lit("b").alias("block_id"), F.lit("paragraph").alias("block_type"), box.alias("bbox"), F.lit(0).alias("reading_order_index"), F.struct(F.lit(0.9).alias("score")).alias("confidence"), F.lit(None).cast("string").alias("equation_text"), F.array(line).alias("lines"), F.lit(None).cast(cell).alias("table"))
        return F.struct(F.col("page_id").alias("page_id"), F.lit(0).alias("page_index"), sum_.alias("checksum"), F.array(block).alias("blocks"))

    truth = rows.select("document_id", "page_id", page(F.col("text")).alias("truth"))
    read = F.replace(F.col("text"), F.lit("the "), F.lit("teh  "))
    sample = F.struct(F.lit("success").alias("status"), page(read).alias("page"), F.lit(None).cast("struct<message: string>").alias("error"), F.char_length("text").cast("double").alias("runtime_ms"), F.lit(None).cast("double").alias("peak_memory_mb"))
    return manifest, truth, rows.select("document_id", "page_id", sample.alias("sample"))


#: SQL: the metric table of ``long`` (category, metric, value, num, den, n) for the rows of ``groups``.
_METRIC_TABLE = f""",
got AS (SELECT category, grouping(category)::INT AS is_total, metric, sum(num) / greatest(sum(den), 1) AS micro, avg(value) AS macro, sum(n)::BIGINT AS n FROM long GROUP BY GROUPING SETS ((metric, category), (metric))),
spec(metric, unit, higher_is_better, optional) AS (VALUES {", ".join(f"('{m.name}', '{m.unit}', {str(m.higher_is_better).lower()}, {str(m.optional).lower()})" for m in sc.METRICS)})
SELECT g.category, g.is_total, s.metric, s.unit, s.higher_is_better, round(coalesce(x.micro, 0.0), 6) AS micro, round(coalesce(x.macro, 0.0), 6) AS macro, coalesce(x.n, 0)::BIGINT AS sample_count
FROM groups g CROSS JOIN spec s LEFT JOIN got x ON x.is_total = g.is_total AND x.category IS NOT DISTINCT FROM g.category AND x.metric = s.metric WHERE x.metric IS NOT NULL OR NOT s.optional
"""


def _report_sql() -> str:
    return f"""
WITH p AS (SELECT role AS category, text AS r, replace(text, 'the ', 'teh  ') AS h FROM conversations),
w AS (SELECT *, {_SPLIT.format("r")} AS rw, {_SPLIT.format("h")} AS hw FROM p),
d AS (SELECT *, levenshtein({_bytes("r")}, {_bytes("h")}) AS dc, coalesce({_distance("rw", "hw")}, greatest(len(rw), len(hw))) AS dw, CASE WHEN r = h THEN 1.0 ELSE 0.0 END AS ok FROM w),
long AS (
  SELECT category, m.* FROM d, LATERAL (VALUES
    ('cer', dc / greatest(length(r), 1), dc, greatest(length(r), 1), 1), ('wer', dw / greatest(len(rw), 1), dw, greatest(len(rw), 1), 1),
    ('normalized_edit_similarity', 1 - dc / greatest(length(r), length(h), 1), greatest(length(r), length(h), 1) - dc, greatest(length(r), length(h), 1), 1),
    ('digit_exact_accuracy', 1.0, 1.0, 1, CASE WHEN regexp_matches(r, '[0-9]') THEN 1 END), ('reading_order_sequence_score', 1.0, 1.0, 1, 1),
    ('block_type_accuracy', 1.0, 1.0, 1, 1), ('layout_bbox_iou', 1.0, 1.0, 1, 1), ('layout_match_f1', 1.0, 2.0, 2, 1), ('hallucinated_block_rate', 0.0, 0.0, 1, 1),
    ('confidence_brier', (0.9 - ok) ** 2, (0.9 - ok) ** 2, 1, 1), ('confidence_ece', abs(ok - 0.9), abs(ok - 0.9), 1, 1), ('runtime_ms', length(r), length(r), 1, 1)) m(metric, value, num, den, n) WHERE m.n IS NOT NULL
),
groups AS (SELECT role AS category, grouping(role)::INT AS is_total FROM conversations GROUP BY ROLLUP (role)){_METRIC_TABLE}"""


@query(_report_sql())
def smoke_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pages, classification, all page metrics, and the zero-filled metric table."""
    return _metric_rows(sc.Scored(*_turn_pages(spark, sf_dir)))


def _metric_rows(scored: sc.Scored) -> DataFrame:
    return scored.metrics.select("category", F.col("is_total").cast("int").alias("is_total"), "metric", "unit", "higher_is_better", F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"), "sample_count")


# -- the whole report on pages of many blocks and all outcomes -----------------------------------------------------------


def _mixed_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as pages, their lineitems as equations, diagrams, tables and paragraphs; some samples fail or are invalid."""
    manifest, _, samples = _order_pages(spark, sf_dir)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    line, p = F.col("l_linenumber"), F.col("pos").cast("string")
    kind = F.when(F.col("l_tax") >= 0.06, "table").when(F.col("l_returnflag") == "A", "equation").when(F.col("l_returnflag") == "N", "diagram").otherwise("paragraph")
    read = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("x"), "l_partkey")).otherwise(F.concat(F.lit("y"), "l_suppkey"))

    def block(id_: Column, own: Column, text: Column, x: Column, index: Column, score: Column, n_rows: Column, column: Column) -> Column:
        cell = F.struct(F.lit(0).alias("row_index"), column.cast("int").alias("column_index"), F.lit(1).alias("row_span"), F.lit(1).alias("column_span"))
        box = F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("l_quantity") + 8).cast("double").alias("width"), F.lit(16.0).alias("height"))
        return F.struct(
            id_.alias("block_id"), own.alias("block_type"), box.alias("bbox"), index.alias("reading_order_index"), F.struct(score.alias("score")).alias("confidence"), F.when(own == "equation", text).alias("equation_text"),
            F.array(F.struct(text.alias("normalized_text"), F.lit(0).alias("reading_order_index"))).alias("lines"),
            F.when(own == "table", F.struct(n_rows.cast("int").alias("rows"), F.lit(2).alias("columns"), F.array(cell).alias("cells"))).alias("table"),
        )

    r = block(F.concat(F.lit("b"), p), kind, F.concat(F.lit("x"), "l_partkey"), line * 8, line, F.lit(1.0), line, F.col("l_suppkey") % 2)
    h = block(F.concat(F.lit("h"), p), F.when(F.col("l_tax") < 0.02, "figure").otherwise(kind), read, line * 8 + F.round(F.col("l_discount") * 100), 8 - line, 1 - F.col("l_discount"), line + (F.col("l_discount") > 0.05).cast("int"), F.col("l_partkey") % 2)
    pages = rows.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("pos", r.alias("b")))).alias("r"), F.array_sort(F.collect_list(F.when(F.col("l_discount") > 0.02, F.struct("pos", h.alias("b"))))).alias("h"))
    pages = pages.select("page_id", F.transform("r", lambda x: x.b).alias("r"), F.transform("h", lambda x: x.b).alias("h"))
    truth = manifest.select("document_id", "page_id").join(pages, "page_id").select("document_id", "page_id", F.struct(F.col("r").alias("blocks")).alias("truth"))
    both = samples.join(pages.select("page_id", "h"), "page_id", "left")
    page = F.col("sample.page")
    full = F.when(page.isNotNull(), F.struct(page.page_id.alias("page_id"), page.page_index.alias("page_index"), page.checksum.alias("checksum"), F.coalesce("h", F.array()).alias("blocks")))
    sample = F.struct(F.col("sample.status").alias("status"), full.alias("page"), F.col("sample.error").alias("error"), F.col("sample.runtime_ms").alias("runtime_ms"), (F.col("sample.runtime_ms") * 10).alias("peak_memory_mb"))
    return manifest, truth, both.select("document_id", "page_id", sample.alias("sample"))


_MIXED = f"""
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos FROM lineitem
),
blocks AS (
  SELECT l_orderkey, pos, l_linenumber AS idx, 'b' || pos AS id, CASE WHEN l_tax >= 0.06 THEN 'table' WHEN l_returnflag = 'A' THEN 'equation' WHEN l_returnflag = 'N' THEN 'diagram' ELSE 'paragraph' END AS kind, 'x' || l_partkey AS text,
    l_linenumber * 8.0 AS x, 0.0 AS y, l_quantity + 8 AS w, 16.0 AS h, l_discount > 0.02 AS found, 'h' || pos AS hid, CASE WHEN l_tax < 0.02 THEN 'figure' ELSE kind END AS hkind,
    CASE WHEN l_suppkey % 2 = 0 THEN text ELSE 'y' || l_suppkey END AS htext, l_linenumber * 8.0 + round(l_discount * 100) AS hx, (8 - l_linenumber) AS hidx, 1 - l_discount AS score,
    l_linenumber AS n, l_suppkey % 2 AS c, l_linenumber + (l_discount > 0.05)::INT AS hn, l_partkey % 2 AS hc
  FROM numbered
),
page_blocks AS (
  SELECT l_orderkey, list({{'id': id, 'kind': kind, 'text': text, 'idx': idx, 'x': x, 'y': y, 'w': w, 'h': h, 's': 1.0::DOUBLE, 'n': n, 'c': c}} ORDER BY pos) AS r,
    coalesce(list({{'id': hid, 'kind': hkind, 'text': htext, 'idx': hidx, 'x': hx, 'y': y, 'w': w, 'h': h, 's': score, 'n': hn, 'c': hc}} ORDER BY pos) FILTER (found), []) AS q FROM blocks GROUP BY l_orderkey
),
cut AS (
  SELECT o.category, o.o_orderkey, r, q, {_ORDERED.format("r")} AS ro, {_ORDERED.format("q")} AS qo, list_filter(r, lambda b: b.kind = 'equation') AS re, list_filter(q, lambda b: b.kind = 'equation') AS qe,
    list_filter(r, lambda b: b.kind = 'table') AS rt, list_filter(q, lambda b: b.kind = 'table') AS qt, list_filter(r, lambda b: b.kind IN ('diagram', 'figure')) AS rd, list_filter(q, lambda b: b.kind IN ('diagram', 'figure')) AS qd
  FROM page_blocks JOIN outcomes o ON o.o_orderkey = l_orderkey WHERE o.outcome = 'scored'
),
met AS (SELECT *, {_greedy("r", "q")} AS m, {_greedy("ro", "qo")} AS mo, coalesce({_greedy("re", "qe")}, []) AS me, coalesce({_greedy("rt", "qt")}, []) AS mt, coalesce({_greedy("rd", "qd")}, []) AS md FROM cut),
seen AS (
  SELECT *, array_to_string(list_transform(ro, lambda b: b.text), chr(10)) AS rx, array_to_string(list_transform(qo, lambda b: b.text), chr(10)) AS qx, list_transform(ro, lambda b: b.text) AS rw, list_transform(qo, lambda b: b.text) AS qw,
    list_transform(ro, lambda b: b.id) AS ids, list_transform(range(len(qo)), lambda j: coalesce(list_filter(list_transform(range(len(ro)), lambda i: CASE WHEN mo[i + 1].h = j THEN ro[i + 1].id END), lambda x: x IS NOT NULL)[1], 'unmatched:' || j)) AS got_ids,
    len(list_filter(m, lambda x: x.h IS NOT NULL)) AS n_met, list_transform(range(len(q)), lambda j: coalesce(list_max(list_transform(range(len(r)), lambda i: CASE WHEN m[i + 1].h = j AND m[i + 1].iou >= 0.5 AND r[i + 1].kind = q[j + 1].kind AND r[i + 1].text = q[j + 1].text THEN 1 ELSE 0 END)), 0)) AS good
  FROM met
),
measured AS (
  SELECT *, levenshtein(rx, qx) AS dc, coalesce({_distance("rw", "qw")}, greatest(len(rw), len(qw))) AS dw, coalesce({_distance("ids", "got_ids")}, greatest(len(ids), len(got_ids))) AS d_o, greatest(len(r), len(q)) AS nb, len(r) + len(q) AS nn,
    list_sum(list_transform(range(len(re)), lambda i: CASE WHEN me[i + 1].h IS NULL THEN 0.0 ELSE 1 - levenshtein(re[i + 1].text, qe[me[i + 1].h + 1].text) / greatest(length(re[i + 1].text), length(qe[me[i + 1].h + 1].text), 1) END)) AS es,
    list_sum(list_transform(range(len(rt)), lambda i: CASE WHEN mt[i + 1].h IS NULL THEN 0.0 ELSE 0.5 * (rt[i + 1].n = qt[mt[i + 1].h + 1].n)::INT + 0.5 * (rt[i + 1].c = qt[mt[i + 1].h + 1].c)::INT END)) AS ts
  FROM seen
),
judged AS (SELECT o_orderkey, category, len(q) AS nh, unnest(good) AS o, unnest(list_transform(q, lambda b: b.s)) AS c FROM seen),
bins AS (SELECT o_orderkey, category, any_value(nh) AS nh, abs(sum(o - c)) AS gap FROM (SELECT *, len(list_filter(range(10), lambda i: c >= i / 10)) AS b FROM judged) GROUP BY o_orderkey, category, b),
sure AS (
  SELECT category, 'confidence_brier' AS metric, avg((c - o) ** 2) AS value, any_value(nh) AS n FROM judged GROUP BY o_orderkey, category
  UNION ALL SELECT category, 'confidence_ece', sum(gap) / any_value(nh), any_value(nh) FROM bins GROUP BY o_orderkey, category
  UNION ALL SELECT e.category, 'error_detection_auroc', avg(CASE WHEN 1 - e.c > 1 - k.c THEN 1.0 WHEN 1 - e.c = 1 - k.c THEN 0.5 ELSE 0.0 END), any_value(e.nh) FROM judged e JOIN judged k ON e.o_orderkey = k.o_orderkey AND e.o = 0 AND k.o = 1 GROUP BY e.o_orderkey, e.category
),
long AS (
  SELECT category, x.* FROM measured, LATERAL (VALUES
    ('cer', dc / greatest(length(rx), 1), dc, greatest(length(rx), 1), 1), ('wer', dw / greatest(len(rw), 1), dw, greatest(len(rw), 1), 1),
    ('normalized_edit_similarity', 1 - dc / greatest(length(rx), length(qx), 1), greatest(length(rx), length(qx), 1) - dc, greatest(length(rx), length(qx), 1), 1),
    ('reading_order_sequence_score', 1 - d_o / greatest(nb, 1), greatest(nb, 1) - d_o, greatest(nb, 1), 1),
    ('digit_exact_accuracy', (regexp_replace(rx, '[^0-9]', '', 'g') = regexp_replace(qx, '[^0-9]', '', 'g'))::INT, (regexp_replace(rx, '[^0-9]', '', 'g') = regexp_replace(qx, '[^0-9]', '', 'g'))::INT, 1, 1),
    ('block_type_accuracy', len(list_filter(range(len(r)), lambda i: m[i + 1].h IS NOT NULL AND r[i + 1].kind = q[m[i + 1].h + 1].kind)) / nb, len(list_filter(range(len(r)), lambda i: m[i + 1].h IS NOT NULL AND r[i + 1].kind = q[m[i + 1].h + 1].kind)), nb, nb),
    ('layout_bbox_iou', list_sum(list_transform(m, lambda z: z.iou)) / nb, list_sum(list_transform(m, lambda z: z.iou)), nb, nb), ('layout_match_f1', 2 * n_met / nn, 2 * n_met, nn, nb),
    ('equation_text_similarity', es / len(re), es, len(re), CASE WHEN len(re) > 0 THEN len(re) END), ('table_structure_similarity', ts / len(rt), ts, len(rt), CASE WHEN len(rt) > 0 THEN len(rt) END),
    ('hallucinated_block_rate', (len(q) - n_met) / greatest(len(q), 1), len(q) - n_met, greatest(len(q), 1), len(q)),
    ('diagram_detection_f1', 2 * len(list_filter(md, lambda z: z.h IS NOT NULL)) / greatest(len(rd) + len(qd), 1), 2 * len(list_filter(md, lambda z: z.h IS NOT NULL)), len(rd) + len(qd), CASE WHEN len(rd) + len(qd) > 0 THEN len(rd) END)
  ) x(metric, value, num, den, n) WHERE x.n IS NOT NULL
  UNION ALL SELECT category, metric, value, value * n, n, n FROM sure
  UNION ALL SELECT category, 'runtime_ms', o_totalprice / 1000, o_totalprice / 1000, 1, 1 FROM outcomes WHERE outcome NOT IN ('missing', 'ground_truth_missing')
  UNION ALL SELECT category, 'peak_memory_mb', o_totalprice / 1000 * 10, o_totalprice / 1000 * 10, 1, 1 FROM outcomes WHERE outcome NOT IN ('missing', 'ground_truth_missing')
),
groups AS (SELECT category, grouping(category)::INT AS is_total FROM outcomes GROUP BY ROLLUP (category))"""


@query(f"WITH {_PAGES}, {_MIXED}{_METRIC_TABLE}")
def mixed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outcomes, and pages whose blocks move, change type and text, disappear, and are more or less sure."""
    return _metric_rows(sc.Scored(*_mixed_pages(spark, sf_dir)))


@query(f"WITH {_PAGES}, {_MIXED} SELECT o_orderkey, round(ts / len(rt), 9) AS score FROM measured WHERE len(rt) > 0")
def table_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sc.classify(*_mixed_pages(spark, sf_dir)).where("outcome = 'scored'").select("page_id", F.col("truth.blocks").alias("r"), F.col("sample.page.blocks").alias("h"))
    score = geo.table_page_score(F.filter("r", lambda b: (b.block_type == "table") & b.table.isNotNull()), geo.of_types(F.col("h"), "table"))
    return rows.select(F.col("page_id").alias("o_orderkey"), F.round(score, 9).alias("score")).where("score IS NOT NULL")


from . import artifact_queries as artifact_queries  # noqa: E402  registers its own
from . import wide_queries as wide_queries  # noqa: E402
