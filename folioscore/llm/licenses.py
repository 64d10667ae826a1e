"""License scan by an exact set-similarity join.

Templates are license notices as word sets. A text block is a window of consecutive words, REACH times as long as the
template, wherever it begins and however its lines are wrapped; it meets the template if it holds at least a share ``threshold``
of the template's words. All pairs that meet are found:

* Words are ordered by global frequency, the rarest first. Only template words need an order: others add to no overlap.
* Prefix filter: of a template with n words that needs k, one of the n - k + 1 rarest must be in the block. These are
  the index, joined by equality with the words of the texts; texts without any of them are dropped before.
* A block that meets may be moved up to its first template word, so only windows that begin at one and hold the joined word
  are formed.
* Length filter: a block with fewer than k of the templates' words can't meet the template.
* Positional filter: behind the first common word, at least k - 1 more must be left on both sides.
* What remains is verified by intersecting the sets.

Everything is DataFrame functions. The index and the word order are bounded by the template list (checked), not
by the data; documents' words are counted after map-side aggregation. Template words of a text are gathered in chunks of CHUNK
words (with what a window reaches beyond), so a text of any length makes rows of bounded size.

Edge cases: null and empty texts have no words, labels or places (first_word and last_word null, labels empty,
score 0). Repeated rows give equal rows; equal doc_ids with other texts are kept apart by the text's hash. Very long
texts are scanned whole. An empty table gives none. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The phrases of the base rule and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
MAX_TEMPLATE_WORDS = 10_000
#: A block's words for each word of the template.
REACH = 1.5
CHUNK = 512


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 0.9

    @property
    def _all(self) -> list[str]:
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", self.text.translate(str.maketrans(UPPER, LOWER))) if w]

    @property
    def words(self) -> list[str]:
        return sorted(set(self._all))

    @property
    def reach(self) -> int:
        """The words of a block."""
        return -(-round(1000 * REACH) * len(self._all) // 1000)

    @property
    def needed(self) -> int:
        """The least overlap that meets the threshold (in integers: thresholds count in thousandths)."""
        return max(1, -(-round(1000 * self.threshold) * len(self.words) // 1000))


#: Customary notices.
TEMPLATES = (
    Template("mit", "Released under the MIT License."),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("all-rights-reserved", "All rights reserved."),
)


def spaced_words(text: Column) -> Column:
    """The words of a text, joined by single spaces."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _spaces(s: Column) -> Column:
    return (F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def _word_at(padded: Column, place: Column) -> Column:
    """The number of the word behind the space at a place (from 1) of the padded words."""
    return _spaces(F.substring(padded, F.lit(1), place)) - 1


def base_columns(padded: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and the array of labels."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        p = f" {phrase} "
        there = F.contains(padded, F.lit(p))
        # places may share the space between them, hence the look-ahead
        counts.append(F.when(there, F.regexp_count(padded, F.lit(f"(?={p})"))).otherwise(0))
        firsts.append(F.when(there, _word_at(padded, F.locate(p, padded))))
        lasts.append(F.when(there, _word_at(padded, F.char_length(padded) - F.locate(p[::-1], F.reverse(padded)) - F.lit(len(p) - 2))))
        labels.append(F.when(there, F.lit(label)))
    return {
        "n_base": reduce(lambda a, b: a + b, counts).cast("long"),
        "first_word": F.least(*firsts) if len(firsts) > 1 else firsts[0],
        "last_word": F.greatest(*lasts) if len(lasts) > 1 else lasts[0],
        "base": F.array_compact(F.array(*labels)),
    }


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def word_order(words: Column, docs: DataFrame, templates: tuple[Template, ...]) -> list[str]:
    """The templates' words, those of the fewest documents first (ties by word)."""
    vocabulary = sorted({w for t in templates for w in t.words})
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError("the templates have over MAX_TEMPLATE_WORDS words")
    found = docs.select(F.explode(F.array_intersect(words, _strings(vocabulary))).alias("w")).groupBy("w").count()
    count = {r[0]: r[1] for r in found.collect()}  # a row for each template word at most
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def _table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def template_words(texts: DataFrame, order: list[str], reach: int) -> DataFrame:
    """(doc_id, _h, chunk, own) of texts (doc_id, _h, candidate): own has (at, rank) of the template words in and about a chunk."""
    rank = _table(texts.sparkSession, [{"word": w, "rank": i} for i, w in enumerate(order)], pa.schema([("word", pa.string()), ("rank", pa.int32())]))
    words = texts.select("doc_id", "_h", F.posexplode(F.split("candidate", " ")).alias("at", "word"))
    # MAX_TEMPLATE_WORDS rows at most
    placed = words.join(F.broadcast(rank), "word")
    near = F.sequence(F.floor((F.col("at") - reach) / CHUNK), F.floor((F.col("at") + reach) / CHUNK))
    # a set: repeated rows have equal places, and count once
    return placed.select("doc_id", "_h", "at", "rank", F.explode(near).alias("chunk")).groupBy("doc_id", "_h", "chunk").agg(F.collect_set(F.struct("at", "rank")).alias("own"))


def matching_blocks(chunks: DataFrame, templates: tuple[Template, ...], order: list[str]) -> DataFrame:
    """(doc_id, _h, template, label, overlap, containment) of all blocks that meet a template."""
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for t, template in enumerate(templates):
        ranks = sorted(rank[w] for w in template.words)
        own = {"template": t, "label": template.label, "n": len(ranks), "needed": template.needed, "reach": template.reach, "ranks": ranks}
        index += [{"token": r, "i": i} | own for i, r in enumerate(ranks[: len(ranks) - template.needed + 1])]
    small = ("token", "i", "template", "n", "needed", "reach")
    prefixes = _table(chunks.sparkSession, index, pa.schema([(n, pa.int32()) for n in small] + [("label", pa.string()), ("ranks", pa.list_(pa.int32()))]))
    tokens = sorted({x["token"] for x in index})
    widest = max((t.reach for t in templates), default=1)
    inside = F.filter("own", lambda o: (F.floor(o.at / CHUNK) == F.col("chunk")) & o.rank.isin(tokens))
    around = F.transform(inside, lambda o: F.struct(o.rank.alias("token"), o["at"].alias("at"), F.filter("own", lambda x: F.abs(x.at - o["at"]) < widest).alias("near")))
    hits = chunks.select("doc_id", "_h", F.explode(around).alias("hit")).select("doc_id", "_h", "hit.*")
    # the index is bounded by the template list
    hits = hits.join(F.broadcast(prefixes), "token")
    starts = F.filter("near", lambda s: (s.at <= F.col("at")) & (s.at > F.col("at") - F.col("reach")) & F.array_contains("ranks", s.rank))

    def block(s: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(F.filter("near", lambda x: (x.at >= s.at) & (x.at < s.at + F.col("reach"))), lambda x: x.rank)))

    blocks = hits.select("doc_id", "_h", "token", "template", "label", "i", "n", "needed", "ranks", F.explode(F.array_distinct(F.transform(starts, block))).alias("have"))
    blocks = blocks.withColumn("m", F.size("have")).withColumn("j", F.array_position("have", F.col("token")) - 1)
    fits = blocks.where("m >= needed AND least(n - i, m - j) >= needed")
    # a pair is verified at its first common word only
    first = fits.withColumn("common", F.array_intersect("have", "ranks")).where(F.get("common", F.lit(0)) == F.col("token"))
    met = first.withColumn("overlap", F.size("common")).where("overlap >= needed")
    return met.select("doc_id", "_h", "template", "label", "overlap", (F.col("overlap") / F.col("n")).alias("containment"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    phrases = PHRASES if phrases is None else phrases
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), spaced_words(F.col("text")).alias("spaced"))
    order = word_order(F.split("spaced", " "), texts, templates)
    rank = {w: i for i, w in enumerate(order)}
    probes = sorted({w for t in templates for w in sorted(t.words, key=rank.get)[: len(t.words) - t.needed + 1]})
    padded = F.concat(F.lit(" "), "spaced", F.lit(" "))
    base = base_columns(padded, phrases)
    n_words = F.when(F.col("spaced") == "", F.lit(0).cast("long")).otherwise(_spaces(F.col("spaced")) + 1)
    may = F.arrays_overlap(F.split("spaced", " "), _strings(probes))
    looked, _ = stored(texts.select("doc_id", "_h", n_words.alias("n_words"), *[c.alias(k) for k, c in base.items()], F.when(may, F.col("spaced")).alias("candidate")), "licenses")
    chunks = template_words(looked.where("candidate IS NOT NULL"), order, max((t.reach for t in templates), default=1))
    met = matching_blocks(chunks, templates, order)
    by_doc = met.groupBy(F.col("doc_id").alias("_d"), F.col("_h").alias("_k")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    rows = looked.drop("candidate").join(by_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_k")), "left")
    every = F.concat("base", F.coalesce("more", F.array().cast("array<string>")))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    """Every window that begins at a template's word against the template, and every place against every phrase, in DuckDB."""
    def listed(words) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    templates = ", ".join(f"({i}, '{t.label}', {t.needed}, {t.reach}, {listed(t.words)})" for i, t in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{v}', {listed(k.split())})" for k, v in PHRASES.items())
    cut = f"list_filter(regexp_split_to_array(translate({{}}, '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {cut.format("coalesce(text, '')")} AS words FROM documents),
templates(k, label, needed, reach, words) AS (VALUES {templates}),
phrases(label, words) AS (VALUES {phrases}),
places AS (
  SELECT d.doc_id, p.label, unnest(list_filter(range(len(d.words)), lambda i: d.words[i + 1 : i + len(p.words)] = p.words)) AS place FROM d, phrases p
),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list_distinct(list(label)) AS labels FROM places GROUP BY doc_id),
met AS (
  SELECT d.doc_id, t.label, t.needed, len(t.words) AS n,
    list_max(list_transform(list_filter(range(len(d.words)), lambda i: list_contains(t.words, d.words[i + 1])), lambda i: len(list_intersect(d.words[i + 1 : i + t.reach], t.words)))) AS overlap
  FROM d, templates t
),
more AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(overlap / n) AS best FROM met WHERE overlap >= needed GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  greatest(coalesce(m.best, 0.0), CASE WHEN b.n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN base b USING (doc_id) LEFT JOIN more m USING (doc_id)
"""


SQL = _sql()
