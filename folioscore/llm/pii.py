"""Information-theoretic sanitisation of personal data.

Base: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers, found by fixed patterns. Each found
value is a protected entity c. A term t near an entity (NEAR words on either side) may give it away even when
the value is masked. How much it tells is estimated on the whole corpus, whose copies count once: with P(c|t) = texts with t
near c / texts with t, and the information content IC(c) = log2(texts / texts with c), the disclosure is

    PMI(c; t) / IC(c) = log2(P(c|t) / P(c)) / IC(c),

1 if t occurs with c only. Terms with a disclosure of at least REMOVE_AT are removed where they stand near
c, those of at least GENERALISE_AT are generalised to a class. A pair counts only if chance doesn't explain it: were t spread
over the texts regardless of c, its contexts would meet those of c so often with a probability (Chernoff's bound
of the binomial tail) of at most CHANCE / pairs in the corpus. Contexts are different windows, one a text at most, so copies and near
copies prove nothing more; how many contexts it takes depends on the corpus (two, mostly, for a rare term; one only where
entities are few).

One pass finds spans and contexts of every document; both are stored as flat rows without the texts. Pair counts are
pre-aggregated, document frequencies are counted for the terms that are left, over all documents. No count is sampled and
the tables are stored, so Spark knows their sizes; broadcast by hand are only terms that have been counted before.

Edge cases: null and empty texts have no spans (the digest is that of the empty string). Equal starts are
ordered by kind as listed, terms last. Repeated rows get equal rows; equal doc_ids with other texts are kept apart
by the text's hash. Very long texts are read whole: patterns run in linear time, and contexts leave the worker as they
are found. An empty table gives none. Other columns, whatever their names, are ignored by the report and kept by ``sanitise``.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, map_batches, mark, stored, unused

KINDS = ("email", "ip", "card", "phone", "term")
NEAR = 8
#: Pairs that may pass by chance in the whole corpus.
CHANCE = 0.05
GENERALISE_AT = 0.8
REMOVE_AT = 0.95
#: Letters of the terms that may be broadcast to be counted in the corpus.
WANTED_CHARS = 4_000_000
#: Rows that a Python worker holds before it gives them out.
PIECE = 4_096

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
#: What _TERM leaves out, for Java: no letter, and no numeral but decimal digits.
_BETWEEN_TERMS = r"[\P{L}&&[\P{N}\p{Nd}]]+"
#: The one letter whose lower case isn't a term: it gets a mark.
_DOTTED_I = "\u0130"

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Matches of ``local@domain``: from each @ back over the local part, so that long words cost nothing."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind."""
    out = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdecimal() for c in m[0]) <= 15]
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def entity_key(kind: int, value: str) -> int:
    """The hash of a value, whatever its case (e-mail, IP) or its separators (card, phone)."""
    plain = value.lower() if kind < 2 else re.sub(r"[^0-9]", "", value)
    return xxhash.xxh64_intdigest(f"{KINDS[kind]}:{plain}") - (1 << 63)


def contexts(text: str, spans: list[Span], near: int = NEAR) -> Iterator[tuple[int, int, str, int, int]]:
    """(entity, window, term, start, end): each term near each entity, with the hash of the terms around it.

    An entity without any gives one row, its own place with a null term: it counts among the texts with the entity.
    """
    if not spans:
        return
    starts = [s for s, _, _ in spans]
    reach = list(itertools.accumulate((e for *_, e in spans), max))  # the furthest end so far
    # places of the terms that overlap no span; two integers a term, however long the text is
    begins, ends = array("q"), array("q")
    for m in _TERM.finditer(text):
        i = bisect_left(starts, m.end())
        if i == 0 or reach[i - 1] <= m.start():
            begins.append(m.start())
            ends.append(m.end())
    for s, k, e in spans:
        entity = entity_key(k, text[s:e])
        left, right = bisect_left(begins, s), bisect_right(begins, e - 1)
        here = [*range(max(0, left - near), left), *range(right, min(right + near, len(begins)))]
        words = [lowered(text[begins[i] : ends[i]]) for i in here]
        window = xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)
        for w, i in zip(words, here, strict=True):
            yield entity, window, w, begins[i], ends[i]
        if not here:
            yield entity, window, None, s, e


_FOUND = "doc_id long, _h long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, entity long, window long, term string, start int, end int"
_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def _find(batch: pa.RecordBatch, near: int) -> Iterator[dict]:
    """A row for each text, and one for each context, in pieces of PIECE rows."""

    def rows() -> Iterator[tuple]:
        for doc, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans = base_spans(text or "")
            found = joined(spans)
            yield doc, h, *(sum(x[1] == k for x in spans) for k in range(4)), hashlib.sha256(found.encode()).hexdigest(), found, None, None, None, None, None
            for context in contexts(text or "", spans, near):
                yield doc, h, None, None, None, None, None, None, *context

    made = rows()
    while piece := list(itertools.islice(made, PIECE)):
        yield dict(zip(_NAMES, zip(*piece, strict=True), strict=True))


def findings(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """Rows of two kinds: each document's base spans (``base_sha256`` is given) and each context (``entity`` is given).

    ``_h`` is the text's hash. Rows are flat, and come in pieces of bounded size, so that a dense text takes no memory.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_h"), "text")
    return map_batches(rows, functools.partial(_find, near=near), _FOUND)


def _contexts_of(found: DataFrame) -> DataFrame:
    return found.where("entity IS NOT NULL").select("doc_id", "_h", "entity", "window", "term", "start", "end")


def lowered(term: str) -> str:
    return term.replace(_DOTTED_I, "I").lower()


def corpus_terms(text: Column) -> Column:
    """The distinct terms of a text, as _TERM finds them and lowered() has them (shorter ones too)."""
    low = F.lower(F.replace(text, F.lit(_DOTTED_I), F.lit("I")))
    return F.array_distinct(F.split(low, _BETWEEN_TERMS))


def _disclosure(both, of_term, of_entity, n):
    """PMI / IC; 0 where an entity tells nothing."""
    content = F.log2(F.greatest(n / of_entity, F.lit(1.0)))
    return F.when(content > 0, 1 + F.log2(both / F.greatest(of_term, both)) / content).otherwise(0.0)


def _log_chance(of_term, n):
    """The log of a bound on the probability that a term of so many texts meets an entity in so many contexts by chance."""
    b = F.col("contexts").cast("double")
    t = F.greatest(of_term - (F.col("both") - b), b)  # near copies count once
    p, share = F.least(F.col("of_contexts") / n, F.lit(1.0)), b / t
    others = F.when(t > b, (t - b) * F.log((1 - share) / (1 - p))).otherwise(0.0)
    return F.when(share > p, -(b * F.log(share / p) + others)).otherwise(0.0)


def corpus_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, of_term): the texts with each wanted term, copies counting once.

    Where the wanted terms are few (WANTED_CHARS of them, counted first), they are broadcast, and only they move, with the hashes
    of their texts. Beyond that, texts are made distinct and all their terms counted.
    """
    chars = wanted.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    if chars <= WANTED_CHARS:
        tokens = docs.select(F.xxhash64("text").alias("_h"), F.explode(corpus_terms(F.col("text"))).alias("term"))
        return tokens.join(F.broadcast(wanted), "term", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("of_term"))
    # distinct by the text itself, so map-side partials drop the copies of hot groups
    tokens = docs.select("text").distinct().select(F.explode(corpus_terms(F.col("text"))).alias("term"))
    # counted before the join: it then meets a row for each word, not one for each word of each document
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("of_term")).join(wanted, "term", "left_semi")


def disclosures(found: DataFrame, docs: DataFrame, chance: float = CHANCE, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """(entity, term, disclosure) of the pairs beyond chance that disclose at least generalise_at.

    A term's texts are at least those with it near an entity. Pairs that stay below a limit even so are
    dropped before the corpus is counted: that keeps common words out of the join, and changes no result.
    """
    n = F.lit(float(found.where("base_sha256 IS NOT NULL").select("_h").distinct().count()))
    near = _contexts_of(found).select("_h", "entity", "term", "window").distinct()
    texts, contexts = F.count_distinct("_h"), F.least(F.count_distinct("_h"), F.count_distinct("window"))
    pairs, _ = stored(near.where("term IS NOT NULL").groupBy("entity", "term").agg(texts.alias("both"), contexts.alias("contexts")), "contexts")
    limit = F.log(F.lit(chance / max(pairs.count(), 1)))
    entities = near.groupBy("entity").agg(texts.alias("of_entity"), contexts.alias("of_contexts"))
    # drops most pairs with one context, as chance may explain even a term of no other text
    pairs = pairs.join(entities, "entity").where(_log_chance(F.col("both"), n) <= limit)
    least = near.where("term IS NOT NULL").groupBy("term").agg(F.count_distinct("_h").alias("least"))
    may = pairs.join(least, "term").where((_disclosure(F.col("both"), F.col("least"), F.col("of_entity"), n) >= generalise_at) & (_log_chance(F.col("least"), n) <= limit))
    kept, _ = stored(may.drop("least"), "pairs")
    wanted, _ = stored(kept.select("term").distinct(), "terms")
    of_term = corpus_counts(docs, wanted)
    told = kept.join(of_term, "term", "left").withColumn("disclosure", _disclosure(F.col("both"), F.coalesce("of_term", F.lit(0)), F.col("of_entity"), n))
    sure = _log_chance(F.greatest(F.coalesce("of_term", F.lit(0)), F.col("both")), n) <= limit
    return told.where((F.col("disclosure") >= generalise_at) & sure).select("entity", "term", "disclosure")


def term_spans(found: DataFrame, docs: DataFrame, chance: float = CHANCE, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """(doc_id, _h, terms): the spans of each document's disclosing terms, and how much they disclose."""
    point = mark()
    told, _ = stored(disclosures(found, docs, chance, generalise_at), "disclosures", point)
    hits = _contexts_of(found).join(told, ["entity", "term"]).groupBy("doc_id", "_h", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    return hits.groupBy("doc_id", "_h").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "disclosure")).alias("terms"))


def _parsed(base: Column) -> Column:
    """The spans of a joined string as (start, kind, end)."""
    names = F.array(*map(F.lit, KINDS))

    def span(x: Column) -> Column:
        part = F.split(x, ":")
        return F.struct(F.get(part, 1).cast("int").alias("start"), (F.array_position(names, F.get(part, 0)) - 1).cast("int").alias("kind"), F.get(part, 2).cast("int").alias("end"))

    return F.transform(F.filter(F.split(base, ","), lambda x: x != ""), span)


def report(docs: DataFrame, near: int = NEAR, chance: float = CHANCE, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """doc_id, counts, base_sha256 and all spans of each row."""
    found, _ = stored(findings(docs, near), "findings")
    terms = term_spans(found, docs, chance, generalise_at).select(F.col("doc_id").alias("_d"), F.col("_h").alias("_k"), "terms")
    rows = found.where("base_sha256 IS NOT NULL").join(terms, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_k")), "left")
    more = F.transform("terms", lambda t: F.struct(t.start.alias("start"), t.kind.alias("kind"), t.end.alias("end")))
    names = F.array(*map(F.lit, KINDS))
    every = F.transform(F.array_sort(F.concat(_parsed(F.col("base")), more)), lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string")))
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_join(every, ","))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


def sanitised(text: str, terms: list[dict], remove_at: float = REMOVE_AT) -> str:
    """The text with base spans masked by kind and its disclosing terms removed or generalised."""
    marks = [(s, e, f"[{KINDS[k].upper()}]") for s, k, e in base_spans(text)]
    for t in terms or ():
        s, e = t["start"], t["end"]
        marks.append((s, e, "[REMOVED]" if t["disclosure"] >= remove_at else "[NAME]" if text[s].isupper() else "[WORD]"))
    out, at = [], 0
    for s, e, mask in sorted(marks):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]


def _sanitise(batch: pa.RecordBatch, remove_at: float, terms: str) -> pa.RecordBatch:
    names = batch.schema.names
    texts = batch.column(names.index("text")).to_pylist()
    clean = [None if t is None else sanitised(t, x, remove_at) for t, x in zip(texts, batch.column(names.index(terms)).to_pylist(), strict=True)]
    keep = [n for n in names if n != terms]
    return pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if n == "text" else batch.column(names.index(n)) for n in keep], names=keep)


def sanitise(docs: DataFrame, near: int = NEAR, chance: float = CHANCE, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """The rows of docs with their texts sanitised (and n_chars, if there, counted again)."""
    found, _ = stored(findings(docs, near), "findings")
    h, d, k, terms = unused(docs, "_h", "_d", "_k", "terms")
    told = term_spans(found, docs, chance, generalise_at).select(F.col("doc_id").alias(d), F.col("_h").alias(k), F.col("terms").alias(terms))
    rows = docs.withColumn(h, F.xxhash64("text")).join(told, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(k)), "left").drop(h, d, k)
    out = map_batches(rows, functools.partial(_sanitise, remove_at=remove_at, terms=terms), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
