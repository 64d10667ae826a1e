"""URL filter on a sorted digest array.

The rules' keys (host + path prefix) are hashed with 64-bit xxHash, sorted and written as one file:
the keys, the offsets of the rule strings, and the strings. The file goes to each executor once
(SparkContext.addFile) and is memory-mapped, so all Python workers of an executor share its pages.
A batch of urls becomes one array of candidate digests, probed by one vectorised binary search; each
hit is confirmed against the stored string, so that a digest collision can't change a verdict.

Size bound: the index holds the rule list, not the data. ``UrlRules.build`` refuses a list of more
than ``max_bytes`` (default 4 GB); beyond it, ``judge_by_join`` gives the same rows by an equi-join of
candidate keys with the rules as a table.

Edge cases: a null url or one without ``://`` has an empty host and path, no rule and the default
verdict. An empty path (``http://a.org``) starts with no rule's ``/``. Repeated rows are judged each;
of a rule that is listed twice, ``block`` wins; of two fitting rules of equal length, the one with the
longer host. Very long urls are probed only at domains that a rule's host can equal (by labels and length), so they cost no more
than their length. Empty tables give empty results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import map_batches

#: The rules of the production query, by verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


@dataclass(frozen=True)
class UrlRules:
    """A digest file: its name among the session's files, and what the rules' keys look like, which bounds the probes of a url."""

    file: str
    n: int
    path_lengths: tuple[int, ...]
    #: (labels, longest host of so many labels), ascending
    hosts: tuple[tuple[int, int], ...]

    @staticmethod
    def build(spark: SparkSession, rules: dict[str, str], max_bytes: int = 4_000_000_000) -> UrlRules:
        """rules: ``host/path`` to ``allow`` or ``block``; the host is lower case, the path starts at the first ``/``."""
        if bad := [r for r, v in rules.items() if "/" not in r or v not in ("allow", "block")]:
            raise ValueError(f"not rules: {bad[:3]}")
        texts = [r.encode() for r in rules]
        if sum(map(len, texts)) + 25 * len(texts) > max_bytes:
            raise ValueError("the rule list is over max_bytes; use judge_by_join")
        keys = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))
        order = np.argsort(keys, kind="stable")
        ends = np.cumsum([0, *(len(texts[i]) for i in order)], dtype=np.int64)
        blocks = np.fromiter((v == "block" for v in rules.values()), np.uint8, len(texts))[order]
        data = keys[order].tobytes() + ends.tobytes() + blocks.tobytes() + b"".join(texts[i] for i in order)
        name = f"url-rules-{hashlib.sha256(data).hexdigest()[:16]}.bin"
        if name not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
            path = os.path.join(tempfile.mkdtemp(), name)
            with open(path, "wb") as f:
                f.write(data)
            spark.sparkContext.addFile(path)
        lengths, longest = set(), {}
        for r in rules:
            at = r.index("/")
            lengths.add(len(r) - at)
            labels = r.count(".", 0, at) + 1
            longest[labels] = max(longest.get(labels, 0), at)
        return UrlRules(name, len(texts), tuple(sorted(lengths)), tuple(sorted(longest.items())))


class DigestArray:
    """The memory-mapped side: sorted keys, offsets, verdicts and strings."""

    def __init__(self, path: str, n: int):
        raw = np.memmap(path, np.uint8, "r") if n else np.zeros(8, np.uint8)
        self.keys = raw[: 8 * n].view(np.uint64)
        self.ends = raw[8 * n : 16 * n + 8].view(np.int64)
        self.blocks = raw[16 * n + 8 : 17 * n + 8]
        self.strings = raw[17 * n + 8 :]

    def probe(self, candidates: list[bytes], digests: np.ndarray) -> np.ndarray:
        """Index of the stored string equal to each candidate, or -1."""
        found = np.full(len(digests), -1, np.int64)
        at = np.searchsorted(self.keys, digests)
        open_ = np.flatnonzero(at < len(self.keys))
        while len(open_):  # past the first hit only where digests collide
            open_ = open_[self.keys[at[open_]] == digests[open_]]
            same = np.fromiter((self.strings[self.ends[at[i]] : self.ends[at[i] + 1]].tobytes() == candidates[i] for i in open_), bool, len(open_))
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.keys)]
        return found


@functools.lru_cache(maxsize=4)
def _opened(path: str, n: int) -> DigestArray:
    return DigestArray(path, n)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to ``/ ? #``, A-Z lower-cased, and the path up to ``? #``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: str, hosts: tuple[tuple[int, int], ...]) -> Iterator[str]:
    """The host and the domains above it, as far as they have the labels and the length of a rule's host."""
    at, have = len(host), 0
    for labels, longest in hosts:
        while have < labels and at >= 0:
            at = host.rfind(".", 0, at)
            have += 1
        if have < labels:
            return
        if len(host) - at - 1 <= longest:
            yield host[at + 1 :]


def _judge(batch: pa.RecordBatch, rules: UrlRules, default: str) -> pa.RecordBatch:
    names = batch.schema.names
    hosts, paths = (batch.column(names.index(c)) for c in ("host", "path"))
    index = _opened(SparkFiles.get(rules.file), rules.n)
    # One probe for each distinct pair of host and path start: a hot host costs no more than a rare one.
    starts = pc.utf8_slice_codeunits(paths, 0, max(rules.path_lengths, default=0))
    pairs = pa.StructArray.from_arrays([hosts, starts], ["h", "p"]).to_pylist()
    seen: dict[tuple[str, str], int] = {}
    where = np.fromiter((seen.setdefault((x["h"], x["p"]), len(seen)) for x in pairs), np.int64, len(pairs))
    candidates, owner = [], []
    for i, (host, start) in enumerate(seen):
        for suffix in suffixes(host, rules.hosts):
            for n in rules.path_lengths:
                if len(start) >= n:
                    candidates.append((suffix + start[:n]).encode())
                    owner.append(i)
    digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
    best: dict[int, tuple[int, int, int]] = {}
    for c in np.flatnonzero((hit := index.probe(candidates, digests)) >= 0).tolist():
        text = candidates[c].decode()
        rank = (len(text), text.index("/"), int(hit[c]))
        best[owner[c]] = max(best.get(owner[c], rank), rank)
    rule = [None] * len(seen)
    verdict = [default] * len(seen)
    for i, (_, _, k) in best.items():
        rule[i] = index.strings[index.ends[k] : index.ends[k + 1]].tobytes().decode()
        verdict[i] = "block" if index.blocks[k] else "allow"
    take = pa.array(where)
    columns = [*batch.columns, pa.array(rule, pa.string()).take(take), pa.array(verdict, pa.string()).take(take)]
    return pa.RecordBatch.from_arrays(columns, names=[*names, "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: UrlRules, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict of each row; only the id and url columns are read."""
    host, path = host_and_path(F.col(url_col))
    wanted = pages.select(id_col, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    schema = StructType([*wanted.schema, StructField("rule", StringType()), StructField("verdict", StringType())])
    return map_batches(wanted, functools.partial(_judge, rules=rules, default=default), schema)


def judge_by_join(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """judge_urls for rule lists (rule, verdict) too large for an executor: candidates are joined by key.

    Distinct (host, path start) pairs are judged once, so a hot host is one row before the join. Only domains with as many
    labels as a rule's host are candidates.
    """
    place = F.locate("/", F.col("rule"))
    # distinct lengths and label counts: no more than the longest rule has characters
    shape = rules.agg(F.collect_set(F.char_length("rule") - place + 1), F.collect_set(F.regexp_count(F.substr("rule", F.lit(1), place), F.lit(r"\.")) + 1)).first()
    path_lengths, label_counts = (sorted(x) for x in shape)
    host, path = host_and_path(F.col(url_col))
    longest = max(path_lengths, default=0)
    rows = pages.select(F.col(id_col).alias("_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")).withColumn("_p", F.substring("path", 1, longest))
    distinct = rows.select("host", "_p").distinct()
    labels = F.regexp_count(F.col("host"), F.lit(r"\.")) + 1

    def listed(of: list[Column]) -> Column:
        return F.array_compact(F.array(*of)) if of else F.array().cast("array<string>")

    tails = listed([F.when(labels >= n, F.substring_index("host", ".", -n)) for n in label_counts])
    starts = listed([F.when(F.char_length("_p") >= n, F.substring("_p", 1, n)) for n in path_lengths])
    keyed = distinct.select("host", "_p", F.explode(tails).alias("_t"), starts.alias("_s")).select("host", "_p", "_t", F.explode("_s").alias("_x")).withColumn("rule", F.concat("_t", "_x"))
    fits = keyed.join(rules.groupBy("rule").agg(F.max("verdict").alias("verdict")), "rule")
    best = fits.groupBy("host", "_p").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.char_length("rule"), F.char_length("_t"))).alias("_w"))
    return rows.join(best, ["host", "_p"], "left").select(F.col("_id").alias(id_col), "host", "path", F.col("_w.rule").alias("rule"), F.coalesce("_w.verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, UrlRules.build(spark, RULES))


SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule, rhost, rpath, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), best AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY ALL
)
SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b USING (page_id, host, path)
"""
