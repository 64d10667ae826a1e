"""Scoring of samples as they arrive: an extension for long evaluations.

Every page metric is a function of one page, so the only state is that which keeps a page from counting twice
(watermarked) and the running sums of the aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import scoring as sc


def first_samples(samples: DataFrame, event_time: str = "arrived", delay: str = "1 hour") -> DataFrame:
    """A stream of (document_id, page_id, sample, event time) without later repeats within the watermark."""
    return samples.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(sc.KEYS)


def stream_observations(samples: DataFrame, manifest: DataFrame, truth: DataFrame) -> DataFrame:
    """Observations of scored pages of a stream: it joins static tables, hence no join state."""
    known = manifest.join(truth.select(*sc.KEYS, "truth"), sc.KEYS)
    page = F.col("sample.page")
    same = (page.page_id == F.col("page_id")) & (page.page_index == F.col("page_index")) & page.checksum.eqNullSafe(F.col("checksum"))
    scored = samples.join(known, sc.KEYS).where((F.col("sample.status") == "success") & F.coalesce(same, F.lit(False)))
    return sc.page_observations(scored)


def running_metrics(observations: DataFrame) -> DataFrame:
    """micro, macro, sample_count by category and metric, for output mode complete or update."""
    sums = observations.groupBy("category", "metric").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.avg("value").alias("macro"), F.sum("n").alias("sample_count"))
    return sums.select("category", "metric", (F.col("num") / F.greatest("den", F.lit(1.0))).alias("micro"), "macro", "sample_count")


def running_status(samples: DataFrame) -> DataFrame:
    return samples.groupBy(F.col("sample.status").alias("status")).count()
