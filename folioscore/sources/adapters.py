"""Systems under test: predictions from files, a fake system, and failures as samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import contracts as C
from . import schemas as S


class PublicPredictions:
    """Predictions that a system has published as an artifact."""

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        return C.read_artifact(spark, "prediction", path)

    def samples(self, spark: SparkSession, path: str) -> DataFrame:
        return C.samples(self.load(spark, path))


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return PublicPredictions().load(spark, path)


def failed_samples(pages: DataFrame, status: str, code: str, message: str, retryable: bool = False) -> DataFrame:
    """A sample of a failure for each page (document_id, page_id)."""
    error = F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(None).cast("string").alias("stage"), F.lit(retryable).alias("retryable"))
    sample = F.struct(
        F.col("document_id").alias("document_id"), F.col("page_id").alias("page_id"), F.lit(status).alias("status"), F.lit(None).cast(S.PAGE).alias("page"), error.alias("error"),
        F.lit(None).cast("double").alias("runtime_ms"), F.lit(None).cast("double").alias("peak_memory_mb"),
    )
    return pages.select("document_id", "page_id", sample.alias("sample"))


def numbered(pages: DataFrame) -> DataFrame:
    """``rn``, from 1 in the order of (doc_pos, page_pos), without a window over all rows in one task.

    Documents are counted first (a row each), and only those counts are summed in order, in ranges of documents; a page's
    number is its document's start and its place in it.
    """
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = pages.agg(F.min("doc_pos"), F.max("doc_pos")).first()
    if ends[0] is None:
        return pages.withColumn("rn", F.lit(0).cast("long"))
    width = max(1, -(-(ends[1] - ends[0] + 1) // n))
    docs = pages.groupBy("doc_pos").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.floor((F.col("doc_pos") - ends[0]) / width))
    parts = docs.groupBy("part").agg(F.sum("n").alias("n"))  # as many rows as partitions at most
    starts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = docs.withColumn("within", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("doc_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = inner.join(starts, "part").select("doc_pos", (F.col("before") + F.col("within")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("doc_pos").orderBy("page_pos"))
    return pages.join(first, "doc_pos").withColumn("rn", F.col("_first") + place).drop("_first")


def fake_predictions(manifest: DataFrame, truth: DataFrame, fail_every: int = 0) -> DataFrame:
    """The ground truth as samples, every fail_every-th page (from 1, in order) crashed."""
    if fail_every < 0:
        raise ValueError("fail_every is below 0")
    rows = truth.join(manifest.select("document_id", "page_id", "doc_pos", "page_pos"), ["document_id", "page_id"])
    good = F.struct(
        F.col("document_id").alias("document_id"), F.col("page_id").alias("page_id"), F.lit("success").alias("status"), F.col("truth").alias("page"),
        F.lit(None).cast(S.ERROR).alias("error"), F.lit(None).cast("double").alias("runtime_ms"), F.lit(None).cast("double").alias("peak_memory_mb"),
    )
    if not fail_every:
        return rows.select("document_id", "page_id", good.alias("sample"))
    rows = numbered(rows)
    bad = failed_samples(rows.where(F.col("rn") % fail_every == 0), "crashed", "fake_failure", "made to fail")
    return rows.where(F.col("rn") % fail_every != 0).select("document_id", "page_id", good.alias("sample")).unionByName(bad)
