"""What the training-data operators share: Arrow batch mapping, shared tables, distributed ranks."""

from __future__ import annotations

import atexit
import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .. import session
from ..session import shared_dir as shared_dir
from ..session import ship_package

#: Text bytes that one call of a batch function gets at most (a single longer text goes alone).
SLICE_BYTES = 8_000_000


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice stay under SLICE_BYTES."""
    if column not in batch.schema.names or not batch.num_rows:
        yield batch
        return
    lengths = batch.column(batch.schema.names.index(column))
    sizes = pc.binary_length(lengths).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def _run(batches: Iterable[pa.RecordBatch], fn: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            if part.num_rows:
                out = fn(part)
                for some in (out,) if isinstance(out, dict | pa.RecordBatch) else out:
                    yield some if isinstance(some, pa.RecordBatch) else pa.RecordBatch.from_pydict(some, schema=schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | pa.RecordBatch | Iterator[dict]], schema: str | StructType) -> DataFrame:
    """mapInArrow over slices of bounded text size; fn returns columns for the schema, or yields them in pieces."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(df.sparkSession)
    typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    # mapInArrow can't take names with a backtick or a dot: they get others on the way
    odd = [c for c in df.columns if "`" in c or "." in c]
    if not odd:
        return df.mapInArrow(functools.partial(_run, fn=fn, schema=to_arrow_schema(typed)), typed)
    name = dict(zip(odd, unused(df, *["_odd"] * len(odd)), strict=True))
    inner = StructType([StructField(name.get(f.name, f.name), f.dataType, f.nullable) for f in typed])
    out = df.toDF(*[name.get(c, c) for c in df.columns]).mapInArrow(functools.partial(_run, fn=fn, schema=to_arrow_schema(inner)), inner)
    return out.toDF(*typed.names)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


_written: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, tag: str, since: int | None = None) -> tuple[DataFrame, str]:
    """A table in the shared folder (see session.written), deleted at the process's end if not before.

    since: a mark; the tables written since then, which only df reads, are deleted afterwards.
    """
    table, path = session.written(df, tag)
    if since is not None:
        discard_since(df.sparkSession, since)
    _written.append((df.sparkSession, path))
    return table, path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that stored() has written and no plan reads any more."""
    _written[:] = [w for w in _written if w[1] not in paths]
    session.discard(spark, *paths)


def mark() -> int:
    """A point in time for discard_since."""
    return len(_written)


def discard_since(spark: SparkSession, point: int) -> None:
    """Delete all tables written since a mark: once the result that reads them has been written itself."""
    discard(spark, *[path for _, path in _written[point:]])


@atexit.register
def _sweep() -> None:
    for spark, path in list(_written):
        try:
            discard(spark, path)
        except Exception:  # the session has ended; its shared folder is the cluster's to clean
            return


def gapless_ranks(df: DataFrame, group: list[str], order: list[Column], spread: Column, name: str, buckets: int = 64) -> DataFrame:
    """Number the rows of each group from 0 without a gap, whatever a group's size.

    A window over a whole group would put a hot group into one task. Here ``spread`` (a long hash of
    the row) splits each group into ``buckets`` sub-groups; only their counts (groups x buckets rows)
    are summed up, and a window numbers each sub-group. More data means more buckets, see
    :func:`bucket_count`.
    """
    parts = df.withColumn("_b", F.pmod(spread, F.lit(buckets)).cast("int"))
    counts = parts.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_gb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)).cast("long") - 1)
    on = (F.col("_b") == F.col("_gb")) & functools.reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)])
    out = ranked.join(starts, on).withColumn(name, F.col("_start") + F.col("_r"))
    return out.drop("_b", "_gb", "_start", "_r", *[f"_g{i}" for i in range(len(group))])


def bucket_count(spark: SparkSession) -> int:
    """Sub-groups for gapless_ranks: a few for each shuffle partition, which the cluster sizes to the data."""
    return max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
