"""Small helpers the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.session import scratch_dir

#: fixed values: the bytes that separate words (space, tab to carriage return)
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: the same, as a Java regex for one word
WORD_RE = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a stage boundary.

    The files outlive executors, so a lost executor never recomputes what lies
    behind the boundary.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays (``lower`` would touch more)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches, rows: int = 256):
    """Arrow batches in runs of few rows, so that a worker holds few texts at a time besides the batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def sized_chunks(batches, column: int, size: int):
    """Arrow batches in runs of about ``size`` bytes of text, a longer text by itself."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + size, "right")))
            yield b.slice(at, to - at)
            at = to


def byte_values(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def shuffle_width(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_prefix(df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the rows of the same ``keys`` before this one.

    Rows are dealt by range over ``keys`` and ``order`` (nulls last), summed
    within each range, and the ranges' totals are summed in turn, so that a key
    that holds most of the rows is spread over many tasks.
    """
    from pyspark.sql import Window as W

    by = [F.col(c).asc_nulls_last() for c in [*keys, *order]]
    dealt = materialize(df.withColumn("__amount", amount).repartitionByRange(shuffle_width(df), *by)
                        .withColumn("__range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*keys, "__range").agg(F.sum("__amount").alias("__total"))
    before = F.sum("__total").over(W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__range").alias("__r"),
                           F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.sum("__amount").over(W.partitionBy(*keys, "__range").orderBy(*by).rowsBetween(W.unboundedPreceding, -1))
    dealt = dealt.withColumn("__within", F.coalesce(within, F.lit(0)))
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return (dealt.join(totals, same).withColumn(name, F.col("__before") + F.col("__within"))
            .select(*[c for c in df.columns if c != name], name))
