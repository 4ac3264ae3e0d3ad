"""Materialise an intermediate result in the shared folder and size it.

Used where a plan must choose between broadcasting a derived table and a
shuffle join: the table is written once under ``spark.checkpoint.dir``
(which also cuts lineage, so a lost executor recomputes from the written
files, not from the raw inputs), and its size in memory, estimated from its
rows, decides the strategy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vellum.session import scratch_dir

#: how much larger a table is taken to be in memory than in its files
EXPANSION = 4


def materialize(df: DataFrame, name: str, metrics: list[Column] | None = None,
                compression: str | None = None) -> tuple[DataFrame, int, dict]:
    """Write ``df`` as Parquet in the shared scratch folder; return the
    re-read DataFrame, its estimated size in memory in bytes, and any
    ``metrics`` (aggregate Columns) observed during that same write.

    The estimate is the larger of rows times the schema's row width and
    ``EXPANSION`` times the bytes on disk: the files are compressed, so their
    own size says too little."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    obs = Observation(name)
    df.observe(obs, F.count(F.lit(1)).alias("__rows"), *(metrics or [])).write.mode("overwrite").parquet(path, compression=compression)
    observed = dict(obs.get)
    rows = int(observed.pop("__rows"))
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    disk = int(fs.getContentSummary(p).getLength())
    size = max(EXPANSION * disk, rows * int(df._jdf.schema().defaultSize()))
    return spark.read.schema(df.schema).parquet(path), size, observed


def broadcast_limit(df: DataFrame) -> int:
    """The session's broadcast threshold in bytes (-1 disables broadcasts)."""
    raw = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    raw = raw.strip().lower()
    mult = 1
    for suffix, m in (("kb", 1 << 10), ("mb", 1 << 20), ("gb", 1 << 30), ("k", 1 << 10), ("m", 1 << 20),
                      ("g", 1 << 30), ("b", 1)):
        if raw.endswith(suffix):
            raw, mult = raw[: -len(suffix)], m
            break
    return int(float(raw) * mult)


def fits_broadcast(df: DataFrame, size: int) -> bool:
    limit = broadcast_limit(df)
    return 0 <= size <= limit and limit > 0
