"""Snapshot tables bucketed by their row key.

Two snapshots saved with the same key and bucket count join bucket to
bucket: the keyed diff (F2) and the replay's shuffle path then read both
sides without an exchange.  The files live at an explicit location (the
shared folder), the catalog only records the bucketing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_snapshot(df: DataFrame, table: str, key: str, buckets: int, path: str,
                  mode: str = "overwrite") -> str:
    """Write ``df`` as a Parquet table bucketed and sorted by ``key``."""
    (df.write.mode(mode).format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return table
