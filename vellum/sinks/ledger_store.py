"""Ledger and external tables.

The ledger is a Parquet table partitioned by database and table, so every
per-table read (replay, audit) prunes to its own directories.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vellum.operators.diff import LEDGER_COLUMNS, LEDGER_SCHEMA

# External table formats accepted by register_external.
EXTERNAL_FORMATS = ["csv", "parquet"]

BLOOM_OPTIONS = {"parquet.bloom.filter.enabled#row_identifier": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def _ddl_columns() -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in LEDGER_SCHEMA.fields)


def _quoted(text: str) -> str:
    """``text`` as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_ledger(spark: SparkSession, table: str, location: str | None = None, by_batch: bool = False) -> None:
    """Create the ledger table if it does not exist.

    Row identifiers get Bloom filters beside the min/max statistics, so that a
    row-history lookup (D9) skips row groups also where each batch spans all keys.
    ``by_batch`` adds a ``batch`` partition for exactly-once appends.
    """
    loc = f" LOCATION {_quoted(location)}" if location else ""
    columns, parts = _ddl_columns(), "database_name, table_name"
    if by_batch:
        columns, parts = columns + ", `batch` STRING", "batch, " + parts
    options = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in BLOOM_OPTIONS.items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet OPTIONS ({options}) PARTITIONED BY ({parts}){loc}")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


def reset_ledger(spark: SparkSession, table: str, location: str | None = None, confirm: bool = False) -> None:
    """Drop and recreate empty.  Deletes data, so ``confirm=True`` is required."""
    if not confirm:
        raise ValueError("reset_ledger deletes every change record; pass confirm=True")
    by_batch = spark.catalog.tableExists(table) and "batch" in spark.table(table).columns
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    if location:
        _remove(spark, location)
    create_ledger(spark, table, location, by_batch)


def _folder(spark: SparkSession, table: str) -> str:
    return next(r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {table}").collect() if r.col_name == "Location")


def append_changes(changes: DataFrame, ledger_table: str, batch: str | None = None) -> int:
    """Append one batch of change records; returns how many were written
    (0 = no change).  The count is observed during the write, no extra scan.

    Records are sorted by row identifier within each written file, so the
    Parquet min/max statistics let a row-history lookup (D9) skip most row
    groups of a large ledger.

    A ledger made ``by_batch`` needs a ``batch`` id: the batch is a partition that
    the append replaces, and a commit record is written after it.  A batch that is
    sent again, after a lost driver or a retry, is so counted once, and
    ``committed_changes`` shows none that was left half written.
    """
    obs = Observation("ledger_append")
    spark = changes.sparkSession
    target_cols = spark.table(ledger_table).columns
    by_batch = "batch" in target_cols
    if by_batch != (batch is not None):
        raise ValueError("a batch id is needed by ledgers made by_batch, and only by those")
    rows = (changes.select(*LEDGER_COLUMNS).observe(obs, F.count(F.lit(1)).alias("n"))
            .sortWithinPartitions("database_name", "table_name", "row_identifier"))
    if not by_batch:
        rows.select(*target_cols).write.insertInto(ledger_table)
        return int(obs.get["n"])
    folder = _folder(spark, ledger_table)
    commit = f"{folder}/_commits/{hashlib.md5(batch.encode()).hexdigest()}"
    _remove(spark, commit)  # until it is whole again, the batch is not there
    names = [c for c in target_cols if c != "batch"]
    spark.sql(f"INSERT OVERWRITE {ledger_table} PARTITION (batch = {_quoted(batch)}, database_name, table_name) "
              "SELECT * FROM {rows}", rows=rows.select(*names))
    n = int(obs.get["n"])
    spark.range(1).select(F.lit(batch).alias("batch"), F.lit(n).cast("long").alias("records")).coalesce(1).write.mode("overwrite").parquet(commit)
    return n


def committed_batches(spark: SparkSession, ledger_table: str) -> DataFrame:
    """(batch, records) of every batch whose append finished."""
    folder = _folder(spark, ledger_table) + "/_commits"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.listStatus(path):
        return spark.createDataFrame([], "batch string, records long")
    return spark.read.schema("batch string, records long").parquet(folder + "/*")


def committed_changes(spark: SparkSession, ledger_table: str) -> DataFrame:
    """The records of committed batches of a ledger made ``by_batch``."""
    return spark.table(ledger_table).join(committed_batches(spark, ledger_table).select("batch"), "batch", "left_semi")


def register_external(spark: SparkSession, table: str, location: str, columns: list[dict],
                      fmt: str = "csv") -> None:
    """(re)register files at ``location`` as a table; CSV skips its header.

    ``location`` may name one file: the table then covers its folder.
    """
    fmt = fmt.lower()
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(location)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        location = p.getParent().toString()
    if fmt not in EXTERNAL_FORMATS:
        raise ValueError(f"format must be one of {EXTERNAL_FORMATS}")
    cols = ", ".join(f"`{c['name']}` {c['type']}" for c in columns)
    opts = " OPTIONS (header 'true', escape '\"')" if fmt == "csv" else ""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE {table} ({cols}) USING {fmt}{opts} LOCATION {_quoted(location)}")
