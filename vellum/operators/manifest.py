"""Manifest of landed files: derive, search, statistics, per-day counts
(C7, C10, C13, C14, D6, D7, H1-H3, J1, K1, K2).

The manifest is an ordinary table (one row per landed file); every operator
is a projection, filter, aggregate or top-k over it.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NA = "N/A"
MB = 1024 * 1024


def _digits_or_zero(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0)).when(c.rlike(r"^\d+$"), c.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def size_label(n_bytes: Column) -> Column:
    """'N bytes' / 'x.y KB' / 'x.y MB'; one decimal, half-even on the exact value."""
    b = n_bytes.cast("decimal(38,0)")
    kb = F.bround(b.cast("decimal(38,10)") / F.lit(1024), 1).cast("double")
    mb = F.bround(b.cast("decimal(38,20)") / F.lit(MB), 1).cast("double")
    return (F.when(n_bytes < 1024, F.concat(n_bytes.cast("string"), F.lit(" bytes")))
            .when(n_bytes < MB, F.format_string("%.1f KB", kb))
            .otherwise(F.format_string("%.1f MB", mb)))


def size_mb(n_bytes: Column) -> Column:
    # bytes / 2^20 is exact in binary and never a rounding tie at 2 decimals
    return F.round(n_bytes.cast("double") / F.lit(float(MB)), 2)


def derive_manifest(raw: DataFrame) -> DataFrame:
    """One record per landed file from listing + metadata columns.

    Expects ``file_key``, ``upload_date``, ``file_size_bytes`` and optionally
    ``original_filename``, ``schema_used``, ``row_count_text``,
    ``column_count_text``, ``upload_timestamp``.
    """
    cols = set(raw.columns)

    def opt(name: str) -> Column:
        return F.col(name) if name in cols else F.lit(None).cast("string")

    filename = F.element_at(F.split(F.col("file_key"), "/"), -1)
    iso = F.date_format(F.col("upload_date"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    keep = [c for c in raw.columns if c not in {
        "file_key", "original_filename", "upload_date", "file_size_bytes", "schema_used",
        "row_count_text", "column_count_text", "upload_timestamp"}]
    return raw.select(
        F.col("file_key"),
        filename.alias("filename"),
        F.lower(F.element_at(F.split(filename, r"\."), -1)).alias("extension"),
        F.coalesce(opt("original_filename"), F.lit(NA)).alias("original_filename"),
        F.col("upload_date"),
        F.col("file_size_bytes").cast("long").alias("file_size_bytes"),
        size_mb(F.col("file_size_bytes")).alias("file_size_mb"),
        size_label(F.col("file_size_bytes")).alias("size_label"),
        F.coalesce(opt("schema_used"), F.lit(NA)).alias("schema_used"),
        _digits_or_zero(opt("row_count_text")).alias("row_count"),
        _digits_or_zero(opt("column_count_text")).alias("column_count"),
        F.coalesce(opt("upload_timestamp"), iso).alias("upload_timestamp"),
        *keep)


def attach_metadata(listing: DataFrame, metadata: DataFrame) -> DataFrame:
    """Listing (file_key, file_size_bytes, upload_date) left-joined with
    per-file metadata; files without metadata keep defaults."""
    meta = metadata.drop("file_size_bytes", "upload_date")
    return derive_manifest(listing.join(meta, "file_key", "left"))


HISTORY_COLUMNS = ["filename", "original_filename", "upload_date", "file_size_mb",
                   "schema_used", "row_count", "column_count", "file_key"]


def history(manifest: DataFrame, limit: int = 50, prefix: str | None = None) -> DataFrame:
    """K1: newest first (sorted before the limit), ties by key; ``prefix``
    keeps the files whose key starts with it."""
    if prefix:
        manifest = manifest.filter(F.col("file_key").startswith(prefix))
    return (manifest.select(*HISTORY_COLUMNS)
            .orderBy(F.col("upload_date").desc(), F.col("file_key").asc()).limit(limit))


def history_view(manifest: DataFrame) -> DataFrame:
    """Display projection with defaults."""
    return manifest.select(
        F.coalesce(F.col("filename"), F.lit(NA)).alias("file"),
        F.col("upload_date").alias("uploaded_at"),
        F.coalesce(F.col("file_size_mb"), F.lit(0.0)).alias("size_mb"),
        F.coalesce(F.col("schema_used"), F.lit(NA)).alias("schema"),
        F.coalesce(F.col("row_count"), F.lit(0)).alias("rows"),
        F.coalesce(F.col("column_count"), F.lit(0)).alias("columns"))


def search(manifest: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """D6 + K2: case-blind LIKE on filename, original name or schema."""
    pat = f"%{term}%"
    hit = (F.col("filename").ilike(pat) | F.col("original_filename").ilike(pat)
           | F.col("schema_used").ilike(pat))
    return (manifest.filter(hit)
            .select("filename", "original_filename", "upload_date", "file_size_mb", "schema_used", "file_key")
            .orderBy(F.col("upload_date").desc(), F.col("file_key").asc()).limit(limit))


def manifest_stats(manifest: DataFrame, as_of: _dt.date) -> DataFrame:
    """H1: count, rounded total and mean size, total rows, files landed on ``as_of``.

    Sizes are summed as DECIMAL(18,2) so the total does not depend on the
    order partial sums are combined in.
    """
    mb = F.col("file_size_mb").cast("decimal(18,2)")
    return manifest.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.round(F.sum(mb), 2), F.lit(0)).cast("double").alias("total_size_mb"),
        F.coalesce(F.sum(F.col("row_count").cast("long")), F.lit(0)).alias("total_rows"),
        F.coalesce(F.round(F.avg(mb), 2), F.lit(0)).cast("double").alias("avg_file_size_mb"),
        F.count_if(F.to_date("upload_date") == F.lit(as_of)).alias("files_today"))


def top_schemas(manifest: DataFrame, n: int = 5) -> DataFrame:
    """H2: most used schemas, 'N/A' excluded, name breaks ties."""
    return (manifest.filter(F.col("schema_used") != NA).groupBy("schema_used")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("schema_used").asc()).limit(n))


def landings_by_day(manifest: DataFrame, as_of: _dt.date, days: int = 30) -> DataFrame:
    """H3 + D7: files and MB per day since ``as_of - days``, newest first."""
    since = F.date_sub(F.lit(as_of), days).cast("timestamp_ntz")
    mb = F.col("file_size_mb").cast("decimal(18,2)")
    return (manifest.filter(F.col("upload_date") >= since)
            .groupBy(F.to_date("upload_date").alias("upload_day"))
            .agg(F.count(F.lit(1)).alias("files_count"),
                 F.round(F.sum(mb), 2).cast("double").alias("total_size_mb"))
            .orderBy(F.col("upload_day").desc()))


# Schema-name fragments and the category each one marks, in
# the order they are tested.
CATEGORIES = [(["vendas"], "sales"), (["financeiro"], "finance"),
              (["rh", "funcionario"], "people"), (["sistema", "user"], "system")]


def schema_category(c: Column) -> Column:
    """Category label from the schema name (substring tests in order)."""
    low = F.lower(c)
    out = None
    for words, label in CATEGORIES:
        cond = F.lit(False)
        for w in words:
            cond = cond | low.contains(w)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit("other"))


def metadata_map(manifest: DataFrame, subject: Column | None = None, sub_subject: Column | None = None,
                 processed_by: str = "vellum") -> DataFrame:
    """C14: landing metadata as a text map (what object stores keep per file)."""
    subject = subject if subject is not None else F.coalesce(F.try_element_at(F.split("file_key", "/"), F.lit(2)), F.lit(""))
    sub_subject = sub_subject if sub_subject is not None else F.coalesce(F.try_element_at(F.split("file_key", "/"), F.lit(3)), F.lit(""))
    kv = [("original_filename", F.col("original_filename")),
          ("upload_timestamp", F.col("upload_timestamp")),
          ("schema_used", F.col("schema_used")),
          ("subject", subject), ("sub_subject", sub_subject),
          ("row_count", F.col("row_count").cast("string")),
          ("column_count", F.col("column_count").cast("string")),
          ("file_size_bytes", F.col("file_size_bytes").cast("string")),
          ("original_format", F.col("extension")),
          ("processed_by", F.lit(processed_by))]
    m = F.create_map(*[x for k, v in kv for x in (F.lit(k), v)])
    return manifest.select("file_key", m.alias("metadata"))
