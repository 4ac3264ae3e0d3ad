"""File listing and upload gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted upload formats and the default size cap.
FORMATS = ["csv", "xlsx", "xls"]
MAX_MB = 50


def list_files(spark: SparkSession, prefix: str | list[str], recursive: bool = True) -> DataFrame:
    """A3: (path, filename, length, modificationTime) of every file under
    ``prefix`` (or several), and the same as a manifest names them (file_key,
    file_size_bytes, upload_date).  The content column is pruned, so no file is
    read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(prefix)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"),
                     "length", "modificationTime", F.col("path").alias("file_key"),
                     F.col("length").alias("file_size_bytes"),
                     F.col("modificationTime").cast("timestamp_ntz").alias("upload_date"))


def list_landed(spark: SparkSession, root: str, uploads: list[str] | None = None) -> DataFrame:
    """A3 over a landing root: (file_key, file_size_bytes, upload_date), one row
    per upload -- the folder below ``root`` that ``land`` or ``land_stream`` wrote,
    which is the ``file_key`` of its manifest row, so ``attach_metadata`` joins the
    two.  ``uploads`` names some of these folders, to list no others."""
    root = root.rstrip("/")
    files = list_files(spark, [f"{root}/{u}" for u in uploads] if uploads else root + "/data")
    key = F.regexp_extract("path", r"/(data/[^?]*)/[^/]*$", 1)
    return files.groupBy(key.alias("file_key")).agg(
        F.sum("file_size_bytes").alias("file_size_bytes"), F.max("upload_date").alias("upload_date"))


def accept_files(files: DataFrame, formats: list[str] | None = None, max_mb: float = MAX_MB,
                 name_col: str = "filename", size_col: str = "length") -> DataFrame:
    """D1 + D2: allow-listed extension (case-blind) and size within the cap."""
    formats = [f.lower() for f in (formats or FORMATS)]
    ext = F.lower(F.element_at(F.split(F.col(name_col), r"\."), -1))
    return files.filter(ext.isin(formats) & (F.col(size_col) <= F.lit(int(max_mb * 1024 * 1024))))
