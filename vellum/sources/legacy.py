"""Legacy change-log import (A6): pipe-delimited text with a header line,
images packed as text (see ``functions.images``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.images import unpack_image
from vellum.operators.diff import LEDGER_COLUMNS


def read_legacy_log(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Pipe-delimited legacy log -> ledger rows with MAP images.

    Fields are split on unescaped ``|``; ``\\|`` inside values is restored.
    Header lines (equal to the column list) are dropped.
    """
    header = "|".join(LEDGER_COLUMNS)
    text = spark.read.text(path).filter((F.col("value") != header) & (F.col("value") != ""))
    parts = F.split(F.col("value"), r"(?<!\\)\|")
    cols = []
    for i, name in enumerate(LEDGER_COLUMNS):
        v = F.try_element_at(parts, F.lit(i + 1))
        if name in ("before", "after"):
            cols.append(unpack_image(v, fields).alias(name))
        else:
            v = F.replace(v, F.lit("\\|"), F.lit("|"))
            if name == "updated_at":
                v = v.try_cast("timestamp_ntz")
            cols.append(v.alias(name))
    return text.select(*cols)
