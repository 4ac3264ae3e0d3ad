"""Column renames (C1-C3): names are computed on the driver from the schema
and applied with one projection; no data moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.names import simple_name, strict_names


def rename_simple(df: DataFrame) -> DataFrame:
    """Lower, spaces to '_', keep alphanumerics and '_'.  Names that
    clash merge into one column at the first position, holding the value of
    the last source column."""
    order, src = [], {}
    for c in df.columns:
        n = simple_name(c)
        if n not in src:
            order.append(n)
        src[n] = c
    return df.select(*[F.col(f"`{src[n]}`").alias(n) for n in order])


def rename_strict(df: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Rule replacements, accents stripped, non-word -> '_', leading digit
    -> 'col_', empty -> 'unnamed_column', repeats numbered in column order.
    ``rules`` are added to the default replacement rules."""
    return df.toDF(*strict_names(df.columns, extra_rules=rules))


def rename_preview(df: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(ordinal, original, cleaned) for every column, same dedupe."""
    cleaned = strict_names(df.columns, extra_rules=rules)
    rows = [(i, o, c) for i, (o, c) in enumerate(zip(df.columns, cleaned))]
    return df.sparkSession.createDataFrame(rows, "ordinal int, original string, cleaned string")
