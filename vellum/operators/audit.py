"""Ledger analytics: field projections, filters, history and activity
(C11, C12, D4, D8, D9, H4, H5, K3).

All are filters / projections / aggregates over the ledger table; with the
ledger partitioned by database and table (see ``sinks.ledger_store``) the
table filters prune whole directories.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIT_COLUMNS = ["id", "table_name", "operation", "row_identifier", "updated_by",
                 "updated_at", "session_id", "change_reason"]


def _img(side: str, field: str) -> Column:
    return F.try_element_at(F.col(side), F.lit(field))


def _newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("updated_at").desc(), F.col("id").desc())


def change_fields(ledger: DataFrame, fields: list[str], table: str | None = None) -> DataFrame:
    """C11: before/after values of chosen fields as flat columns."""
    led = ledger if table is None else ledger.filter(F.col("table_name") == table)
    cols = [F.col(c) for c in ["id", "table_name", "operation", "row_identifier"]]
    for f in fields:
        cols += [_img("before", f).alias(f"{f}_before"), _img("after", f).alias(f"{f}_after")]
    cols += [F.col("updated_by"), F.col("updated_at")]
    return led.select(*cols)


def change_view(ledger: DataFrame, table: str, fields: list[str], view_name: str | None = None) -> DataFrame:
    """Flattened per-table change view; optionally registered as a temp view."""
    cols = [F.col("id").alias("change_id"), F.col("row_identifier").alias("row_id"), F.col("operation")]
    for f in fields:
        cols += [_img("before", f).alias(f"{f}_before"), _img("after", f).alias(f"{f}_after")]
    cols += [F.col(c) for c in ["updated_by", "updated_at", "session_id", "change_reason"]]
    view = ledger.filter(F.col("table_name") == table).select(*cols)
    if view_name:
        view.createOrReplaceTempView(view_name)
    return view


def field_changed(ledger: DataFrame, table: str, field: str) -> DataFrame:
    """Records where ``before.f != after.f`` (a null side never matches)."""
    b, a = _img("before", field), _img("after", field)
    out = (ledger.filter((F.col("table_name") == table) & (b != a))
           .select("row_identifier", b.alias(f"{field}_before"), a.alias(f"{field}_after"),
                   "updated_at", "updated_by", "id"))
    return _newest_first(out).drop("id")


def row_history(ledger: DataFrame, table: str, row_id: str, fields: list[str] | None = None) -> DataFrame:
    """Every change of one row, newest first (whole images when no fields)."""
    cols = [F.col("operation")]
    if fields is None:
        cols += [F.col("before"), F.col("after")]
    for f in fields or []:
        cols += [_img("before", f).alias(f"{f}_before"), _img("after", f).alias(f"{f}_after")]
    cols += [F.col("updated_at"), F.col("change_reason"), F.col("id")]
    out = ledger.filter((F.col("table_name") == table) & (F.col("row_identifier") == row_id)).select(*cols)
    return _newest_first(out).drop("id")


def changes_by_day(ledger: DataFrame, table: str, since: _dt.date) -> DataFrame:
    """H4: per day: changes, distinct rows, distinct editors."""
    day = F.to_date("updated_at")
    return (ledger.filter((F.col("table_name") == table) & (day >= F.lit(since)))
            .groupBy(day.alias("change_date"))
            .agg(F.count(F.lit(1)).alias("total_changes"),
                 F.count_distinct("row_identifier").alias("rows_affected"),
                 F.count_distinct("updated_by").alias("editors"))
            .orderBy(F.col("change_date").desc()))


def ledger_filter(ledger: DataFrame, table_like: str | None = None, operation: str | None = None,
                  limit: int | None = 100) -> DataFrame:
    """D4 + K3: table name contains (LIKE, case-sensitive), operation equals
    (``None``/"All" = any), newest first, top ``limit`` as given (``None`` = all)."""
    led = ledger
    if table_like:
        led = led.filter(F.col("table_name").like(f"%{table_like}%"))
    if operation and operation != "All":
        led = led.filter(F.col("operation") == F.lit(operation))
    newest = _newest_first(led.select(*AUDIT_COLUMNS))
    return newest if limit is None else newest.limit(limit)


def ledger_stats(ledger: DataFrame) -> DataFrame:
    """H5: total, tables touched, most common operation and its count.

    Ties go to the operation seen first in newest-first order, i.e. the one
    with the newest record.  Two small aggregates; the per-operation one has
    at most a handful of groups.
    """
    # one scan: (operation, table) groups, combined map side; everything after
    # works on that small table
    pt = ledger.groupBy("operation", "table_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct(F.col("updated_at"), F.col("id"))).alias("newest"))
    per_op = pt.groupBy("operation").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))
    top = per_op.agg(F.max_by(F.struct("operation", "n"), F.struct("n", "newest")).alias("top"))
    tot = pt.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_changes"),
                 F.count_distinct("table_name").alias("tables_affected"))
    # stitch the two one-row results with a union + aggregate (no join)
    u = (tot.select("total_changes", "tables_affected",
                    F.lit(None).cast("string").alias("top_operation"),
                    F.lit(None).cast("long").alias("top_operation_count"))
         .unionByName(top.select(F.lit(None).cast("long").alias("total_changes"),
                                 F.lit(None).cast("long").alias("tables_affected"),
                                 F.col("top.operation").alias("top_operation"),
                                 F.col("top.n").alias("top_operation_count"))))
    return u.agg(F.max("total_changes").alias("total_changes"),
                 F.max("tables_affected").alias("tables_affected"),
                 F.max("top_operation").alias("top_operation"),
                 F.coalesce(F.max("top_operation_count"), F.lit(0)).alias("top_operation_count"))
