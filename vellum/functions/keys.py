"""Key builders: landing object keys (B2) and change-record ids."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Root folder of the dated landing layout.
LANDING_ROOT = "sistema"


def landing_key(filename: Column, subject: Column, sub_subject: Column, ts: Column,
                root: str = LANDING_ROOT) -> Column:
    """``{root}/{subject}/{sub_subject}/{yyyy-MM-dd}/{base}_{yyyyMMdd_HHmmss}.csv``.

    ``base`` is the file name without its last extension.
    """
    base = F.regexp_replace(filename, r"\.[^.]*$", "")
    return F.concat_ws(
        "/", F.lit(root), subject, sub_subject, F.date_format(ts, "yyyy-MM-dd"),
        F.concat(base, F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(".csv")))


def change_id(database: Column, table: Column, row_id: Column, ts_text: Column) -> Column:
    """md5 of ``{db}_{table}_{row}_{iso time}`` -- stable across reruns."""
    return F.md5(F.concat_ws("_", database, table, row_id, ts_text))


def ntz_literal(value: _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal built from ISO text: the wall-clock value is
    kept whatever the Python or session time zone is."""
    return F.lit(value.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
