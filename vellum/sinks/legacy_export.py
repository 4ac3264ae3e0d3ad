"""Legacy change-log export: pipe-delimited text, images packed (B4 legacy form, F7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.images import pack_image
from vellum.operators.diff import LEDGER_COLUMNS


def export_legacy_log(ledger: DataFrame, path: str, fields: list[str] | None = None,
                      mode: str = "overwrite") -> str:
    """Header line + one line per record; '|' inside plain fields is escaped."""
    cols = []
    for name in LEDGER_COLUMNS:
        c = F.col(name)
        if name in ("before", "after"):
            cols.append(pack_image(c, fields))
        elif name == "updated_at":
            cols.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        else:
            cols.append(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")))
    lines = ledger.select(F.concat_ws("|", *cols).alias("value"))
    header = ledger.sparkSession.range(1).select(F.lit("|".join(LEDGER_COLUMNS)).alias("value"))
    header.unionByName(lines).write.mode(mode).text(path)
    return path
