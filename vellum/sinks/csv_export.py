"""CSV export (B1)."""

from __future__ import annotations

from pyspark.sql import DataFrame


#: doubled quotes and kept padding, so that texts survive being written and read back
TEXT_OPTIONS = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> str:
    """Header line, comma separated.  Parallel part files by default;
    ``single_file`` funnels through one task and is for small results only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).option("sep", ",").options(**TEXT_OPTIONS).csv(path)
    return path
