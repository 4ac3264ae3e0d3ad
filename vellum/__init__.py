"""vellum: table landing, contract validation and change ledger on Spark.

Every public function takes and returns DataFrames (or Columns) and is
expressed with built-in Spark SQL functions, so Catalyst plans it and the
work is distributed; nothing is collected to the driver except schema-level
metadata (column names, contract dicts).
"""

from vellum.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
