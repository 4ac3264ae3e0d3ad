"""Contract validation over whole tables.

A contract is the YAML-shaped dict ``{"schema": {"fields": [{name, type,
required}, ...]}, ...}``.  Missing columns are a plan-time set difference;
blank counts are one aggregate; cell violations are one pass that lays out
(field, value, bad) per cell with ``inline`` and filters the bad ones inside
generated code -- no union per column, no lambda, no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.predicates import blank, is_boolean, is_date, is_datetime, is_integer, is_number

# Contract type names per checked kind; other names are unchecked.
TYPE_NAMES = {
    "int": "integer", "integer": "integer",
    "float": "number", "number": "number", "double": "number",
    "date": "date",
    "datetime": "datetime", "timestamp": "datetime",
    "bool": "boolean", "boolean": "boolean",
}

SPARK_TYPES = {"integer": T.LongType(), "number": T.DoubleType(), "date": T.DateType(),
               "datetime": T.TimestampNTZType(), "boolean": T.BooleanType()}


def contract_fields(contract: dict | None) -> list[dict]:
    if not contract:
        return []
    return list((contract.get("schema") or {}).get("fields") or [])


def contract_schema(contract: dict) -> T.StructType:
    """StructType a validated table casts to (unchecked types stay strings)."""
    return T.StructType([T.StructField(f["name"], SPARK_TYPES.get(TYPE_NAMES.get(f.get("type", "string")),
                                                                 T.StringType()))
                         for f in contract_fields(contract)])


def _check(kind: str, c: Column, dtype: T.DataType) -> Column:
    if kind == "integer":
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            # typed floats pass unless infinite (int() of inf raises)
            return ~F.abs(c).eqNullSafe(F.lit(float("inf")))
        if isinstance(dtype, T.BooleanType):
            return F.lit(False)
        return is_integer(c)
    if kind == "number":
        return F.lit(False) if isinstance(dtype, T.BooleanType) else is_number(c)
    if kind == "date":
        return F.lit(True) if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) else is_date(c)
    if kind == "datetime":
        return F.lit(True) if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) else is_datetime(c)
    if kind == "boolean":
        if isinstance(dtype, T.BooleanType):
            return F.lit(True)
        if isinstance(dtype, T.NumericType):
            return c.isin(0, 1)
        return is_boolean(c)
    return F.lit(True)


def missing_columns(df: DataFrame, contract: dict) -> list[str]:
    """Required fields absent from the table, in contract order."""
    present = set(df.columns)
    return [f["name"] for f in contract_fields(contract) if f.get("required") and f["name"] not in present]


def _required_present(df: DataFrame, contract: dict) -> list[tuple[int, str]]:
    return [(i, f["name"]) for i, f in enumerate(contract_fields(contract))
            if f.get("required") and f["name"] in df.columns]


def blank_counts(df: DataFrame, contract: dict) -> DataFrame:
    """(ordinal, field, n_blank) for present required fields with blanks."""
    fields = _required_present(df, contract)
    if not fields:
        return df.sparkSession.createDataFrame([], "ordinal int, field string, n_blank long")
    one = df.agg(*[F.count_if(blank(F.col(f"`{n}`"))).alias(f"b{i}") for i, n in fields])
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("field"), F.col(f"b{i}").alias("n_blank"))
                     for i, n in fields])
    return one.select(F.inline(rows)).filter(F.col("n_blank") > 0)


def violations(df: DataFrame, contract: dict, key: list[str] | str | None = None) -> DataFrame:
    """One row per bad cell: key columns, ordinal, field, expected, value.

    Null and '' cells are skipped (blank checks own them); whitespace-only is
    a violation for typed fields.  ``key`` names the columns that identify a
    row (a stable row number needs a real column; Parquet scans can supply
    ``_metadata.row_index``).
    """
    keys = [key] if isinstance(key, str) else list(key or [])
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    checks = []
    for i, f in enumerate(contract_fields(contract)):
        name = f["name"]
        kind = TYPE_NAMES.get(f.get("type", "string"))
        if kind is None or name not in dtypes:
            continue
        c = F.col(f"`{name}`")
        skip = c.isNull() | (c.cast("string") == F.lit(""))
        bad = ~skip & ~F.coalesce(_check(kind, c, dtypes[name]), F.lit(False))
        checks.append(F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("field"),
                               F.lit(kind).alias("expected"), c.cast("string").alias("value"),
                               bad.alias("__bad")))
    out_schema = [F.col(f"`{k}`") for k in keys]
    if not checks:
        return df.select(*out_schema, F.lit(None).cast("int").alias("ordinal"),
                         F.lit(None).cast("string").alias("field"),
                         F.lit(None).cast("string").alias("expected"),
                         F.lit(None).cast("string").alias("value")).limit(0)
    return (df.select(*out_schema, F.inline(F.array(*checks))).filter("__bad")
            .select(*out_schema, "ordinal", "field", "expected", "value"))


REPORT_SCHEMA = ("section int, ordinal int, kind string, field string, row_key string, value string, "
                 "n_blank long")


def validation_report(df: DataFrame, contract: dict | None, key: list[str] | str | None = None) -> DataFrame:
    """All problems in reading order: required-field problems (missing,
    then blank counts, per contract field), then type problems per field.

    Columns: section (1 required, 2 type), ordinal, kind, field, row_key,
    value, n_blank.  Empty input or no contract gives one 'invalid input' row
    and nothing else; the rows are counted in the same aggregate as the blanks,
    so a report is two scans and no job of its own.
    """
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key or [])
    fields = contract_fields(contract)
    if not fields:
        return spark.createDataFrame([(0, 0, "invalid input", None, None, None, None)], REPORT_SCHEMA)
    miss = set(missing_columns(df, contract))
    required = _required_present(df, contract)
    one = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count_if(blank(F.col(f"`{n}`"))).alias(f"b{i}") for i, n in required])

    def row(section: int, ordinal: int, kind: str, name: str | None, shown: Column, n_blank: Column) -> Column:
        return F.struct(shown.alias("__shown"), F.lit(section).alias("section"), F.lit(ordinal).alias("ordinal"),
                        F.lit(kind).alias("kind"), F.lit(name).cast("string").alias("field"),
                        F.lit(None).cast("string").alias("row_key"), F.lit(None).cast("string").alias("value"),
                        n_blank.cast("long").alias("n_blank"))

    some, none = F.col("n") > 0, F.lit(None)
    rows = [row(0, 0, "invalid input", None, ~some, none)]
    rows += [row(1, i, "missing", f["name"], some, none) for i, f in enumerate(fields) if f["name"] in miss]
    rows += [row(1, i, "blank", n, F.col(f"b{i}") > 0, F.col(f"b{i}")) for i, n in required]
    parts = [one.select(F.inline(F.array(*rows))).filter("__shown").drop("__shown")]
    rk = (F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in keys]) if keys
          else F.lit(None).cast("string"))
    parts.append(violations(df, contract, keys).select(
        F.lit(2).alias("section"), "ordinal", F.lit("type").alias("kind"), "field",
        rk.alias("row_key"), "value", F.lit(None).cast("long").alias("n_blank")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _bad_cells(df: DataFrame, contract: dict) -> Column:
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    bads = []
    for f in contract_fields(contract):
        kind = TYPE_NAMES.get(f.get("type", "string"))
        if kind is None or f["name"] not in dtypes:
            continue
        c = F.col(f"`{f['name']}`")
        skip = c.isNull() | (c.cast("string") == F.lit(""))
        bads.append(F.when(~skip & ~F.coalesce(_check(kind, c, dtypes[f["name"]]), F.lit(False)), 1)
                    .otherwise(0))
    return sum(bads[1:], bads[0]) if bads else F.lit(0)


def problem_metrics(df: DataFrame, contract: dict | None):
    """Aggregate Columns that count problems, and a function turning their
    values into the problem total -- so a write can observe them in the same
    pass (``DataFrame.observe``) instead of scanning twice."""
    fields = contract_fields(contract)
    req = [f["name"] for f in fields if f.get("required") and f["name"] in df.columns]
    n_missing = len(missing_columns(df, contract)) if fields else 0
    cols = [F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(_bad_cells(df, contract)), F.lit(0)).alias("cells")]
    cols += [F.max(F.when(blank(F.col(f"`{n}`")), 1).otherwise(0)).alias(f"b{i}") for i, n in enumerate(req)]

    def total(values: dict) -> int:
        if not fields or not values.get("rows"):
            return 1  # no contract or empty input: 'invalid input'
        return n_missing + int(values["cells"] or 0) + sum(int(values[f"b{i}"] or 0) for i in range(len(req)))

    return cols, total


def violation_count(df: DataFrame, contract: dict | None) -> int:
    """Number of reported problems (missing columns + required columns with
    blanks + bad cells), from a single aggregation pass.  Empty input or no
    contract counts as one problem ('invalid input')."""
    if not contract_fields(contract):
        return 1
    cols, total = problem_metrics(df, contract)
    return total(df.agg(*cols).first().asDict())
