"""Change detection: snapshot diff into UPDATE change records.

The keyed diff is one equi-join on the key (both snapshots shuffle once on
it) followed by a filter on normalised column text; no per-row Python.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.keys import change_id, ntz_literal
from vellum.operators.materialize import materialize

# Name fragments that mark a key column.
KEY_HINTS = ["id", "key", "pk"]

LEDGER_COLUMNS = ["id", "table_name", "database_name", "operation", "row_identifier",
                  "before", "after", "updated_by", "updated_at", "session_id", "change_reason"]

IMAGE = T.MapType(T.StringType(), T.StringType())
LEDGER_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("database_name", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("row_identifier", T.StringType()),
    T.StructField("before", IMAGE),
    T.StructField("after", IMAGE),
    T.StructField("updated_by", T.StringType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("change_reason", T.StringType()),
])


@dataclass
class ChangeMeta:
    """Who/when/where of one save; fixed per batch so reruns repeat exactly."""
    database: str
    table: str
    user: str
    changed_at: _dt.datetime
    session_id: str
    reason: str = "manual edit"

    @property
    def iso_time(self) -> str:
        return self.changed_at.isoformat()


def guess_key(columns: "list[str] | DataFrame") -> str:
    """First column whose lower-cased name contains id/key/pk, else the first."""
    if isinstance(columns, DataFrame):
        columns = columns.columns
    for c in columns:
        if any(h in c.lower() for h in KEY_HINTS):
            return c
    if not columns:
        raise ValueError("no columns")
    return columns[0]


def assert_unique_key(df: DataFrame, key: str, *others: DataFrame) -> None:
    """Raise when two rows of one frame share a key.

    One job for all frames: their key columns tagged by frame, one partial
    (map-side) aggregation, stopped at the first duplicate.  A duplicated
    key would otherwise make the key join emit every pair.
    """
    frames = [df, *others]
    tagged = None
    for i, f in enumerate(frames):
        part = f.select(F.lit(i).alias("__frame"), F.col(f"`{key}`").alias("__key"))
        tagged = part if tagged is None else tagged.unionByName(part)
    dup = tagged.groupBy("__frame", "__key").count().filter(F.col("count") > 1).limit(1)
    if not dup.isEmpty():
        raise ValueError(f"key column {key!r} is not unique")


def norm(c: Column) -> Column:
    """Compare-normalise a cell: null -> '', everything else its text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def image_of(df_alias: str, cols: list[str]) -> Column:
    """Row image as MAP<STRING,STRING>; null stays null."""
    kv = []
    for c in cols:
        kv += [F.lit(c), F.col(f"{df_alias}.`{c}`").cast("string")]
    return F.create_map(*kv) if kv else F.create_map().cast(IMAGE)


def _records(joined: DataFrame, cols: list[str], row_id: Column, meta: ChangeMeta) -> DataFrame:
    differs = F.lit(False)
    for c in cols:
        differs = differs | (norm(F.col(f"b.`{c}`")) != norm(F.col(f"a.`{c}`")))
    rid = row_id.cast("string")
    return joined.filter(differs).select(
        change_id(F.lit(meta.database), F.lit(meta.table), rid, F.lit(meta.iso_time)).alias("id"),
        F.lit(meta.table).alias("table_name"),
        F.lit(meta.database).alias("database_name"),
        F.lit("UPDATE").alias("operation"),
        rid.alias("row_identifier"),
        image_of("b", cols).alias("before"),
        image_of("a", cols).alias("after"),
        F.lit(meta.user).alias("updated_by"),
        ntz_literal(meta.changed_at).alias("updated_at"),
        F.lit(meta.session_id).alias("session_id"),
        F.lit(meta.reason).alias("change_reason"),
    )


def _aligned(before: DataFrame, after: DataFrame) -> tuple[DataFrame, list[str]]:
    cols = before.columns
    missing = [c for c in cols if c not in after.columns]
    for c in missing:
        after = after.withColumn(c, F.lit(None).cast("string"))
    return after, cols


def diff_updates(before: DataFrame, after: DataFrame, key: str | None, meta: ChangeMeta,
                 check_key: bool = True) -> DataFrame:
    """Keyed diff (F2): one UPDATE record per key whose normalised row differs.

    Keys present on only one side are not changes (edits never insert or
    delete).  The join is a shuffle on the key (none when both snapshots are
    bucketed by it); keys must be unique, which ``check_key`` verifies.
    """
    key = key or guess_key(before.columns)
    if check_key:
        assert_unique_key(before, key, after)
    after, cols = _aligned(before, after)
    j = before.alias("b").join(after.alias("a"), F.col(f"b.`{key}`") == F.col(f"a.`{key}`"), "inner")
    return _records(j, cols, F.col(f"a.`{key}`"), meta)


def with_position(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Attach a global row position to a Parquet scan: files in name order,
    rows in file order.

    Position = rows in earlier files + ``_metadata.row_index``.  The per-file
    counts are summed in two levels: files fall into ranges by name, each range
    is summed on its own, and only the ranges' totals (one row per shuffle
    partition) pass a window without partition.  The offsets join is left to
    the planner, which broadcasts it only when its measured size allows.
    """
    tagged = (df.withColumn("__file", F.col("_metadata.file_path"))
              .withColumn("__row", F.col("_metadata.row_index")))
    per_file = tagged.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    # written, so that the ranges keep their files when they are read twice
    dealt, _, _ = materialize(per_file.repartitionByRange("__file").withColumn("__range", F.spark_partition_id()),
                              "file-rows")
    before = Window.unboundedPreceding
    ranges = dealt.groupBy("__range").agg(F.sum("__n").alias("__total")).select(
        "__range", F.coalesce(F.sum("__total").over(Window.orderBy("__range").rowsBetween(before, -1)), F.lit(0)).alias("__base"))
    within = F.sum("__n").over(Window.partitionBy("__range").orderBy("__file").rowsBetween(before, -1))
    offsets = dealt.withColumn("__within", F.coalesce(within, F.lit(0))).join(ranges, "__range").select(
        "__file", (F.col("__base") + F.col("__within")).alias("__off"))
    return (tagged.join(offsets, "__file", "inner")
            .withColumn(name, F.col("__off") + F.col("__row"))
            .drop("__file", "__row", "__off"))


def diff_positional(before: DataFrame, after: DataFrame, position: str, meta: ChangeMeta,
                    key: str | None = None) -> DataFrame:
    """Row i against row i (F2p); extra rows on either side are ignored.

    ``position`` names a column present on both sides (e.g. from
    ``with_position``).  Row id = edited key value, else the position.
    """
    b_cols = [c for c in before.columns if c != position]
    key = key or guess_key(b_cols)
    after, _ = _aligned(before, after)
    j = before.alias("b").join(after.alias("a"), F.col(f"b.`{position}`") == F.col(f"a.`{position}`"), "inner")
    rid = F.coalesce(F.col(f"a.`{key}`").cast("string"), F.col(f"a.`{position}`").cast("string"))
    return _records(j, b_cols, rid, meta)


def change_summary(before: DataFrame, after: DataFrame, key: str | None = None) -> DataFrame:
    """One row: sizes, differing rows and ``changed``.

    Keyed: per key, a row differs when one side is missing or a normalised
    cell differs (computed by one aggregation over both snapshots).
    Unkeyed: multiset difference both ways, which is what "any row differs"
    means without an order.
    """
    if key is not None:
        # one aggregation over both snapshots keyed by the key (no join, so a
        # repeated key is counted, never paired); a key differs when its row
        # counts differ or its normalised rows differ
        after, cols = _aligned(before, after)
        row = F.array(*[norm(F.col(f"`{c}`")) for c in cols])
        u = (before.select(F.col(f"`{key}`").alias("__key"), row.alias("__r"), F.lit(True).alias("__b"))
             .unionByName(after.select(F.col(f"`{key}`").alias("__key"), row.alias("__r"),
                                       F.lit(False).alias("__b"))))
        per = u.groupBy("__key").agg(
            F.count_if(F.col("__b")).alias("nb"), F.count_if(~F.col("__b")).alias("na"),
            F.min(F.when(F.col("__b"), F.col("__r"))).alias("b_lo"),
            F.max(F.when(F.col("__b"), F.col("__r"))).alias("b_hi"),
            F.min(F.when(~F.col("__b"), F.col("__r"))).alias("a_lo"),
            F.max(F.when(~F.col("__b"), F.col("__r"))).alias("a_hi"))
        differs = ((F.col("nb") != F.col("na")) | ~F.col("b_lo").eqNullSafe(F.col("a_lo"))
                   | ~F.col("b_hi").eqNullSafe(F.col("a_hi")))
        out = per.agg(F.coalesce(F.sum("nb"), F.lit(0)).alias("n_before"),
                      F.coalesce(F.sum("na"), F.lit(0)).alias("n_after"),
                      F.coalesce(F.sum(F.when(differs, F.greatest("nb", "na")).otherwise(0)), F.lit(0))
                      .alias("n_differing"))
    else:
        # multiset difference as one aggregation: +1 per before row, -1 per
        # after row, grouped by the whole row (partial aggregation absorbs
        # repeated rows before the shuffle)
        after, cols = _aligned(before, after)
        sel = [F.col(f"`{c}`") for c in cols]
        u = (before.select(*sel, F.lit(1).alias("__s"))
             .unionByName(after.select(*sel, F.lit(-1).alias("__s"))))
        g = u.groupBy(*sel).agg(F.sum("__s").alias("__d"),
                                F.count_if(F.col("__s") > 0).alias("__nb"),
                                F.count_if(F.col("__s") < 0).alias("__na"))
        out = g.agg(F.coalesce(F.sum("__nb"), F.lit(0)).alias("n_before"),
                    F.coalesce(F.sum("__na"), F.lit(0)).alias("n_after"),
                    F.coalesce(F.sum(F.abs("__d")), F.lit(0)).alias("n_differing"))
    return out.select("n_before", "n_after", "n_differing",
                      ((F.col("n_before") != F.col("n_after")) | (F.col("n_differing") > 0)).alias("changed"))


def any_change(before: DataFrame, after: DataFrame, key: str | None = None) -> bool:
    return bool(change_summary(before, after, key).first()["changed"])


def _widen(dt: T.DataType) -> T.DataType:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    if isinstance(dt, (T.BooleanType, T.DateType)):
        return dt
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return T.TimestampType()
    return T.StringType()


def widen_schema(schema: T.StructType) -> T.StructType:
    """Ledger image schema for a table (C9): six types; no columns -> data string."""
    if not schema.fields:
        return T.StructType([T.StructField("data", T.StringType())])
    return T.StructType([T.StructField(f.name, _widen(f.dataType)) for f in schema.fields])


def widen_types(df: DataFrame) -> DataFrame:
    target = widen_schema(df.schema)
    if not df.columns:
        return df.sparkSession.createDataFrame([], target)
    out = []
    for f, t in zip(df.schema.fields, target.fields):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        out.append(c.cast(t.dataType).alias(f.name))
    return df.select(*out)
