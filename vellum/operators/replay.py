"""Merge on read: rebuild the current table from base + change ledger.

Replay semantics per row key (the fold the ledger describes):
UPDATE overlays the non-blank image fields that the current row has (ignored
when the row does not exist), INSERT creates the row from its image when the
key is absent, DELETE removes it.  Blank operation or key are skipped.

Instead of folding a per-key list (which would pull one key's whole history
into one task), the fold is solved in closed form with aggregates that Spark
computes partially on the map side, so a key holding a third of the ledger
still spreads over every task:

* ``ld``   = last DELETE,
* ``fi``   = first INSERT after ``ld`` (the first INSERT at all when there is no DELETE),
* per column, the latest non-blank UPDATE value; it applies when the base
  row is still alive (no DELETE) or when it is later than ``fi``.

Only ``fi`` needs ``ld`` first.  Keys whose inserts lie on both sides of the
last delete are rare; they are counted while the summary is written, and
only then does a second, salted join of their INSERT records against ``ld``
pick the right one; only that small table is written beside the summary.  The
summary (one row per touched key) is written to the shared folder and sized:
small summaries are broadcast to a streamed base, whose keys then show which
ledger keys are new; large ones meet the base in one full outer join on the key
(one base scan, one exchange; a base bucketed by its key is read in place).

An UPDATE whose text does not cast to its column's type changes nothing, and
the newest one that does cast applies; ``uncastable`` lists the others.

``precedence='as_written'`` replays newest-first (the order the original
application walked the ledger): the same plan with earlier/later swapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.diff import assert_unique_key, guess_key
from vellum.operators.materialize import fits_broadcast, materialize

REQUIRED = ["operation", "row_identifier", "before", "after"]
OPERATIONS = ["UPDATE", "INSERT", "DELETE"]
SALT_BUCKETS = 16


def ledger_has_shape(ledger: DataFrame) -> bool:
    """A ledger must carry operation, row_identifier, before and after."""
    return set(REQUIRED) <= set(ledger.columns)


def _order(ledger: DataFrame) -> Column:
    # total order of records: time, then record id (one save shares a time)
    return F.struct(F.col("updated_at").alias("t"), F.col("id").alias("i"))


def _val(img: Column, c: str) -> Column:
    return F.try_element_at(img, F.lit(c))


def _nonblank(v: Column) -> Column:
    return v.isNotNull() & (v != F.lit(""))


def _usable(ledger: DataFrame, table: str | None, database: str | None) -> DataFrame:
    led = ledger
    if table is not None:
        led = led.filter(F.col("table_name") == F.lit(table))
    if database is not None:
        led = led.filter(F.col("database_name") == F.lit(database))
    return led.filter(F.col("operation").isin(OPERATIONS)
                      & F.col("row_identifier").isNotNull()
                      & (F.col("row_identifier") != F.lit("")))


def _casts(v: Column, dt: T.DataType) -> Column:
    """A non-blank image value that its column can hold."""
    return _nonblank(v) if isinstance(dt, T.StringType) else _nonblank(v) & v.try_cast(dt).isNotNull()


def uncastable(base: DataFrame, ledger: DataFrame, table: str | None = None,
               database: str | None = None) -> DataFrame:
    """The image values that replay can't use: one row per ledger record and
    column whose non-blank text does not cast to the base column's type.

    Columns: id, operation, row_identifier, updated_at, field, value.
    """
    led = _usable(ledger, table, database).filter(F.col("operation") != "DELETE")
    typed = [f for f in base.schema.fields if not isinstance(f.dataType, T.StringType)]
    cells = [F.struct(F.lit(f.name).alias("field"), _val(F.col("after"), f.name).alias("value"),
                      (_nonblank(_val(F.col("after"), f.name))
                       & _val(F.col("after"), f.name).try_cast(f.dataType).isNull()).alias("__bad")) for f in typed]
    head = ["id", "operation", "row_identifier", "updated_at"]
    if not cells:
        return led.select(*head, F.lit(None).cast("string").alias("field"),
                          F.lit(None).cast("string").alias("value")).limit(0)
    return led.select(*head, F.inline(F.array(*cells))).filter("__bad").drop("__bad")


def typed_key(base: DataFrame, key: str, row_id: Column) -> Column:
    """The ledger's row identifier as a value of the base key's type.

    The ledger records keys by their text, so an identifier matches a key
    only when it is exactly that key's text; any other text (``'007'`` for
    7) becomes NULL and matches nothing.  Joining on the raw key keeps a base
    that is bucketed or partitioned by its key in that layout.
    """
    dt = base.schema[key].dataType
    if isinstance(dt, T.StringType):
        return row_id
    typed = row_id.try_cast(dt)
    return F.when(typed.cast("string") == row_id, typed)


def replay(base: DataFrame, ledger: DataFrame, key: str | None = None,
           precedence: str = "latest", table: str | None = None,
           database: str | None = None, check_key: bool = True) -> DataFrame:
    """Current table = base with the ledger replayed over it.

    Output has the base's columns in order; image text is cast back to each
    column's type.  ``key`` defaults to the guessed key column (F1).

    The per-key ledger summary is written to the shared folder and sized:
    under the broadcast threshold it is broadcast and base is streamed with
    no shuffle; above it, base and summary meet in one full outer join on the
    key.  AQE can't split a hot key of that join, so base keys are checked to
    be unique first (one aggregation over the key column, combined map side);
    ``check_key=False`` skips the check where the caller knows.  A repeated key
    then gets the same changes in each of its rows.
    """
    if precedence not in ("latest", "as_written"):
        raise ValueError("precedence must be 'latest' or 'as_written'")
    if not ledger_has_shape(ledger):
        return base
    cols = base.columns
    key = key or guess_key(cols)
    if check_key:
        assert_unique_key(base, key)
    latest = precedence == "latest"
    later = F.max if latest else F.min
    earlier = F.min if latest else F.max

    def after(a: Column, b: Column) -> Column:
        return a > b if latest else a < b

    led = _usable(ledger, table, database)
    names = [f"c{i}" for i in range(len(cols))]
    img = F.col("after")
    op = F.col("operation")
    # one flat projection: each image value is looked up once per record
    flat = led.select(
        F.col("row_identifier").alias("__k"), F.col("id").alias("__id"), _order(led).alias("__o"),
        ((op == "INSERT") & img.isNotNull() & (F.size(img) > 0)).alias("__is_ins"),
        (op == "DELETE").alias("__is_del"),
        ((op == "UPDATE") & img.isNotNull()).alias("__is_upd"),
        *[_val(img, c).alias("__v" + n) for c, n in zip(cols, names)],
        *[F.map_contains_key(img, F.lit(c)).alias("__h" + n) for c, n in zip(cols, names)])
    o, is_ins, is_del, is_upd = F.col("__o"), F.col("__is_ins"), F.col("__is_del"), F.col("__is_upd")
    # INSERT candidate: its order, then each column's value and presence
    ins = F.struct(o.alias("o"),
                   *[F.col("__v" + n).alias(n) for n in names],
                   *[F.col("__h" + n).alias("h" + n) for n in names])
    # every summary column starts with "__" so it cannot collide with base columns
    upd = [later(F.when(is_upd & _casts(F.col("__v" + n), base.schema[c].dataType),
                        F.struct(o.alias("o"), F.col("__v" + n).alias("v")))).alias("__u" + n)
           for c, n in zip(cols, names)]
    stats = flat.groupBy("__k").agg(
        later(F.when(is_del, o)).alias("__ld"),
        earlier(F.when(is_ins, ins)).alias("__fi_any"),
        later(F.when(is_ins, o)).alias("__li"),
        *upd)
    # the per-key summary is written once (one scan of the ledger) and sized;
    # the size picks the join strategy below and the write cuts lineage.
    # Keys with INSERTs both before and after their last DELETE need a second
    # step; they are counted while the summary is written.
    ld, li, fi_any = F.col("__ld"), F.col("__li"), F.col("__fi_any")
    amb_cond = ld.isNotNull() & li.isNotNull() & after(li, ld) & ~after(fi_any["o"], ld)
    stats, size, seen = materialize(stats, "replay-summary", [F.count_if(amb_cond).alias("n_amb")])
    small = fits_broadcast(stats, size)

    # for those keys, find the first INSERT after the last DELETE with a
    # salted join, so a hot key spreads over tasks; skipped, with no second
    # ledger scan, when no key needs it
    amb = stats.filter(amb_cond)
    if not seen["n_amb"]:
        stats = stats.withColumn("__fi_fix", F.lit(None).cast(stats.schema["__fi_any"].dataType))
    else:
        amb = (amb.select("__k", "__ld")
               .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT_BUCKETS - 1)))))
        inserts = flat.filter(is_ins).select(
            "__k", ins.alias("__ins"),
            F.pmod(F.xxhash64(F.col("__id")), F.lit(SALT_BUCKETS)).cast("int").alias("__salt"))
        fixes = (inserts.join(amb, ["__k", "__salt"], "inner")
                 .filter(after(F.col("__ins.o"), ld))
                 .groupBy("__k").agg(earlier("__ins").alias("__fi_fix")))
        # written once: its two uses below must not read the ledger again
        fixes, _, _ = materialize(fixes, "replay-fixes")
        stats = stats.join(fixes, "__k", "left")
    fi = (F.when(ld.isNull(), fi_any)
          .when(after(fi_any["o"], ld), fi_any)
          .when(li.isNotNull() & after(li, ld), F.col("__fi_fix")))
    unames = ["__u" + n for n in names]
    summary = stats.select("__k", typed_key(base, key, F.col("__k")).alias("__kt"), "__ld", fi.alias("__fi"),
                           *unames)

    types = {f.name: f.dataType for f in base.schema.fields}
    fi_ = F.col("__fi")

    def values(alive0: Column, kcol: Column) -> list[Column]:
        out = []
        for c, n in zip(cols, names):
            u = F.col("__u" + n)
            text = F.when(u.isNotNull() & after(u["o"], fi_["o"]) & fi_[f"h{n}"], u["v"]).otherwise(fi_[n])
            if c == key:
                text = F.when(fi_[f"h{n}"], text).otherwise(kcol)
            dt = types[c]
            typed = text if isinstance(dt, T.StringType) else text.try_cast(dt)
            upd_typed = u["v"] if isinstance(dt, T.StringType) else u["v"].try_cast(dt)
            out.append(F.when(alive0, F.coalesce(upd_typed, F.col(f"`{c}`"))).otherwise(typed).alias(c))
        return out

    # rows of base: kept (with overlays), re-created after a delete, or dropped;
    # keys only in the ledger: created by an INSERT
    bk = F.col(f"`{key}`").cast("string")
    if not small:
        both = (base.withColumn("__here", F.lit(True))
                .join(summary, F.col(f"`{key}`") == F.col("__kt"), "full"))
        alive0 = F.coalesce(F.col("__here"), F.lit(False)) & F.col("__ld").isNull()
        return both.filter(alive0 | fi_.isNotNull()).select(*values(alive0, F.coalesce(bk, F.col("__k"))))
    kept = base.join(F.broadcast(summary), F.col(f"`{key}`") == F.col("__kt"), "left")
    alive0 = F.col("__ld").isNull()
    kept = kept.filter(alive0 | fi_.isNotNull()).select(*values(alive0, bk))
    # base is streamed once against the broadcast key list; no base shuffle
    present = (base.select(F.col(f"`{key}`").alias("__pk"))
               .join(F.broadcast(summary.select("__kt")), F.col("__pk") == F.col("__kt"), "left_semi"))
    new = (summary.filter(fi_.isNotNull())
           .join(present, F.col("__kt") == F.col("__pk"), "left_anti"))
    nulls = [F.lit(None).cast(types[c]).alias(c) for c in cols]
    new = new.select(*nulls, "__k", "__kt", "__ld", "__fi", *unames).select(*values(F.lit(False), F.col("__k")))
    return kept.unionByName(new)


def replay_as_written(base: DataFrame, ledger: DataFrame, key: str | None = None, **kw) -> DataFrame:
    return replay(base, ledger, key, precedence="as_written", **kw)


def overlay_updates(base: DataFrame, ledger: DataFrame, key: str | None = None,
                    table: str | None = None, database: str | None = None) -> DataFrame:
    """UPDATE-only overlay (G4): latest non-blank value per key and column.

    The per-key aggregate is partial (map-side), written once to the shared
    folder and sized; it is broadcast to a streamed base when under the
    broadcast threshold, else hash-joined on the key.
    """
    cols = base.columns
    key = key or guess_key(cols)
    led = _usable(ledger, table, database).filter(F.col("operation") == "UPDATE")
    o = _order(led)
    img = F.col("after")
    names = [f"c{i}" for i in range(len(cols))]
    agg = led.groupBy(F.col("row_identifier").alias("__k")).agg(
        *[F.max(F.when(_casts(_val(img, c), base.schema[c].dataType), F.struct(o.alias("o"), _val(img, c).alias("v"))))
          .alias("__u" + n) for c, n in zip(cols, names)])
    agg = agg.withColumn("__kt", typed_key(base, key, F.col("__k")))
    summary, size, _ = materialize(agg, "overlay-summary")
    side = F.broadcast(summary) if fits_broadcast(summary, size) else summary
    j = base.join(side, base[key] == F.col("__kt"), "left")
    types = {f.name: f.dataType for f in base.schema.fields}
    out = []
    for c, n in zip(cols, names):
        v = F.col("__u" + n)["v"]
        if not isinstance(types[c], T.StringType):
            v = v.try_cast(types[c])
        out.append(F.coalesce(v, F.col(f"`{c}`")).alias(c))
    return j.select(*out)


def current_view(spark: SparkSession, base_table: str, ledger_table: str, key: str | None = None,
                 table_name: str | None = None, database: str | None = None,
                 precedence: str = "latest") -> DataFrame:
    """Base replayed with its ledger; base unchanged when the ledger table
    is missing or lacks the change-record columns."""
    base = spark.table(base_table)
    if not spark.catalog.tableExists(ledger_table):
        return base
    ledger = spark.table(ledger_table)
    if not ledger_has_shape(ledger):
        return base
    name = table_name or base_table.split(".")[-1]
    return replay(base, ledger, key, precedence=precedence, table=name, database=database)
