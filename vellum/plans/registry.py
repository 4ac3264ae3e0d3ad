"""Query registry: one Spark query per operator group, each paired with an
independent DuckDB SQL formulation over the same tables.

Every query reads whole driver tables (or inputs Spark derives from them);
none caps, samples or subsets rows.  Limits appear only where the operator
is a top-n report.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.images import LEGACY_FIELDS, clean_json, pack_image, unpack_image, unpack_sorted_image
from vellum.functions.keys import landing_key
from vellum.functions import predicates as P
from vellum.operators import audit, contract, diff, manifest as mf, profile, rename, replay
from vellum.plans import fixtures as fx
from vellum.session import scratch_dir
from vellum.sinks.csv_export import export_csv
from vellum.sinks.landing import land
from vellum.sinks.ledger_store import append_changes, committed_changes, create_ledger, register_external, reset_ledger
from vellum.sinks.legacy_export import export_legacy_log
from vellum.sources.delimited import SEPARATORS, detect_separator, read_delimited, read_numbered
from vellum.sources.legacy import read_legacy_log
from vellum.sources.listing import accept_files, list_landed

# ---------------------------------------------------------------- parameters
META = diff.ChangeMeta("main", "customer", "editor", dt.datetime(2024, 3, 1, 12, 0, 0), "sess0001")
AS_OF = dt.date(2024, 1, 15)
RECENT_DAYS = 7
SINCE = dt.date(2024, 1, 10)
MAX_MB = 10
SEARCH_TERM = "vendas"
BASE_FIELDS = ["id", "name", "segment", "nation"]
IMAGE_FIELDS = ["segment", "name"]
HISTORY_ROW = "20"
ODD_NAMES = ["Valor (R$)", "Ação", "1st", "a b", "a-b", "a_b", "___", "Preço(R$)"]
ODD_SOURCES = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_name",
               "c_custkey", "c_acctbal"]
BASE_CONTRACT = {"description": "clientes base", "schema": {"table_name": "customers", "fields": [
    {"name": "id", "type": "int", "required": True},
    {"name": "name", "type": "str", "required": True},
    {"name": "segment", "type": "str"},
    {"name": "nation", "type": "int"}]}}


def _t(spark, sf, name):
    return fx.table(spark, sf, name)


def _base(spark, sf):
    return fx.derive(spark, sf, "base")


def _edited(spark, sf):
    return fx.derive(spark, sf, "edited")


def _ledger(spark, sf):
    return fx.ledger(spark, sf)


def _raw(spark, sf):
    return fx.derive(spark, sf, "raw_customer")


def _manifest(spark, sf):
    return mf.derive_manifest(fx.derive(spark, sf, "manifest_raw"))


def _flat_changes(ch: DataFrame) -> DataFrame:
    cols = [F.col(c) for c in ["id", "table_name", "database_name", "operation", "row_identifier"]]
    for f in BASE_FIELDS:
        cols += [F.try_element_at("before", F.lit(f)).alias(f"before_{f}"),
                 F.try_element_at("after", F.lit(f)).alias(f"after_{f}")]
    cols += [F.col(c) for c in ["updated_by", "updated_at", "session_id", "change_reason"]]
    return ch.select(*cols)


# ------------------------------------------------------------------- sources
def q_detect_separator(spark: SparkSession, sf: str) -> DataFrame:
    # whole texts: every separator in every document counts
    return detect_separator(_t(spark, sf, "documents"), "text", "doc_id", sniff_bytes=None)


def q_read_delimited_auto(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "csv-roundtrip")
    export_csv(_t(spark, sf, "customer"), path)
    return read_delimited(spark, path, sep="auto")


def q_read_delimited_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents through CSV files, one per writing task: records hold newlines, quotes and separators, and are read by splits."""
    path = scratch_dir(spark, "csv-documents")
    export_csv(_t(spark, sf, "documents"), path)
    return read_delimited(spark, path, sep=",")  # as exported: a file's head may hold more of another separator in its texts


def q_csv_empty_text(spark: SparkSession, sf: str) -> DataFrame:
    """B1 and A1: an empty text and a null are still told apart after a round trip."""
    path = scratch_dir(spark, "csv-empty")
    export_csv(fx.derive(spark, sf, "empty_text"), path)
    return read_delimited(spark, path)


def q_detect_separator_head(spark: SparkSession, sf: str) -> DataFrame:
    """A2 as a file is sniffed: by the first 1024 bytes of each text."""
    return detect_separator(_t(spark, sf, "documents"), "text", "doc_id")


def q_profile_mixed_files(spark: SparkSession, sf: str) -> DataFrame:
    """C5 over files of two separators."""
    from vellum.sources.delimited import profile_file
    path = scratch_dir(spark, "csv-mixed")
    for sep in (";", ","):
        _t(spark, sf, "customer").write.mode("append").option("header", True).option("sep", sep).csv(path)
    return profile_file(spark, path).select("format", "column_count", "row_count",
                                            F.to_json("column_types").alias("column_types_json"), "separator")


def q_profile_file(spark: SparkSession, sf: str) -> DataFrame:
    """C5 end to end: export customer as CSV, then sniff, read and profile it."""
    from vellum.sources.delimited import profile_file
    path = scratch_dir(spark, "csv-profile")
    export_csv(_t(spark, sf, "customer"), path)
    return profile_file(spark, path).select("format", "column_count", "row_count",
                                            F.to_json("column_types").alias("column_types_json"), "separator")


PREAMBLE = ["relatorio de clientes", "fonte: customer"]


def q_read_delimited_preamble(spark: SparkSession, sf: str) -> DataFrame:
    """A1 with header_row=2: ';'-separated files, each with two preamble lines; the data repeat the header line."""
    path = scratch_dir(spark, "csv-preamble")
    cust = _t(spark, sf, "customer")
    header = ";".join(cust.columns)
    part = F.pmod("c_custkey", F.lit(4)).alias("part")
    heads = F.posexplode(F.array(*[F.lit(x) for x in PREAMBLE + [header, header]])).alias("place", "value")
    head = cust.select(part).distinct().select("part", heads)
    body = cust.select(part, F.lit(9).alias("place"),
                       F.concat_ws(";", *[F.col(c).cast("string") for c in cust.columns]).alias("value"))
    (head.unionByName(body).repartition("part").sortWithinPartitions("part", "place").select("part", "value")
     .write.partitionBy("part").text(path))
    return read_delimited(spark, path, sep="auto", header_row=len(PREAMBLE))


def q_preview(spark: SparkSession, sf: str) -> DataFrame:
    return profile.preview(_t(spark, sf, "customer"), 10, order_by=["c_custkey"])


# ------------------------------------------------------------------- renames
def _odd(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select(*[F.col(s).alias(n) for s, n in zip(ODD_SOURCES, ODD_NAMES)])


def q_rename_strict(spark: SparkSession, sf: str) -> DataFrame:
    return rename.rename_strict(_odd(spark, sf))


def q_rename_simple(spark: SparkSession, sf: str) -> DataFrame:
    return rename.rename_simple(_odd(spark, sf))


# ------------------------------------------------------------------ profiling
def q_infer_types(spark: SparkSession, sf: str) -> DataFrame:
    return profile.infer_types(_raw(spark, sf))


def q_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = profile.profile(_raw(spark, sf), fmt="csv", separator=",")
    return p.select("format", "column_count", "row_count",
                    F.to_json("column_types").alias("column_types_json"), "separator")


def q_type_labels(spark: SparkSession, sf: str) -> DataFrame:
    return profile.type_labels(profile.infer_types(_raw(spark, sf)))


def q_facet_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.facet_profile(_t(spark, sf, "customer"))


FACET_PICKS = {"c_mktsegment": ["BUILDING", "MACHINERY"]}
FACET_SEARCH = {"c_name": "00001"}


def q_facet_controls(spark: SparkSession, sf: str) -> DataFrame:
    return profile.facet_controls(_t(spark, sf, "customer"))


def q_facet_filter(spark: SparkSession, sf: str) -> DataFrame:
    return profile.facet_filter(_t(spark, sf, "customer"), FACET_PICKS, FACET_SEARCH)


def q_filter_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.filter_counts(_t(spark, sf, "customer"), profile.facet_predicate(FACET_PICKS, FACET_SEARCH))


def q_stringify(spark: SparkSession, sf: str) -> DataFrame:
    return profile.stringify(_t(spark, sf, "customer"))


# ----------------------------------------------------------------- contracts
def q_blank_counts(spark: SparkSession, sf: str) -> DataFrame:
    return contract.blank_counts(_raw(spark, sf), fx.RAW_CONTRACT)


def q_cell_violations(spark: SparkSession, sf: str) -> DataFrame:
    return contract.violations(_raw(spark, sf), fx.RAW_CONTRACT, "row_key")


def q_cell_violations_rows(spark: SparkSession, sf: str) -> DataFrame:
    """E6 for an upload without a key: its rows are told by their number in the file."""
    path = scratch_dir(spark, "csv-upload")
    export_csv(_raw(spark, sf).orderBy("row_key").drop("row_key"), path)
    return contract.violations(read_numbered(spark, path), fx.RAW_CONTRACT, "row")


def q_cell_violations_events(spark: SparkSession, sf: str) -> DataFrame:
    """A contract with a datetime."""
    return contract.violations(fx.derive(spark, sf, "raw_events"), fx.EVENTS_CONTRACT, "row_key")


def q_validation_report(spark: SparkSession, sf: str) -> DataFrame:
    return contract.validation_report(_raw(spark, sf), fx.RAW_CONTRACT, "row_key")


def q_cell_violations_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return contract.violations(fx.derive(spark, sf, "raw_lineitem"), fx.LINEITEM_CONTRACT, "row_key")


def q_validation_report_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return contract.validation_report(fx.derive(spark, sf, "raw_lineitem"), fx.LINEITEM_CONTRACT, "row_key")


def q_infer_types_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return profile.infer_types(fx.derive(spark, sf, "raw_lineitem"))


# ------------------------------------------------------------ landing, files
def q_land_keys(spark: SparkSession, sf: str) -> DataFrame:
    m = _manifest(spark, sf)
    parts = F.split("file_key", "/")
    return m.select("file_key", landing_key(F.col("filename"), F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3)),
                                            F.col("upload_date")).alias("landing_key"))


def q_file_filters(spark: SparkSession, sf: str) -> DataFrame:
    m = _manifest(spark, sf)
    return accept_files(m, max_mb=MAX_MB, name_col="filename", size_col="file_size_bytes").select(
        "file_key", "filename", "file_size_bytes")


def q_land_gated(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_dir(spark, "landing")
    res = land(_base(spark, sf), BASE_CONTRACT, root,
               {"subject": "sistema", "sub_subject": "clientes", "original_filename": "clientes.csv"},
               dt.datetime(2024, 3, 1, 12, 0, 0))
    if not res.ok:
        raise RuntimeError(res.message)
    return spark.read.option("header", True).csv(res.data_path).select(*BASE_FIELDS)


def q_stream_landing(spark: SparkSession, sf: str) -> DataFrame:
    from vellum.streaming import land_stream
    inbox = scratch_dir(spark, "inbox")
    export_csv(_base(spark, sf), inbox)
    root = scratch_dir(spark, "stream-landing")
    q = land_stream(spark, inbox, BASE_CONTRACT, root, scratch_dir(spark, "stream-ckpt"),
                    {"subject": "sistema", "sub_subject": "clientes"})
    q.awaitTermination()
    return spark.read.option("header", True).csv(root + "/data").select(*BASE_FIELDS)


def q_landed_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Eight files landed by the stream and one by the batch job, listed, joined to their manifest and summed up."""
    from vellum.streaming import land_stream
    inbox, root = scratch_dir(spark, "inbox"), scratch_dir(spark, "landed")
    meta = {"subject": "sistema", "sub_subject": "clientes"}
    export_csv(_base(spark, sf).repartition(8), inbox)
    land_stream(spark, inbox, BASE_CONTRACT, root, scratch_dir(spark, "stream-ckpt"), meta).awaitTermination()
    res = land(_edited(spark, sf), BASE_CONTRACT, root, meta | {"original_filename": "clientes.csv"}, dt.datetime(2024, 3, 1, 12, 0, 0))
    if not res.ok:
        raise RuntimeError(res.message)
    landed = mf.attach_metadata(list_landed(spark, root), spark.read.parquet(root + "/manifest").drop("upload"))
    described = landed.filter((F.col("schema_used") == BASE_CONTRACT["description"]) & (F.col("file_size_bytes") > 0))
    return mf.manifest_stats(described, AS_OF).select("total_files", "total_rows")


# ------------------------------------------------------------------ manifest
def q_manifest_derive(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).select(
        "file_key", "filename", "extension", "original_filename", "upload_date", "file_size_bytes",
        "file_size_mb", "size_label", "schema_used", "row_count", "column_count", "upload_timestamp")


def q_manifest_history(spark: SparkSession, sf: str) -> DataFrame:
    return mf.history(_manifest(spark, sf), 50)


def q_history_view(spark: SparkSession, sf: str) -> DataFrame:
    return mf.history_view(_manifest(spark, sf))


def q_manifest_stats(spark: SparkSession, sf: str) -> DataFrame:
    return mf.manifest_stats(_manifest(spark, sf), AS_OF)


def q_top_schemas(spark: SparkSession, sf: str) -> DataFrame:
    return mf.top_schemas(_manifest(spark, sf), 5)


def q_landings_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return mf.landings_by_day(_manifest(spark, sf), AS_OF, RECENT_DAYS)


def q_manifest_search(spark: SparkSession, sf: str) -> DataFrame:
    return mf.search(_manifest(spark, sf), SEARCH_TERM, 20)


def q_schema_category(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).select("file_key", "schema_used",
                                       mf.schema_category(F.col("schema_used")).alias("category"))


def q_metadata_map(spark: SparkSession, sf: str) -> DataFrame:
    return mf.metadata_map(_manifest(spark, sf)).select("file_key", F.to_json("metadata").alias("metadata_json"))


def q_manifest_attach(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.derive(spark, sf, "manifest_raw")
    listing = raw.select("file_key", "file_size_bytes", "upload_date")
    # metadata exists for the files whose document carries a label (a semi-join
    # over whole tables); the other files keep the listing's defaults
    labelled = _t(spark, sf, "labels").select("doc_id")
    meta = raw.join(labelled, "doc_id", "left_semi").drop("file_size_bytes", "upload_date", "doc_id")
    return mf.attach_metadata(listing, meta).select(
        "file_key", "filename", "original_filename", "file_size_mb", "schema_used", "row_count")


# -------------------------------------------------------------------- ledger
def q_diff_updates(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_changes(diff.diff_updates(_base(spark, sf), _edited(spark, sf), "id", META))


def q_diff_positional(spark: SparkSession, sf: str) -> DataFrame:
    cust = diff.with_position(_t(spark, sf, "customer"), "row_index")
    b = spark.sql("SELECT row_index, " + fx.BASE.split("SELECT", 1)[1], customer=cust)
    e = spark.sql("SELECT row_index, " + fx.EDITED.split("SELECT", 1)[1], customer=cust)
    return _flat_changes(diff.diff_positional(b, e, "row_index", META, key="id"))


def q_any_change(spark: SparkSession, sf: str) -> DataFrame:
    return diff.change_summary(_base(spark, sf), _edited(spark, sf), "id")


def q_any_change_multiset(spark: SparkSession, sf: str) -> DataFrame:
    return diff.change_summary(_base(spark, sf), _edited(spark, sf))


def q_widen_types(spark: SparkSession, sf: str) -> DataFrame:
    return diff.widen_types(_t(spark, sf, "customer"))


def q_ledger_write_read(spark: SparkSession, sf: str) -> DataFrame:
    loc = scratch_dir(spark, "ledger")
    name = "ledger_" + loc.rsplit("-", 1)[-1]
    create_ledger(spark, name, loc)
    append_changes(diff.diff_updates(_base(spark, sf), _edited(spark, sf), "id", META), name)
    return _flat_changes(spark.table(name))


def q_ledger_append_twice(spark: SparkSession, sf: str) -> DataFrame:
    """A batch that is sent twice is in the ledger once, beside another batch."""
    loc = scratch_dir(spark, "ledger")
    name = "ledger_" + loc.rsplit("-", 1)[-1]
    create_ledger(spark, name, loc, by_batch=True)
    changes = diff.diff_updates(_base(spark, sf), _edited(spark, sf), "id", META)
    orders = diff.diff_updates(fx.derive(spark, sf, "base_orders"), fx.derive(spark, sf, "edited_orders"), "id", META_ORDERS)
    for batch, rows in (("save-1", changes), ("save-2", orders), ("save-1", changes)):
        append_changes(rows, name, batch)
    return committed_changes(spark, name).groupBy("batch", "table_name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("row_identifier").alias("n_rows"))


def q_ledger_reset_append(spark: SparkSession, sf: str) -> DataFrame:
    """After a reset only what is appended then is there."""
    loc = scratch_dir(spark, "ledger")
    name = "ledger_" + loc.rsplit("-", 1)[-1]
    create_ledger(spark, name, loc)
    append_changes(diff.diff_updates(fx.derive(spark, sf, "base_orders"), fx.derive(spark, sf, "edited_orders"), "id", META_ORDERS), name)
    reset_ledger(spark, name, loc, confirm=True)
    append_changes(diff.diff_updates(_base(spark, sf), _edited(spark, sf), "id", META), name)
    return _flat_changes(spark.table(name))


def q_diff_guessed_key(spark: SparkSession, sf: str) -> DataFrame:
    """the key is guessed from the column names."""
    base = _base(spark, sf).select("name", "segment", "id", "nation")
    return _flat_changes(diff.diff_updates(base, _edited(spark, sf).select(*base.columns), diff.guess_key(base), META))


def q_ledger_reset(spark: SparkSession, sf: str) -> DataFrame:
    loc = scratch_dir(spark, "ledger")
    name = "ledger_" + loc.rsplit("-", 1)[-1]
    create_ledger(spark, name, loc)
    append_changes(diff.diff_updates(_base(spark, sf), _edited(spark, sf), "id", META), name)
    reset_ledger(spark, name, loc, confirm=True)
    return _flat_changes(spark.table(name))


def q_external_table(spark: SparkSession, sf: str) -> DataFrame:
    loc = scratch_dir(spark, "external")
    cust = _t(spark, sf, "customer")
    export_csv(cust, loc)
    name = "ext_" + loc.rsplit("-", 1)[-1]
    register_external(spark, name, loc, [{"name": f.name, "type": f.dataType.simpleString()}
                                         for f in cust.schema.fields], "csv")
    return spark.table(name)


def q_external_table_parquet(spark: SparkSession, sf: str) -> DataFrame:
    loc = scratch_dir(spark, "external")
    cust = _t(spark, sf, "customer")
    cust.write.parquet(loc)
    name = "ext_" + loc.rsplit("-", 1)[-1]
    register_external(spark, name, loc, [{"name": f.name, "type": f.dataType.simpleString()}
                                         for f in cust.schema.fields], "parquet")
    return spark.table(name)


# ------------------------------------------------------------- merge on read
def q_overlay_updates(spark: SparkSession, sf: str) -> DataFrame:
    return replay.overlay_updates(_base(spark, sf), _ledger(spark, sf), "id")


def q_replay_latest(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay(_base(spark, sf), _ledger(spark, sf), "id", table="customer", database="main")


def q_replay_as_written(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay(_base(spark, sf), _ledger(spark, sf), "id", precedence="as_written",
                         table="customer", database="main")


def _views(spark, sf, with_ledger: bool):
    tag = uuid.uuid4().hex[:12]
    b, l = f"base_{tag}", f"ledger_{tag}"
    _base(spark, sf).createOrReplaceTempView(b)
    if with_ledger:
        _ledger(spark, sf).withColumn("table_name", F.lit(b)).createOrReplaceTempView(l)
    return b, l


def q_current_view(spark: SparkSession, sf: str) -> DataFrame:
    b, l = _views(spark, sf, True)
    return replay.current_view(spark, b, l, "id", database="main")


def q_current_view_fallback(spark: SparkSession, sf: str) -> DataFrame:
    b, l = _views(spark, sf, False)
    return replay.current_view(spark, b, l, "id", database="main")


def q_replay_refused(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger without one of the change-record columns is not replayed; the base comes back as it is."""
    base, ledger = _base(spark, sf), _ledger(spark, sf)
    out = replay.replay(base, ledger.drop(replay.REQUIRED[0]), "id", table="customer", database="main")
    for missing in replay.REQUIRED[1:]:
        out = replay.replay(out, ledger.drop(missing), "id", table="customer", database="main")
    return out


ORDER_FIELDS = ["id", "status", "priority", "customer"]
META_ORDERS = diff.ChangeMeta("main", "orders", "editor", dt.datetime(2024, 3, 2, 8, 30, 0), "sess0002")


def _flat_order_changes(ch: DataFrame) -> DataFrame:
    cols = [F.col(c) for c in ["id", "table_name", "database_name", "operation", "row_identifier"]]
    for f in ORDER_FIELDS:
        cols += [F.try_element_at("before", F.lit(f)).alias(f"before_{f}"),
                 F.try_element_at("after", F.lit(f)).alias(f"after_{f}")]
    cols += [F.col(c) for c in ["updated_by", "updated_at", "session_id", "change_reason"]]
    return ch.select(*cols)


def q_diff_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_order_changes(diff.diff_updates(fx.derive(spark, sf, "base_orders"),
                                                 fx.derive(spark, sf, "edited_orders"), "id", META_ORDERS))


def q_replay_orders(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay(fx.derive(spark, sf, "base_orders"), fx.ledger_orders(spark, sf), "id",
                         table="orders", database="main")


def q_replay_orders_as_written(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay(fx.derive(spark, sf, "base_orders"), fx.ledger_orders(spark, sf), "id",
                         precedence="as_written", table="orders", database="main")


def q_overlay_orders(spark: SparkSession, sf: str) -> DataFrame:
    return replay.overlay_updates(fx.derive(spark, sf, "base_orders"), fx.ledger_orders(spark, sf), "id",
                                  table="orders", database="main")


# --------------------------------------------------------------------- audit
def q_change_fields(spark: SparkSession, sf: str) -> DataFrame:
    return audit.change_fields(_ledger(spark, sf), IMAGE_FIELDS, "customer")


def q_change_view(spark: SparkSession, sf: str) -> DataFrame:
    return audit.change_view(_ledger(spark, sf), "customer", IMAGE_FIELDS)


def q_field_changed(spark: SparkSession, sf: str) -> DataFrame:
    return audit.field_changed(_ledger(spark, sf), "customer", "segment")


def q_row_history(spark: SparkSession, sf: str) -> DataFrame:
    return audit.row_history(_ledger(spark, sf), "customer", HISTORY_ROW, IMAGE_FIELDS)


def q_changes_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return audit.changes_by_day(_ledger(spark, sf), "customer", SINCE)


def q_ledger_filter(spark: SparkSession, sf: str) -> DataFrame:
    return audit.ledger_filter(_ledger(spark, sf), "cust", "UPDATE", 100)


def q_ledger_filter_few(spark: SparkSession, sf: str) -> DataFrame:
    return audit.ledger_filter(_ledger(spark, sf), "cust", "UPDATE", 5)


def q_ledger_filter_many(spark: SparkSession, sf: str) -> DataFrame:
    return audit.ledger_filter(_ledger(spark, sf), "cust", "UPDATE", 5000)


def q_changes_by_day_orders(spark: SparkSession, sf: str) -> DataFrame:
    return audit.changes_by_day(fx.ledger_orders(spark, sf), "orders", dt.date(1995, 1, 1))


def q_ledger_stats_orders(spark: SparkSession, sf: str) -> DataFrame:
    return audit.ledger_stats(fx.ledger_orders(spark, sf))


def q_ledger_stats(spark: SparkSession, sf: str) -> DataFrame:
    return audit.ledger_stats(_ledger(spark, sf))


# -------------------------------------------------------------------- legacy
def q_legacy_pack_unpack(spark: SparkSession, sf: str) -> DataFrame:
    led = _ledger(spark, sf)
    packed = led.select("id", pack_image(F.col("after"), BASE_FIELDS).alias("packed"))
    img = unpack_image(F.col("packed"), BASE_FIELDS)
    return packed.select("id", "packed", *[F.try_element_at(img, F.lit(f)).alias(f"u_{f}") for f in BASE_FIELDS])


def q_legacy_brace_unpack(spark: SparkSession, sf: str) -> DataFrame:
    flat = fx.derive(spark, sf, "ledger_flat")
    text = F.concat(F.lit("{segment="), F.col("after_segment"), F.lit(" name="), F.col("after_name"), F.lit("}"))
    img = unpack_image(text, LEGACY_FIELDS)
    return flat.select("id", F.try_element_at(img, F.lit("segment")).alias("u_segment"),
                       F.try_element_at(img, F.lit("name")).alias("u_name"),
                       F.try_element_at(img, F.lit("email")).alias("u_email"),
                       F.size(img).alias("n_fields"))


def q_legacy_sorted_unpack(spark: SparkSession, sf: str) -> DataFrame:
    """images whose values are in the alphabetical order of their fields."""
    flat = fx.derive(spark, sf, "ledger_flat")
    img = unpack_sorted_image(F.concat_ws(",", "after_name", "after_segment"), IMAGE_FIELDS)
    return flat.select("id", *[F.try_element_at(img, F.lit(f)).alias(f"u_{f}") for f in IMAGE_FIELDS])


def q_legacy_import(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "legacy")
    export_legacy_log(_ledger(spark, sf), path, IMAGE_FIELDS)
    led = read_legacy_log(spark, path, IMAGE_FIELDS)
    return led.select("id", "operation", "row_identifier",
                      F.try_element_at("after", F.lit("segment")).alias("after_segment"),
                      F.try_element_at("after", F.lit("name")).alias("after_name"),
                      F.try_element_at("before", F.lit("segment")).alias("before_segment"),
                      "updated_at")


def q_json_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", clean_json(F.col("props")).alias("props_clean"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
