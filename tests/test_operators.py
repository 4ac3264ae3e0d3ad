"""Table-driven tests for contract, profile, manifest, audit, sources, sinks."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from vellum.operators import audit, contract, diff, manifest as mf, profile
from vellum.session import local_path, scratch_dir
from vellum.sinks.csv_export import export_csv
from vellum.sinks.landing import land
from vellum.sinks.ledger_store import append_changes, create_ledger, register_external, reset_ledger
from vellum.sources.delimited import detect_separator, read_delimited, sniff_separator
from vellum.sources.listing import accept_files, list_files

CONTRACT = {"description": "users", "schema": {"fields": [
    {"name": "id", "type": "int", "required": True},
    {"name": "first_name", "type": "str", "required": True},
    {"name": "email", "type": "str", "required": True},
    {"name": "is_active", "type": "bool"},
    {"name": "joined", "type": "date"},
]}}


def users(spark):
    return spark.createDataFrame([
        ("1", "Ana", "true", "2024-01-05"),
        ("x2", " ", "NO", "2024-02-30"),
        ("3", None, "true ", ""),
        ("", "Bo", None, "31/12/2024"),
    ], "id string, first_name string, is_active string, joined string")


def test_missing_and_blank(spark):
    df = users(spark)
    assert contract.missing_columns(df, CONTRACT) == ["email"]
    got = {(r["field"], r["n_blank"]) for r in contract.blank_counts(df, CONTRACT).collect()}
    assert got == {("id", 1), ("first_name", 2)}


def test_violations_and_report_order(spark):
    df = users(spark)
    v = {(r["id"], r["field"], r["value"]) for r in contract.violations(df, CONTRACT, "id").collect()}
    assert v == {("x2", "id", "x2"), ("x2", "joined", "2024-02-30"), ("3", "is_active", "true ")}
    rep = contract.validation_report(df, CONTRACT, "id").orderBy("section", "ordinal", "row_key").collect()
    kinds = [(r["section"], r["kind"], r["field"]) for r in rep]
    assert kinds[0] == (1, "blank", "id") and (1, "missing", "email") in kinds
    assert [k for k in kinds if k[0] == 2] == [(2, "type", "id"), (2, "type", "is_active"), (2, "type", "joined")]
    assert contract.violation_count(df, CONTRACT) == 1 + 2 + 3


def test_report_invalid_inputs(spark):
    empty = spark.createDataFrame([], "id string")
    assert [r["kind"] for r in contract.validation_report(empty, CONTRACT).collect()] == ["invalid input"]
    assert contract.violation_count(empty, CONTRACT) == 1 and contract.violation_count(users(spark), None) == 1
    assert [r["kind"] for r in contract.validation_report(users(spark), None).collect()] == ["invalid input"]


def test_typed_columns(spark):
    df = spark.createDataFrame([(1.5, 1, True), (float("inf"), 2, False)], "a double, b int, c boolean")
    c = {"schema": {"fields": [{"name": "a", "type": "int"}, {"name": "b", "type": "bool"},
                               {"name": "c", "type": "bool"}]}}
    got = {(r["field"], r["value"]) for r in contract.violations(df, c).collect()}
    assert got == {("a", "Infinity"), ("b", "2")}


def test_infer_and_labels(spark):
    df = spark.createDataFrame([("1", "1.5", "sim", "2024-01-01x", None, "a"),
                                ("-2", "3,25", "NÃO", "31/12/2024", None, "1")],
                               "a string, b string, c string, d string, e string, f string")
    got = {r["column"]: r["inferred_type"] for r in profile.infer_types(df).collect()}
    assert got == {"a": "int64", "b": "float64", "c": "bool", "d": "datetime64", "e": "object", "f": "object"}
    lab = {r["column"]: r["label"] for r in profile.type_labels(profile.infer_types(df)).collect()}
    assert lab["a"] == "Whole numbers" and lab["e"] == "Text"
    p = profile.profile(df, separator=";").first()
    assert p["row_count"] == 2 and p["column_count"] == 6 and p["column_types"]["b"] == "float64"


def test_facets(spark):
    df = spark.createDataFrame([(i, f"n{i}", ["a", "b", "None", ""][i % 4], "k") for i in range(60)],
                               "id int, name string, cat string, one string")
    fp = {r["column"]: r for r in profile.facet_profile(df, max_picks=50).collect()}
    assert fp["id"]["control"] == "search" and fp["id"]["pick_values"] is None
    assert fp["cat"]["control"] == "pick" and fp["cat"]["pick_values"] == "a|b"
    assert fp["one"]["control"] == "none" and fp["one"]["n_distinct"] == 1
    empty_col = profile.facet_profile(df.selectExpr("id", "CAST(NULL AS STRING) AS nothing")).collect()
    assert {r["column"]: (r["n_distinct"], r["control"]) for r in empty_col} == {"id": (60, "search"),
                                                                                  "nothing": (0, "none")}
    out = profile.facet_filter(df, {"cat": ["a"]}, {"name": "N1"}).collect()
    assert sorted(r["id"] for r in out) == [12, 16]
    fc = profile.filter_counts(df, profile.facet_predicate({"cat": ["b"]})).first()
    assert (fc["total_rows"], fc["filtered_rows"], fc["column_count"]) == (60, 15, 4)


def test_stringify_and_preview(spark):
    df = spark.createDataFrame([(1, None, 2.5)], "a int, b string, c double")
    assert profile.stringify(df).first().asDict() == {"a": "1", "b": "", "c": "2.5"}
    df2 = spark.range(100)
    assert [r.id for r in profile.preview(df2, 3, order_by=["id"]).collect()] == [0, 1, 2]


def test_manifest_derive_and_reports(spark):
    rows = [("sistema/a/b/f1.CSV", "Orig.csv", dt.datetime(2024, 1, 15, 9), 512, "vendas x", "12"),
            ("sistema/a/b/f2.txt", None, dt.datetime(2024, 1, 14, 9), 1280, None, "n/a"),
            ("sistema/a/b/f3.xlsx", "o3", dt.datetime(2024, 1, 1, 9), 5 * 1024 * 1024 + 1, "rh folha", None)]
    raw = spark.createDataFrame(rows, "file_key string, original_filename string, upload_date timestamp_ntz, "
                                      "file_size_bytes long, schema_used string, row_count_text string")
    m = mf.derive_manifest(raw)
    d = {r["filename"]: r for r in m.collect()}
    assert d["f1.CSV"]["extension"] == "csv" and d["f1.CSV"]["size_label"] == "512 bytes"
    assert d["f2.txt"]["size_label"] == "1.2 KB"  # 1.25 rounds half to even
    assert d["f3.xlsx"]["size_label"] == "5.0 MB" and d["f3.xlsx"]["file_size_mb"] == 5.0
    assert d["f2.txt"]["original_filename"] == "N/A" and d["f2.txt"]["row_count"] == 0
    assert d["f1.CSV"]["row_count"] == 12
    st = mf.manifest_stats(m, dt.date(2024, 1, 15)).first()
    assert st["total_files"] == 3 and st["files_today"] == 1 and st["total_rows"] == 12
    assert [r["schema_used"] for r in mf.top_schemas(m).collect()] == ["rh folha", "vendas x"]
    days = [(str(r["upload_day"]), r["files_count"]) for r in mf.landings_by_day(m, dt.date(2024, 1, 15), 7).collect()]
    assert days == [("2024-01-15", 1), ("2024-01-14", 1)]
    assert [r["filename"] for r in mf.search(m, "VENDAS").collect()] == ["f1.CSV"]
    assert [r["filename"] for r in mf.history(m, 2).collect()] == ["f1.CSV", "f2.txt"]
    cats = {r["schema_used"]: r["c"] for r in m.select("schema_used", mf.schema_category(F.col("schema_used"))
                                                        .alias("c")).collect()}
    assert cats == {"vendas x": "sales", "N/A": "other", "rh folha": "people"}
    acc = accept_files(m, max_mb=5, name_col="filename", size_col="file_size_bytes").collect()
    assert [r["filename"] for r in acc] == ["f1.CSV"]


def test_audit(spark):
    from vellum.operators.diff import LEDGER_SCHEMA
    t = dt.datetime(2024, 1, 1)
    recs = [("a", "users", "d", "UPDATE", "1", {"email": "x"}, {"email": "y"}, "u1", t, "s", "r"),
            ("b", "users", "d", "UPDATE", "1", {"email": "y"}, {"email": "y"}, "u2", t + dt.timedelta(days=1), "s", "r"),
            ("c", "orders", "d", "DELETE", "9", {}, {}, "u1", t + dt.timedelta(days=1), "s", "r"),
            ("d", "users", "d", "UPDATE", "2", None, {"email": "z"}, "u1", t + dt.timedelta(days=2), "s", "r")]
    led = spark.createDataFrame(recs, LEDGER_SCHEMA)
    assert [r["row_identifier"] for r in audit.field_changed(led, "users", "email").collect()] == ["1"]
    assert [r["operation"] for r in audit.row_history(led, "users", "1", ["email"]).collect()] == ["UPDATE"] * 2
    by_day = [(str(r["change_date"]), r["total_changes"], r["editors"])
              for r in audit.changes_by_day(led, "users", dt.date(2024, 1, 2)).collect()]
    assert by_day == [("2024-01-03", 1, 1), ("2024-01-02", 1, 1)]
    st = audit.ledger_stats(led).first()
    assert (st["total_changes"], st["tables_affected"], st["top_operation"], st["top_operation_count"]) == \
        (4, 2, "UPDATE", 3)
    f = audit.ledger_filter(led, "ser", "UPDATE", 10).collect()
    assert [r["id"] for r in f] == ["d", "b", "a"]
    v = audit.change_view(led, "users", ["email"], view_name="chg_users")
    assert spark.sql("SELECT count(*) FROM chg_users").first()[0] == 3 and v.count() == 3


def test_csv_roundtrip_and_separators(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b", 2.5), (2, "c", None)], "k int, s string, x double")
    path = str(tmp_path / "semi")
    df.coalesce(1).write.option("header", True).option("sep", ";").csv(path)
    assert sniff_separator(spark, path) == ";"
    back = read_delimited(spark, path)
    assert back.columns == ["k", "s", "x"] and dict(back.dtypes)["k"] == "string"
    assert sorted(r["k"] for r in back.collect()) == ["1", "2"]
    heads = spark.createDataFrame([(1, "a,b;c"), (2, "a;b,c"), (3, "x|y|z\tq"), (4, "none"), (5, "é" * 600 + ";;")],
                                  "id int, h string")
    got = {r["id"]: r["separator"] for r in detect_separator(heads, "h", "id").collect()}
    assert got == {1: ",", 2: ",", 3: "|", 4: ",", 5: ","}  # 5: the ';' lie past byte 1024


def test_header_row_preamble(spark, tmp_path):
    p = tmp_path / "pre.csv"
    p.write_text("report x\ngenerated y\na|b\n1|2\n3|4\n")
    df = read_delimited(spark, str(p), sep="auto", header_row=2)
    assert df.columns == ["a", "b"] and sorted(tuple(r) for r in df.collect()) == [("1", "2"), ("3", "4")]


def test_list_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.csv").write_text("a\n1\n")
    (tmp_path / "g.xlsx").write_bytes(b"x" * 10)
    got = {r["filename"]: r["length"] for r in list_files(spark, str(tmp_path)).collect()}
    assert got == {"f.csv": 4, "g.xlsx": 10}


def test_land_gate(spark):
    root = scratch_dir(spark, "land-test")
    bad = land(users(spark), CONTRACT, root, {"subject": "s", "sub_subject": "ss", "original_filename": "u.csv"},
               dt.datetime(2024, 3, 1, 12))
    assert not bad.ok and bad.problems == 6
    assert not os.path.exists(local_path(root) + "/data") and not os.path.exists(local_path(root) + "/manifest")
    ok_df = spark.createDataFrame([("1", "Ana", "a@b"), ("2", "Bo", "b@c")], "id string, first_name string, email string")
    res = land(ok_df, CONTRACT, root, {"subject": "s", "sub_subject": "ss", "original_filename": "u.csv"},
               dt.datetime(2024, 3, 1, 12))
    assert res.ok and res.rows == 2 and res.columns == 3
    assert res.object_key == "sistema/s/ss/2024-03-01/u_20240301_120000.csv"
    back = spark.read.option("header", True).option("basePath", root + "/data").csv(res.data_path)
    assert back.count() == 2 and {r["landed_day"] for r in back.collect()} == {dt.date(2024, 3, 1)}
    man = spark.read.parquet(root + "/manifest").first()
    assert man["row_count_text"] == "2" and man["schema_used"] == "users"


def test_ledger_store(spark):
    loc = scratch_dir(spark, "ledger-test")
    name = "ledger_t_" + loc.rsplit("-", 1)[-1]
    create_ledger(spark, name, loc)
    create_ledger(spark, name, loc)  # no-op when present
    before = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    after = spark.createDataFrame([("1", "a"), ("2", "B")], "id string, v string")
    meta = diff.ChangeMeta("db", "t", "me", dt.datetime(2024, 1, 1), "s1")
    assert append_changes(diff.diff_updates(before, after, "id", meta), name) == 1
    assert append_changes(diff.diff_updates(before, before, "id", meta), name) == 0
    rows = spark.table(name).collect()
    assert len(rows) == 1 and rows[0]["after"]["v"] == "B" and rows[0]["table_name"] == "t"
    with pytest.raises(ValueError):
        reset_ledger(spark, name, loc)
    reset_ledger(spark, name, loc, confirm=True)
    assert spark.table(name).count() == 0


def test_register_external(spark):
    loc = scratch_dir(spark, "ext-test")
    export_csv(spark.createDataFrame([(1, "a")], "k int, v string"), loc)
    register_external(spark, "ext_t1", loc, [{"name": "k", "type": "int"}, {"name": "v", "type": "string"}])
    assert [tuple(r) for r in spark.table("ext_t1").collect()] == [(1, "a")]
    pq = scratch_dir(spark, "ext-pq")
    spark.createDataFrame([(2, "b")], "k int, v string").write.parquet(pq)
    one_file = [f for f in os.listdir(local_path(pq)) if f.endswith(".parquet")][0]
    register_external(spark, "ext_t2", pq + "/" + one_file, [{"name": "k", "type": "int"}, {"name": "v", "type": "string"}],
                      "parquet")
    assert [tuple(r) for r in spark.table("ext_t2").collect()] == [(2, "b")]


def test_diff_positional_and_summary(spark):
    b = spark.createDataFrame([(0, "1", "a"), (1, "2", "b"), (2, "3", "c")], "pos long, id string, v string")
    a = spark.createDataFrame([(0, "1", "a"), (1, "2", "X"), (2, "3", "c"), (3, "4", "d")],
                              "pos long, id string, v string")
    meta = diff.ChangeMeta("db", "t", "me", dt.datetime(2024, 1, 1), "s1")
    ch = diff.diff_positional(b, a, "pos", meta, key="id").collect()
    assert [(r["row_identifier"], r["after"]["v"]) for r in ch] == [("2", "X")]
    s = diff.change_summary(b.drop("pos"), a.drop("pos"), "id").first()
    assert (s["n_before"], s["n_after"], s["n_differing"], s["changed"]) == (3, 4, 2, True)
    assert diff.any_change(b.drop("pos"), b.drop("pos")) is False
    assert diff.guess_key(["name", "valid", "x"]) == "valid" and diff.guess_key(["a", "b"]) == "a"
    w = diff.widen_types(spark.createDataFrame([(1, 2.0, [1])], "a int, b float, c array<int>"))
    assert w.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")]


def test_with_position_spans_files(spark):
    path = scratch_dir(spark, "pos")
    spark.range(0, 10, 1, 3).selectExpr("id AS v").write.parquet(path)
    pos = diff.with_position(spark.read.parquet(path)).collect()
    assert sorted(r["row_index"] for r in pos) == list(range(10))


def test_diff_rejects_duplicate_keys(spark):
    b = spark.createDataFrame([("1", "a"), ("1", "b")], "id string, v string")
    meta = diff.ChangeMeta("db", "t", "me", dt.datetime(2024, 1, 1), "s1")
    with pytest.raises(ValueError):
        diff.diff_updates(b, b, "id", meta)


def test_rename_frames(spark):
    from vellum.operators.rename import rename_preview, rename_simple, rename_strict
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Valor (R$)", "a b", "a_b", "Ação"])
    assert rename_strict(df).columns == ["valor_rs", "a_b", "a_b_1", "acao"]
    s = rename_simple(df)
    assert s.columns == ["valor_r", "a_b", "ação"] and tuple(s.first()) == (1, 3, 4)
    assert [tuple(r) for r in rename_preview(df, {"ação": "action"}).collect()] == [
        (0, "Valor (R$)", "valor_rs"), (1, "a b", "a_b"), (2, "a_b", "a_b_1"), (3, "Ação", "action")]


def test_change_summary_with_repeated_keys(spark):
    b = spark.createDataFrame([("1", "a")] * 50 + [("2", "b")], "id string, v string")
    a = spark.createDataFrame([("1", "a")] * 50 + [("2", "c")], "id string, v string")
    s = diff.change_summary(b, a, "id").first()
    assert (s["n_before"], s["n_after"], s["n_differing"], s["changed"]) == (51, 51, 1, True)
    s2 = diff.change_summary(b, b, "id").first()
    assert s2["changed"] is False


def test_land_rerun_is_idempotent(spark):
    root = scratch_dir(spark, "land-rerun")
    df = spark.createDataFrame([("1", "Ana", "a@b"), ("2", "Bo", "b@c")], "id string, first_name string, email string")
    meta = {"subject": "s", "sub_subject": "ss", "original_filename": "u.csv"}
    for _ in range(2):
        assert land(df, CONTRACT, root, meta, dt.datetime(2024, 3, 1, 12)).ok
    assert spark.read.option("header", True).csv(root + "/data").count() == 2
    assert spark.read.parquet(root + "/manifest").count() == 1


def test_bucketed_snapshots_diff_without_exchange(spark):
    from vellum.sinks.snapshots import save_snapshot
    b = spark.range(2000).selectExpr("CAST(id AS STRING) AS id", "CAST(id % 7 AS STRING) AS v")
    a = b.selectExpr("id", "CASE WHEN CAST(id AS INT) % 100 = 0 THEN 'x' ELSE v END AS v")
    tb = save_snapshot(b, "snap_before", "id", 8, scratch_dir(spark, "snap-b"))
    ta = save_snapshot(a, "snap_after", "id", 8, scratch_dir(spark, "snap-a"))
    meta = diff.ChangeMeta("db", "t", "me", dt.datetime(2024, 1, 1), "s1")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ch = diff.diff_updates(spark.table(tb), spark.table(ta), "id", meta, check_key=False)
        plan = ch._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert ch.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_legacy_log_roundtrip_with_escapes(spark):
    from vellum.operators.diff import LEDGER_SCHEMA
    from vellum.sinks.legacy_export import export_legacy_log
    from vellum.sources.legacy import read_legacy_log
    recs = [("a1", "users", "db", "UPDATE", "1", {"email": "x|y", "first_name": "A, B"},
             {"email": "z", "first_name": "C"}, "me|you", dt.datetime(2024, 1, 2, 3, 4, 5, 6), "s", "why"),
            ("a2", "users", "db", "DELETE", "2", {}, {}, "me", dt.datetime(2024, 1, 3), "s", "")]
    led = spark.createDataFrame(recs, LEDGER_SCHEMA)
    path = scratch_dir(spark, "legacy-test")
    export_legacy_log(led, path, ["email", "first_name"])
    back = {r["id"]: r for r in read_legacy_log(spark, path, ["email", "first_name"]).collect()}
    a1 = back["a1"]
    assert a1["before"] == {"email": "x|y", "first_name": "A, B"} and a1["after"] == {"email": "z", "first_name": "C"}
    assert a1["updated_by"] == "me|you" and a1["updated_at"] == dt.datetime(2024, 1, 2, 3, 4, 5, 6)
    assert back["a2"]["before"] == {} and back["a2"]["operation"] == "DELETE"


def test_read_delimited_glob(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x|y\n1|2\n")
    (tmp_path / "b.csv").write_text("x|y\n3|4\n")
    (tmp_path / "notes.txt").write_text("ignore me, really")
    df = read_delimited(spark, str(tmp_path / "*.csv"))
    assert df.columns == ["x", "y"] and sorted(r["x"] for r in df.collect()) == ["1", "3"]


def test_empty_inputs(spark):
    from vellum.operators.diff import LEDGER_SCHEMA
    from vellum.operators.replay import replay
    empty_base = spark.createDataFrame([], "id string, v string")
    t = dt.datetime(2024, 1, 1)
    led = spark.createDataFrame([("a", "t", "d", "INSERT", "9", {}, {"id": "9", "v": "new"}, "u", t, "s", "r")],
                                LEDGER_SCHEMA)
    assert [tuple(r) for r in replay(empty_base, led, "id").collect()] == [("9", "new")]
    assert replay(empty_base, spark.createDataFrame([], LEDGER_SCHEMA), "id").count() == 0
    none = spark.createDataFrame([], "a string, b string")
    assert {r["inferred_type"] for r in profile.infer_types(none).collect()} == {"object"}
    assert [(r["n_distinct"], r["control"]) for r in profile.facet_profile(none).collect()] == [(0, "none")] * 2
    raw = spark.createDataFrame([], "file_key string, upload_date timestamp_ntz, file_size_bytes long")
    st = mf.manifest_stats(mf.derive_manifest(raw), dt.date(2024, 1, 1)).first()
    assert (st["total_files"], st["total_size_mb"], st["total_rows"], st["files_today"]) == (0, 0.0, 0, 0)
    ls = audit.ledger_stats(spark.createDataFrame([], LEDGER_SCHEMA)).first()
    assert (ls["total_changes"], ls["tables_affected"], ls["top_operation"], ls["top_operation_count"]) == (0, 0, None, 0)


def test_profile_file(spark, tmp_path):
    from vellum.sources.delimited import profile_file
    p = tmp_path / "p.csv"
    p.write_text("a\tb\n1\tx\n2\ty\n")
    r = profile_file(spark, str(p)).first()
    assert (r["separator"], r["row_count"], r["column_count"]) == ("\t", 2, 2)
    assert r["column_types"] == {"a": "int64", "b": "object"}


def test_facet_profile_controls(spark):
    df = spark.range(5000).selectExpr("id", "CAST(id % 3 AS STRING) AS small", "CAST(id % 70 AS STRING) AS mid")
    got = {r["column"]: (r["n_distinct"], r["control"], r["pick_values"]) for r in profile.facet_profile(df).collect()}
    assert got == {"id": (5000, "search", None), "small": (3, "pick", "0|1|2"), "mid": (70, "search", None)}


def test_mixed_layouts_in_one_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,ana\n")
    (tmp_path / "b.csv").write_text("name;id\nbob;2\n")
    (tmp_path / "c.csv").write_text("id|name|note\n3|cat|x\n")
    (tmp_path / "d.csv").write_text("")
    got = sorted(tuple(r) for r in read_delimited(spark, str(tmp_path)).select("id", "name", "note").collect())
    assert got == [("1", "ana", None), ("2", "bob", None), ("3", "cat", "x")]


def test_preamble_lines_go_by_position(spark, tmp_path):
    for k, sep in enumerate(",;"):
        (tmp_path / f"{k}.csv").write_text(f"title\nid{sep}t\n{k}{sep}u\nid{sep}t\n\ntitle{sep}\n")
    got = sorted(tuple(r) for r in read_delimited(spark, str(tmp_path), header_row=1).collect())
    assert got == [("0", "u"), ("1", "u"), ("id", "t"), ("id", "t"), ("title", None), ("title", None)]


def test_landed_listing_meets_manifest(spark):
    from vellum.operators import manifest as mf
    from vellum.sources.listing import list_landed
    root = scratch_dir(spark, "land-chain")
    df = spark.createDataFrame([("1", "Ana", "a@b"), ("2", "Bo", "b@c")], "id string, first_name string, email string")
    for subject in ("s", "t"):
        assert land(df, CONTRACT, root, {"subject": subject, "sub_subject": "u", "original_filename": "u.csv"},
                    dt.datetime(2024, 3, 1, 12)).ok
        # the same upload again replaces its own output
        assert land(df, CONTRACT, root, {"subject": subject, "sub_subject": "u", "original_filename": "u.csv"},
                    dt.datetime(2024, 3, 1, 12)).ok
    man = spark.read.parquet(root + "/manifest").drop("upload")
    got = mf.attach_metadata(list_landed(spark, root), man)
    assert got.filter("original_filename = 'u.csv' and file_size_bytes > 0").count() == got.count() == 2
    assert mf.manifest_stats(mf.derive_manifest(man), dt.date(2024, 3, 1)).first()["total_rows"] == 4
    assert mf.history(got, prefix="data/subject=t/").count() == 1
    assert not os.listdir(local_path(root) + "/_staging")


def test_unicode_blanks(spark):
    df = spark.createDataFrame([("\u00a05", "\u00a0\u2003"), ("6\u3000", "x")], "id string, first_name string")
    fields = [{"name": "id", "type": "int", "required": True}, {"name": "first_name", "type": "str", "required": True}]
    got = contract.validation_report(df, {"schema": {"fields": fields}}).collect()
    assert [(r["kind"], r["field"], r["n_blank"]) for r in got] == [("blank", "first_name", 1)]


def test_ledger_files_sorted_by_row_identifier(spark):
    import glob
    import pyarrow.parquet as pq
    from vellum.plans import fixtures as fx
    loc = scratch_dir(spark, "ledger-sorted")
    name = "ledger_sorted_" + loc.rsplit("-", 1)[-1]
    create_ledger(spark, name, loc)
    meta = diff.ChangeMeta("db", "t", "me", dt.datetime(2024, 1, 1), "s1")
    base = fx.derive(spark, "/root/testdata/sf0.01", "base")
    edited = fx.derive(spark, "/root/testdata/sf0.01", "edited")
    assert append_changes(diff.diff_updates(base, edited, "id", meta).repartition(3), name) == 332
    files = glob.glob(local_path(loc) + "/**/*.parquet", recursive=True)
    assert files
    for f in files:
        ids = pq.read_table(f, columns=["row_identifier"]).column(0).to_pylist()
        assert ids == sorted(ids)
