"""DuckDB formulations of the registry queries (the correctness oracle).

These are written independently of the Spark operators -- plain SQL with
windows-free aggregates, FILTER clauses and joins -- over the same derived
inputs (``fixtures.duck``) and with the parameters of the registered queries.
Patterns, words and layouts are stated here, not taken from the operators.  The file listing depends on the file system and has no entry; it gets a
row-count check only.
"""

from __future__ import annotations

from vellum.plans import fixtures as fx
from vellum.plans import registry as R

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


def _with(**ctes: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"


BASE, EDITED, RAW = fx.duck("base"), fx.duck("edited"), fx.duck("raw_customer")
LEDGER = (f"SELECT * FROM ({fx.duck('ledger_flat')}) x WHERE table_name = 'customer' "
          "AND database_name = 'main' AND operation IN ('UPDATE', 'INSERT', 'DELETE') "
          "AND row_identifier IS NOT NULL AND row_identifier <> ''")
LFLAT = fx.duck("ledger_flat")

MANIFEST = f"""
SELECT file_key, string_split(file_key, '/')[-1] AS filename,
  lower(string_split(string_split(file_key, '/')[-1], '.')[-1]) AS extension,
  coalesce(original_filename, 'N/A') AS original_filename, upload_date,
  CAST(file_size_bytes AS BIGINT) AS file_size_bytes,
  round(file_size_bytes / 1048576.0, 2) AS file_size_mb,
  CASE WHEN file_size_bytes < 1024 THEN CAST(file_size_bytes AS VARCHAR) || ' bytes'
       WHEN file_size_bytes < 1048576 THEN printf('%.1f KB', round_even(CAST(file_size_bytes AS DOUBLE) / 1024, 1))
       ELSE printf('%.1f MB', round_even(CAST(file_size_bytes AS DOUBLE) / 1048576, 1)) END AS size_label,
  coalesce(schema_used, 'N/A') AS schema_used,
  CASE WHEN row_count_text IS NULL THEN 0
       WHEN regexp_full_match(row_count_text, '[0-9]+') THEN TRY_CAST(row_count_text AS BIGINT)
       ELSE 0 END AS row_count,
  0 AS column_count,
  strftime(upload_date, '%Y-%m-%dT%H:%M:%S.%f') AS upload_timestamp,
  doc_id
FROM ({fx.duck('manifest_raw')}) r
"""

ODD_STRICT = ["valor_rs", "acao", "col_1st", "a_b", "a_b_1", "a_b_2", "unnamed_column", "preco_rs"]


def _ident(n: str) -> str:
    return '"' + n.replace('"', '""') + '"'


# ------------------------------------------------------------- predicates
# fixed values: what a cell of each type may be
INTEGER = r"^[+-]?\d+(_\d+)*$"
NUMBER = (r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
          r"|^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$")
DATES = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y"]
DATETIMES = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ"]
BOOLEANS = ["true", "false", "1", "0", "yes", "no", "sim", "não"]
# fixed values: what makes a column an integer, a number, a boolean or a date
WHOLE = r"^-?\d+$"
DECIMAL = r"^-?\d*\.?\d+([eE][+-]?\d+)?$"
TRUTHS = ["true", "false", "1", "0", "yes", "no", "sim", "não", "verdadeiro", "falso"]
DAY_HEADS = [r"^\d{4}-\d{2}-\d{2}", r"^\d{2}/\d{2}/\d{4}", r"^\d{2}-\d{2}-\d{4}"]
# fixed values: a part of the type's name and its label
TYPE_LABELS = [("int", "Whole numbers"), ("float", "Decimal numbers"), ("object", "Text"), ("datetime", "Date/Time"), ("bool", "True/False")]


def _words(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _date_ok(x: str, layouts: list[str]) -> str:
    """Digits in the places of a layout, and a day that the calendar has (a one-digit day may follow a space)."""
    tight = f"regexp_replace({x}, '(^|[-/]) ', '\\1', 'g')"
    ors = []
    for layout in layouts:
        shape = layout.replace("%Y", r"\d{4}").replace("%d", r"( [1-9]|\d{1,2})")
        for part in ("%m", "%H", "%M", "%S"):
            shape = shape.replace(part, r"\d{1,2}")
        ors.append(f"(regexp_full_match({x}, '{shape}') AND year(try_strptime({tight}, '{layout}')) > 0)")
    return "(" + " OR ".join(ors) + ")"


def _bad(x: str, kind: str) -> str:
    if kind == "integer":
        ok = f"regexp_matches({_strip(x)}, '{INTEGER}')"
    elif kind == "number":
        ok = f"regexp_matches({_strip(x)}, '{NUMBER}')"
    elif kind == "date":
        ok = _date_ok(x, DATES)
    elif kind == "datetime":
        ok = _date_ok(x, DATETIMES)
    else:
        ok = f"lower({x}) IN ({_words(BOOLEANS)})"
    return f"{x} IS NOT NULL AND {x} <> '' AND NOT coalesce({ok}, false)"


RAW_TYPED = [(0, "id", "integer"), (2, "score", "number"), (3, "joined", "date"), (4, "is_active", "boolean")]
RAW_COLS = ["row_key", "id", "first_name", "score", "joined", "is_active"]


def _violations_sql() -> str:
    parts = [f"SELECT row_key, {o} AS ordinal, '{c}' AS field, '{k}' AS expected, {c} AS value "
             f"FROM r WHERE {_bad(c, k)}" for o, c, k in RAW_TYPED]
    return _with(r=RAW) + " UNION ALL ".join(parts)


def _blank_sql() -> str:
    parts = [f"SELECT {o} AS ordinal, '{c}' AS field, "
             f"count(*) FILTER (WHERE {c} IS NULL OR {_strip(c)} = '') AS n_blank FROM r"
             for o, c in [(0, "id"), (1, "first_name")]]
    return _with(r=RAW) + "SELECT * FROM (" + " UNION ALL ".join(parts) + ") t WHERE n_blank > 0"


def _violations_generic(raw: str, typed: list[tuple[int, str, str]]) -> str:
    parts = [f"SELECT row_key, {o} AS ordinal, '{c}' AS field, '{k}' AS expected, {c} AS value "
             f"FROM r WHERE {_bad(c, k)}" for o, c, k in typed]
    return _with(r=raw) + " UNION ALL ".join(parts)


def _blank_generic(raw: str, required: list[tuple[int, str]]) -> str:
    parts = [f"SELECT {o} AS ordinal, '{c}' AS field, "
             f"count(*) FILTER (WHERE {c} IS NULL OR {_strip(c)} = '') AS n_blank FROM r" for o, c in required]
    return _with(r=raw) + "SELECT * FROM (" + " UNION ALL ".join(parts) + ") t WHERE n_blank > 0"


def _infer_cte(cols: list[str]) -> tuple[str, list[str]]:
    """The one-row aggregate over ``r`` and each column's label from it."""
    aggs, labels = [], []
    for i, c in enumerate(cols):
        v = f"CAST({c} AS VARCHAR)"
        s = _strip(v)
        tests = {"i": f"regexp_matches({s}, '{WHOLE}')", "f": f"regexp_matches(replace({s}, ',', '.'), '{DECIMAL}')",
                 "b": f"lower({s}) IN ({_words(TRUTHS)})", "d": " OR ".join(f"regexp_matches({s}, '{p}')" for p in DAY_HEADS)}
        aggs += [f"count({v}) AS n{i}"] + [f"bool_and({t}) FILTER (WHERE {v} IS NOT NULL) AS {k}{i}" for k, t in tests.items()]
        labels.append(f"CASE WHEN n{i} = 0 THEN 'object' WHEN i{i} THEN 'int64' WHEN f{i} THEN 'float64' "
                      f"WHEN b{i} THEN 'bool' WHEN d{i} THEN 'datetime64' ELSE 'object' END")
    return "SELECT count(*) AS n_rows, " + ", ".join(aggs) + " FROM r", labels


def _infer_generic(raw: str, cols: list[str]) -> str:
    agg, labels = _infer_cte(cols)
    rows = " UNION ALL ".join(f"SELECT {i} AS ordinal, '{c}' AS \"column\", {lab} AS inferred_type FROM a"
                              for i, (c, lab) in enumerate(zip(cols, labels)))
    return _with(r=raw, a=agg) + rows


def _profile_generic(raw: str, cols: list[str]) -> str:
    agg, labels = _infer_cte(cols)
    obj = ", ".join(f"'{c}', {lab}" for c, lab in zip(cols, labels))
    return (_with(r=raw, a=agg) + f"SELECT 'csv' AS format, {len(cols)} AS column_count, n_rows AS row_count, "
            f"CAST(json_object({obj}) AS VARCHAR) AS column_types_json, ',' AS separator FROM a")


RAW_LI = fx.duck("raw_lineitem")
LI_TYPED = [(1, "quantity", "number"), (2, "part", "integer"), (3, "shipped", "date"), (4, "discounted", "boolean")]
LI_REQUIRED = [(0, "row_key"), (1, "quantity"), (2, "part"), (5, "status")]
LI_COLS = ["row_key", "quantity", "part", "shipped", "discounted", "status"]


def _type_labels_sql() -> str:
    case = "CASE " + " ".join(f"WHEN contains(lower(inferred_type), '{f}') THEN '{lab}'" for f, lab in TYPE_LABELS) \
        + " ELSE inferred_type END"
    return f"SELECT *, {case} AS label FROM ({_infer_generic(RAW, RAW_COLS)}) t"


CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _facet_sql() -> str:
    v = " UNION ALL ".join(f"SELECT {i} AS ordinal, '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM customer"
                           for i, c in enumerate(CUST_COLS))
    return (_with(v=v, d="SELECT DISTINCT ordinal, col, value FROM v WHERE value IS NOT NULL AND value <> '' "
                         "AND value <> 'None'",
                  c="SELECT ordinal, col, count(*) AS n_distinct, string_agg(value, '|' ORDER BY value) AS pv "
                    "FROM d GROUP BY ordinal, col")
            + "SELECT ordinal, col AS \"column\", n_distinct, CASE WHEN n_distinct <= 1 THEN 'none' "
              "WHEN n_distinct <= 50 THEN 'pick' ELSE 'search' END AS control, "
              "CASE WHEN n_distinct > 1 AND n_distinct <= 50 THEN pv END AS pick_values FROM c")


FACET_PRED = ("coalesce(c_mktsegment, 'None') IN ('BUILDING', 'MACHINERY') "
              "AND contains(lower(coalesce(c_name, 'None')), '00001')")


def _changes_sql(key_expr: str = "e.id") -> str:
    cols = []
    for f in R.BASE_FIELDS:
        cols += [f"b.{f} AS before_{f}", f"e.{f} AS after_{f}"]
    differs = " OR ".join(f"coalesce(b.{f}, '') <> coalesce(e.{f}, '')" for f in R.BASE_FIELDS)
    iso = R.META.iso_time
    return (_with(b=BASE, e=EDITED)
            + f"SELECT md5(concat_ws('_', 'main', 'customer', {key_expr}, '{iso}')) AS id, "
              "'customer' AS table_name, 'main' AS database_name, 'UPDATE' AS operation, "
              f"{key_expr} AS row_identifier, " + ", ".join(cols)
            + f", 'editor' AS updated_by, TIMESTAMP '{R.META.changed_at:%Y-%m-%d %H:%M:%S}' AS updated_at, "
              "'sess0001' AS session_id, 'manual edit' AS change_reason "
              f"FROM b JOIN e ON b.id = e.id WHERE {differs}")


def _replay_sql(latest: bool) -> str:
    later, earlier = ("max", "min") if latest else ("min", "max")
    arg_later, arg_earlier = ("arg_max", "arg_min") if latest else ("arg_min", "arg_max")
    after = ">" if latest else "<"
    upd = "operation = 'UPDATE' AND {c} IS NOT NULL AND {c} <> ''"
    return (_with(
        b=BASE, l=LEDGER,
        k=f"SELECT row_identifier AS k, {later}(updated_at) FILTER (WHERE operation = 'DELETE') AS ld "
          "FROM l GROUP BY row_identifier",
        fi=f"SELECT l.row_identifier AS k, {earlier}(l.updated_at) AS fi_ts, "
           f"{arg_earlier}(l.after_segment, l.updated_at) AS fi_seg, {arg_earlier}(l.after_name, l.updated_at) AS fi_nm "
           f"FROM l JOIN k ON l.row_identifier = k.k WHERE l.operation = 'INSERT' "
           f"AND (k.ld IS NULL OR l.updated_at {after} k.ld) GROUP BY l.row_identifier",
        u="SELECT row_identifier AS k, "
          f"{arg_later}(after_segment, updated_at) FILTER (WHERE {upd.format(c='after_segment')}) AS u_seg, "
          f"{later}(updated_at) FILTER (WHERE {upd.format(c='after_segment')}) AS u_seg_ts, "
          f"{arg_later}(after_name, updated_at) FILTER (WHERE {upd.format(c='after_name')}) AS u_nm, "
          f"{later}(updated_at) FILTER (WHERE {upd.format(c='after_name')}) AS u_nm_ts "
          "FROM l GROUP BY row_identifier",
        j="SELECT b.id AS bid, b.name AS bname, b.segment AS bseg, b.nation AS bnation, k.k AS lk, k.ld, "
          "fi.fi_ts, fi.fi_seg, fi.fi_nm, u.u_seg, u.u_seg_ts, u.u_nm, u.u_nm_ts "
          "FROM b FULL OUTER JOIN k ON b.id = k.k LEFT JOIN fi ON fi.k = k.k LEFT JOIN u ON u.k = k.k",
        s="SELECT *, (bid IS NOT NULL AND ld IS NULL) AS alive FROM j")
        + "SELECT CASE WHEN alive THEN bid ELSE lk END AS id, "
          f"CASE WHEN alive THEN coalesce(u_nm, bname) WHEN u_nm_ts {after} fi_ts THEN u_nm ELSE fi_nm END AS name, "
          f"CASE WHEN alive THEN coalesce(u_seg, bseg) WHEN u_seg_ts {after} fi_ts THEN u_seg ELSE fi_seg END AS segment, "
          "CASE WHEN alive THEN bnation ELSE NULL END AS nation "
          "FROM s WHERE alive OR fi_ts IS NOT NULL")


def _replay_ordered_sql(base: str, ledger: str, key: str, images: dict[str, str], others: list[str],
                        latest: bool) -> str:
    """Replay oracle with the full record order (time, then record id), for
    ledgers whose times repeat within a key."""
    later, earlier = ("max", "min") if latest else ("min", "max")
    arg_later, arg_earlier = ("arg_max", "arg_min") if latest else ("arg_min", "arg_max")
    after = ">" if latest else "<"
    o, lo = "{'t': updated_at, 'i': id}", "{'t': l.updated_at, 'i': l.id}"
    upd = "operation = 'UPDATE' AND {c} IS NOT NULL AND {c} <> ''"
    fi_cols = ", ".join(f"{arg_earlier}(l.{src}, {lo}) AS fi_{c}" for c, src in images.items())
    u_cols = ", ".join(f"{arg_later}({src}, {o}) FILTER (WHERE {upd.format(c=src)}) AS u_{c}, "
                       f"{later}({o}) FILTER (WHERE {upd.format(c=src)}) AS uo_{c}" for c, src in images.items())
    j_cols = ", ".join([f"b.{c} AS b_{c}" for c in [key] + list(images) + others]
                       + [f"fi.fi_{c}" for c in images] + [f"u.u_{c}, u.uo_{c}" for c in images])
    sel = [f"CASE WHEN alive THEN b_{key} ELSE lk END AS {key}"]
    for c in images:
        sel.append(f"CASE WHEN alive THEN coalesce(u_{c}, b_{c}) WHEN uo_{c} {after} fi_o THEN u_{c} "
                   f"ELSE fi_{c} END AS {c}")
    for c in others:
        sel.append(f"CASE WHEN alive THEN b_{c} ELSE NULL END AS {c}")
    return (_with(
        b=base, l=ledger,
        k=f"SELECT row_identifier AS k, {later}({o}) FILTER (WHERE operation = 'DELETE') AS ld "
          "FROM l GROUP BY row_identifier",
        fi=f"SELECT l.row_identifier AS k, {earlier}({lo}) AS fi_o, {fi_cols} "
           f"FROM l JOIN k ON l.row_identifier = k.k WHERE l.operation = 'INSERT' "
           f"AND (k.ld IS NULL OR {lo} {after} k.ld) GROUP BY l.row_identifier",
        u=f"SELECT row_identifier AS k, {u_cols} FROM l GROUP BY row_identifier",
        j=f"SELECT k.k AS lk, k.ld, fi.fi_o, {j_cols} "
          f"FROM b FULL OUTER JOIN k ON b.{key} = k.k LEFT JOIN fi ON fi.k = k.k LEFT JOIN u ON u.k = k.k",
        s=f"SELECT *, (b_{key} IS NOT NULL AND ld IS NULL) AS alive FROM j")
        + "SELECT " + ", ".join(sel) + " FROM s WHERE alive OR fi_o IS NOT NULL")


ORDER_IMAGES = {"status": "after_status", "priority": "after_priority"}
LEDGER_ORDERS = (f"SELECT * FROM ({fx.duck('ledger_orders_flat')}) x WHERE table_name = 'orders' "
                 "AND database_name = 'main' AND operation IN ('UPDATE', 'INSERT', 'DELETE') "
                 "AND row_identifier IS NOT NULL AND row_identifier <> ''")


def _overlay_orders_sql() -> str:
    o = "{'t': updated_at, 'i': id}"
    upd = "operation = 'UPDATE' AND {c} IS NOT NULL AND {c} <> ''"
    return (_with(b=fx.duck("base_orders"), l=LEDGER_ORDERS,
                  u="SELECT row_identifier AS k, " + ", ".join(
                      f"arg_max({src}, {o}) FILTER (WHERE {upd.format(c=src)}) AS u_{c}"
                      for c, src in ORDER_IMAGES.items()) + " FROM l GROUP BY row_identifier")
            + "SELECT b.id, coalesce(u.u_status, b.status) AS status, coalesce(u.u_priority, b.priority) AS priority, "
              "b.customer FROM b LEFT JOIN u ON b.id = u.k")


def _changes_generic(base: str, edited: str, fields: list[str], meta, key: str = "id") -> str:
    cols = []
    for f in fields:
        cols += [f"b.{f} AS before_{f}", f"e.{f} AS after_{f}"]
    differs = " OR ".join(f"coalesce(b.{f}, '') <> coalesce(e.{f}, '')" for f in fields)
    return (_with(b=base, e=edited)
            + f"SELECT md5(concat_ws('_', '{meta.database}', '{meta.table}', e.{key}, '{meta.iso_time}')) AS id, "
              f"'{meta.table}' AS table_name, '{meta.database}' AS database_name, 'UPDATE' AS operation, "
              f"e.{key} AS row_identifier, " + ", ".join(cols)
            + f", '{meta.user}' AS updated_by, TIMESTAMP '{meta.changed_at:%Y-%m-%d %H:%M:%S}' AS updated_at, "
              f"'{meta.session_id}' AS session_id, '{meta.reason}' AS change_reason "
              f"FROM b JOIN e ON b.{key} = e.{key} WHERE {differs}")


def _overlay_sql() -> str:
    upd = "operation = 'UPDATE' AND {c} IS NOT NULL AND {c} <> ''"
    return (_with(b=BASE, l=LEDGER,
                  u="SELECT row_identifier AS k, "
                    f"arg_max(after_segment, updated_at) FILTER (WHERE {upd.format(c='after_segment')}) AS seg, "
                    f"arg_max(after_name, updated_at) FILTER (WHERE {upd.format(c='after_name')}) AS nm "
                    "FROM l GROUP BY row_identifier")
            + "SELECT b.id, coalesce(u.nm, b.name) AS name, coalesce(u.seg, b.segment) AS segment, b.nation "
              "FROM b LEFT JOIN u ON b.id = u.k")


def _m(sql: str) -> str:
    return _with(m=MANIFEST) + sql


def _esc(x: str) -> str:
    return f"replace(replace(coalesce({x}, ''), ',', '\\,'), '|', '\\|')"


ORACLE: dict[str, str] = {
    "detect_separator": (
        "WITH c AS (SELECT doc_id, length(text) - length(replace(text, ',', '')) AS n1, "
        "length(text) - length(replace(text, ';', '')) AS n2, length(text) - length(replace(text, chr(9), '')) AS n3, "
        "length(text) - length(replace(text, '|', '')) AS n4 FROM documents) "
        "SELECT doc_id, CASE WHEN greatest(n1, n2, n3, n4) = 0 THEN ',' WHEN n1 = greatest(n1, n2, n3, n4) THEN ',' "
        "WHEN n2 = greatest(n1, n2, n3, n4) THEN ';' WHEN n3 = greatest(n1, n2, n3, n4) THEN chr(9) ELSE '|' END "
        "AS separator FROM c"),
    "read_delimited_auto": (
        "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
        "CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer"),
    "read_delimited_text": ("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars "
                            "FROM documents"),
    "csv_empty_text": fx.duck("empty_text"),
    "detect_separator_head": (
        "WITH b AS (SELECT doc_id, regexp_extract_all(substr(hex(encode(text)), 1, 2048), '..') AS h FROM documents), "
        "c AS (SELECT doc_id, len(list_filter(h, lambda x: x = '2C')) AS n1, len(list_filter(h, lambda x: x = '3B')) AS n2, "
        "len(list_filter(h, lambda x: x = '09')) AS n3, len(list_filter(h, lambda x: x = '7C')) AS n4 FROM b) "
        "SELECT doc_id, CASE WHEN greatest(n1, n2, n3, n4) = 0 THEN ',' WHEN n1 = greatest(n1, n2, n3, n4) THEN ',' "
        "WHEN n2 = greatest(n1, n2, n3, n4) THEN ';' WHEN n3 = greatest(n1, n2, n3, n4) THEN chr(9) ELSE '|' END AS separator FROM c"),
    "profile_mixed_files": ("SELECT format, column_count, 2 * row_count AS row_count, column_types_json, ', ;' AS separator FROM ("
                            + _profile_generic("SELECT * FROM customer", CUST_COLS) + ") t"),
    "cell_violations_rows": _with(r=f"SELECT *, row_number() OVER (ORDER BY row_key) AS row FROM ({RAW}) x") + " UNION ALL ".join(
        f"SELECT row, {o} AS ordinal, '{c}' AS field, '{k}' AS expected, {c} AS value FROM r WHERE {_bad(c, k)}" for o, c, k in RAW_TYPED),
    "cell_violations_events": _violations_generic(fx.duck("raw_events"), [(1, "happened", "datetime"), (2, "user_id", "integer")]),
    "landed_chain": "SELECT CAST(9 AS BIGINT) AS total_files, 2 * count(*) AS total_rows FROM customer",
    "facet_controls": f"SELECT ordinal, \"column\", pick_values, control FROM ({_facet_sql()}) t",
    "ledger_append_twice": (
        f"SELECT 'save-1' AS batch, 'customer' AS table_name, count(*) AS n, count(DISTINCT row_identifier) AS n_rows FROM ({_changes_sql()}) c "
        "UNION ALL SELECT 'save-2', 'orders', count(*), count(DISTINCT o_orderkey) FROM orders "
        "WHERE (o_orderkey % 13 = 0 AND coalesce(o_orderstatus, '') <> 'X') OR (o_orderkey % 17 = 0 AND coalesce(o_orderpriority, '') <> '9-EDITED')"),
    "ledger_reset_append": _changes_sql(),
    "diff_guessed_key": _changes_sql(),
    "external_table_parquet": "SELECT * FROM customer",
    "legacy_sorted_unpack": _with(l=LFLAT) + "SELECT id, after_segment AS u_segment, after_name AS u_name FROM l",
    "read_delimited_preamble": (
        "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
        "CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer UNION ALL "
        "SELECT 'c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment' "
        "FROM (SELECT DISTINCT c_custkey % 4 FROM customer) p"),
    "preview": "SELECT * FROM customer ORDER BY c_custkey LIMIT 10",
    "rename_strict": "SELECT " + ", ".join(f"{s} AS {_ident(n)}" for s, n in zip(R.ODD_SOURCES, ODD_STRICT))
                     + " FROM customer",
    "rename_simple": ("SELECT c_custkey AS valor_r, c_name AS \"ação\", c_nationkey AS \"1st\", c_name AS a_b, "
                      "c_mktsegment AS ab, c_custkey AS \"___\", c_acctbal AS \"preçor\" FROM customer"),
    "infer_types": _infer_generic(RAW, RAW_COLS),
    "profile": _profile_generic(RAW, RAW_COLS),
    "profile_file": _profile_generic("SELECT * FROM customer", CUST_COLS),
    "type_labels": _type_labels_sql(),
    "facet_profile": _facet_sql(),
    "facet_filter": f"SELECT * FROM customer WHERE {FACET_PRED}",
    "filter_counts": (f"SELECT count(*) AS total_rows, count(*) FILTER (WHERE {FACET_PRED}) AS filtered_rows, "
                      f"{len(CUST_COLS)} AS column_count FROM customer"),
    "stringify": ("SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in CUST_COLS)
                  + " FROM customer"),
    "blank_counts": _blank_sql(),
    "cell_violations": _violations_sql(),
    "cell_violations_lineitem": _violations_generic(RAW_LI, LI_TYPED),
    "validation_report_lineitem": (
        f"SELECT 1 AS section, ordinal, 'blank' AS kind, field, CAST(NULL AS VARCHAR) AS row_key, "
        f"CAST(NULL AS VARCHAR) AS value, n_blank FROM ({_blank_generic(RAW_LI, LI_REQUIRED)}) bl "
        f"UNION ALL SELECT 2, ordinal, 'type', field, row_key, value, NULL FROM ({_violations_generic(RAW_LI, LI_TYPED)}) vi"),
    "infer_types_lineitem": _infer_generic(RAW_LI, LI_COLS),
    "validation_report": (
        "SELECT 1 AS section, 5 AS ordinal, 'missing' AS kind, 'email' AS field, CAST(NULL AS VARCHAR) AS row_key, "
        "CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS n_blank "
        f"UNION ALL SELECT 1, ordinal, 'blank', field, NULL, NULL, n_blank FROM ({_blank_sql()}) bl "
        f"UNION ALL SELECT 2, ordinal, 'type', field, CAST(row_key AS VARCHAR), value, NULL "
        f"FROM ({_violations_sql()}) vi"),
    "land_keys": _m(
        "SELECT file_key, 'sistema/' || split_part(file_key, '/', 2) || '/' || split_part(file_key, '/', 3) || '/' "
        "|| strftime(upload_date, '%Y-%m-%d') || '/' || regexp_replace(filename, '\\.[^.]*$', '') || '_' "
        "|| strftime(upload_date, '%Y%m%d_%H%M%S') || '.csv' AS landing_key FROM m"),
    "file_filters": _m(
        "SELECT file_key, filename, file_size_bytes FROM m WHERE lower(string_split(filename, '.')[-1]) "
        f"IN ('csv', 'xlsx', 'xls') AND file_size_bytes <= {R.MAX_MB * 1024 * 1024}"),
    "land_gated": ("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment, "
                   "CAST(c_nationkey AS VARCHAR) AS nation FROM customer"),
    "stream_landing": ("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment, "
                       "CAST(c_nationkey AS VARCHAR) AS nation FROM customer"),
    "manifest_derive": _m(
        "SELECT file_key, filename, extension, original_filename, upload_date, file_size_bytes, file_size_mb, "
        "size_label, schema_used, row_count, column_count, upload_timestamp FROM m"),
    "manifest_history": _m(
        "SELECT filename, original_filename, upload_date, file_size_mb, schema_used, row_count, column_count, "
        "file_key FROM m ORDER BY upload_date DESC, file_key LIMIT 50"),
    "history_view": _m(
        "SELECT coalesce(filename, 'N/A') AS file, upload_date AS uploaded_at, coalesce(file_size_mb, 0.0) AS size_mb, "
        "coalesce(schema_used, 'N/A') AS \"schema\", coalesce(row_count, 0) AS \"rows\", "
        "coalesce(column_count, 0) AS \"columns\" FROM m"),
    "manifest_stats": _m(
        "SELECT count(*) AS total_files, "
        "CAST(coalesce(round(sum(CAST(file_size_mb AS DECIMAL(18,2))), 2), 0) AS DOUBLE) AS total_size_mb, "
        "CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_rows, "
        "CAST(coalesce(round(avg(CAST(file_size_mb AS DECIMAL(18,2))), 2), 0) AS DOUBLE) AS avg_file_size_mb, "
        f"count(*) FILTER (WHERE CAST(upload_date AS DATE) = DATE '{R.AS_OF}') AS files_today FROM m"),
    "top_schemas": _m(
        "SELECT schema_used, count(*) AS count FROM m WHERE schema_used <> 'N/A' GROUP BY schema_used "
        "ORDER BY count DESC, schema_used LIMIT 5"),
    "landings_by_day": _m(
        "SELECT CAST(upload_date AS DATE) AS upload_day, count(*) AS files_count, "
        "CAST(round(sum(CAST(file_size_mb AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_size_mb FROM m "
        f"WHERE upload_date >= CAST(DATE '{R.AS_OF}' - INTERVAL {R.RECENT_DAYS} DAY AS TIMESTAMP) "
        "GROUP BY 1 ORDER BY 1 DESC"),
    "manifest_search": _m(
        "SELECT filename, original_filename, upload_date, file_size_mb, schema_used, file_key FROM m "
        f"WHERE filename ILIKE '%{R.SEARCH_TERM}%' OR original_filename ILIKE '%{R.SEARCH_TERM}%' "
        f"OR schema_used ILIKE '%{R.SEARCH_TERM}%' ORDER BY upload_date DESC, file_key LIMIT 20"),
    "schema_category": _m(
        "SELECT file_key, schema_used, CASE WHEN contains(lower(schema_used), 'vendas') THEN 'sales' "
        "WHEN contains(lower(schema_used), 'financeiro') THEN 'finance' "
        "WHEN contains(lower(schema_used), 'rh') OR contains(lower(schema_used), 'funcionario') THEN 'people' "
        "WHEN contains(lower(schema_used), 'sistema') OR contains(lower(schema_used), 'user') THEN 'system' "
        "ELSE 'other' END AS category FROM m"),
    "metadata_map": _m(
        "SELECT file_key, CAST(json_object('original_filename', original_filename, 'upload_timestamp', "
        "upload_timestamp, 'schema_used', schema_used, 'subject', split_part(file_key, '/', 2), 'sub_subject', "
        "split_part(file_key, '/', 3), 'row_count', CAST(row_count AS VARCHAR), 'column_count', "
        "CAST(column_count AS VARCHAR), 'file_size_bytes', CAST(file_size_bytes AS VARCHAR), 'original_format', "
        "extension, 'processed_by', 'vellum') AS VARCHAR) AS metadata_json FROM m"),
    "manifest_attach": _m(
        "SELECT file_key, filename, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN original_filename "
        "ELSE 'N/A' END AS original_filename, file_size_mb, CASE WHEN doc_id IN (SELECT doc_id FROM labels) "
        "THEN schema_used ELSE 'N/A' END AS schema_used, CASE WHEN doc_id IN (SELECT doc_id FROM labels) "
        "THEN row_count ELSE 0 END AS row_count FROM m"),
    "diff_updates": _changes_sql(),
    "diff_positional": _changes_sql(),
    "ledger_write_read": _changes_sql(),
    # after a reset the ledger holds nothing: the diff's columns, no rows
    "ledger_reset": "SELECT * FROM (" + _changes_sql() + ") t WHERE false",
    "any_change": (
        _with(b=BASE, e=EDITED)
        + "SELECT n_before, n_after, n_differing, (n_before <> n_after OR n_differing > 0) AS changed FROM ("
          "SELECT count(b.id) AS n_before, count(e.id) AS n_after, count(*) FILTER (WHERE b.id IS NULL OR e.id IS NULL OR "
        + " OR ".join(f"coalesce(b.{f}, '') <> coalesce(e.{f}, '')" for f in R.BASE_FIELDS)
        + ") AS n_differing FROM b FULL OUTER JOIN e ON b.id = e.id) t"),
    "any_change_multiset": (
        _with(b=BASE, e=EDITED,
              x="SELECT count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM e) t1",
              y="SELECT count(*) AS n FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM b) t2")
        + "SELECT (SELECT count(*) FROM b) AS n_before, (SELECT count(*) FROM e) AS n_after, "
          "(SELECT n FROM x) + (SELECT n FROM y) AS n_differing, "
          "((SELECT count(*) FROM b) <> (SELECT count(*) FROM e) OR (SELECT n FROM x) + (SELECT n FROM y) > 0) "
          "AS changed"),
    "widen_types": ("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, "
                    "CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer"),
    "external_table": "SELECT * FROM customer",
    "overlay_updates": _overlay_sql(),
    "replay_latest": _replay_sql(True),
    "replay_orders": _replay_ordered_sql(fx.duck("base_orders"), LEDGER_ORDERS, "id", ORDER_IMAGES,
                                         ["customer"], True),
    "replay_orders_as_written": _replay_ordered_sql(fx.duck("base_orders"), LEDGER_ORDERS, "id", ORDER_IMAGES,
                                                    ["customer"], False),
    "overlay_orders": _overlay_orders_sql(),
    "diff_orders": _changes_generic(fx.duck("base_orders"), fx.duck("edited_orders"), R.ORDER_FIELDS,
                                    R.META_ORDERS),
    "replay_as_written": _replay_sql(False),
    "current_view": _replay_sql(True),
    "current_view_fallback": _with(b=BASE) + "SELECT * FROM b",
    "replay_refused": _with(b=BASE) + "SELECT * FROM b",
    "change_fields": (
        _with(l=LFLAT) + "SELECT id, table_name, operation, row_identifier, before_segment AS segment_before, "
        "after_segment AS segment_after, CAST(NULL AS VARCHAR) AS name_before, after_name AS name_after, "
        "updated_by, updated_at FROM l WHERE table_name = 'customer'"),
    "change_view": (
        _with(l=LFLAT) + "SELECT id AS change_id, row_identifier AS row_id, operation, before_segment AS segment_before, "
        "after_segment AS segment_after, CAST(NULL AS VARCHAR) AS name_before, after_name AS name_after, "
        "updated_by, updated_at, session_id, change_reason FROM l WHERE table_name = 'customer'"),
    "field_changed": (
        _with(l=LFLAT) + "SELECT row_identifier, before_segment AS segment_before, after_segment AS segment_after, "
        "updated_at, updated_by FROM l WHERE table_name = 'customer' AND before_segment <> after_segment"),
    "row_history": (
        _with(l=LFLAT) + "SELECT operation, before_segment AS segment_before, after_segment AS segment_after, "
        "CAST(NULL AS VARCHAR) AS name_before, after_name AS name_after, updated_at, change_reason FROM l "
        f"WHERE table_name = 'customer' AND row_identifier = '{R.HISTORY_ROW}'"),
    "changes_by_day": (
        _with(l=LFLAT) + "SELECT CAST(updated_at AS DATE) AS change_date, count(*) AS total_changes, "
        "count(DISTINCT row_identifier) AS rows_affected, count(DISTINCT updated_by) AS editors FROM l "
        f"WHERE table_name = 'customer' AND CAST(updated_at AS DATE) >= DATE '{R.SINCE}' GROUP BY 1 ORDER BY 1 DESC"),
    **{name: _with(l=LFLAT) + "SELECT id, table_name, operation, row_identifier, updated_by, updated_at, session_id, "
       "change_reason FROM l WHERE table_name LIKE '%cust%' AND operation = 'UPDATE' "
       f"ORDER BY updated_at DESC, id DESC LIMIT {limit}"
       for name, limit in (("ledger_filter", 100), ("ledger_filter_few", 5), ("ledger_filter_many", 5000))},
    "changes_by_day_orders": (
        _with(l=fx.duck("ledger_orders_flat")) + "SELECT CAST(updated_at AS DATE) AS change_date, "
        "count(*) AS total_changes, count(DISTINCT row_identifier) AS rows_affected, "
        "count(DISTINCT updated_by) AS editors FROM l WHERE table_name = 'orders' "
        "AND CAST(updated_at AS DATE) >= DATE '1995-01-01' GROUP BY 1 ORDER BY 1 DESC"),
    "ledger_stats_orders": (
        _with(l=fx.duck("ledger_orders_flat"),
              p="SELECT operation, count(*) AS n, max({'t': updated_at, 'i': id}) AS newest FROM l GROUP BY operation")
        + "SELECT (SELECT count(*) FROM l) AS total_changes, (SELECT count(DISTINCT table_name) FROM l) "
          "AS tables_affected, (SELECT operation FROM p ORDER BY n DESC, newest DESC LIMIT 1) AS top_operation, "
          "(SELECT n FROM p ORDER BY n DESC, newest DESC LIMIT 1) AS top_operation_count"),
    "ledger_stats": (
        _with(l=LFLAT, p="SELECT operation, count(*) AS n, max(updated_at) AS newest FROM l GROUP BY operation")
        + "SELECT (SELECT count(*) FROM l) AS total_changes, (SELECT count(DISTINCT table_name) FROM l) "
          "AS tables_affected, (SELECT operation FROM p ORDER BY n DESC, newest DESC LIMIT 1) AS top_operation, "
          "(SELECT n FROM p ORDER BY n DESC, newest DESC LIMIT 1) AS top_operation_count"),
    "legacy_pack_unpack": (
        _with(l=LFLAT) + "SELECT id, concat_ws(',', '', " + _esc("after_name") + ", " + _esc("after_segment")
        + ", '') AS packed, '' AS u_id, coalesce(after_name, '') AS u_name, coalesce(after_segment, '') AS u_segment, "
          "'' AS u_nation FROM l"),
    "legacy_brace_unpack": (
        _with(l=LFLAT) + "SELECT id, after_segment AS u_segment, after_name AS u_name, '' AS u_email, "
        "10 AS n_fields FROM l"),
    "legacy_import": (
        _with(l=LFLAT) + "SELECT id, operation, row_identifier, "
        "CASE WHEN after_segment = '' AND after_name = '' THEN NULL ELSE after_segment END AS after_segment, "
        "CASE WHEN after_segment = '' AND after_name = '' THEN NULL ELSE after_name END AS after_name, "
        "before_segment, updated_at FROM l"),
    "json_clean": (
        "SELECT event_id, CASE WHEN props IS NULL OR props IN ('', '{}') THEN '{}' "
        "WHEN json_valid(replace(props, '\"\"\"\"', '\"')) THEN CAST(json(replace(props, '\"\"\"\"', '\"')) AS VARCHAR) "
        "ELSE '{}' END AS props_clean FROM events"),
}
