"""Derived test inputs over the driver tables.

Each derivation is one SQL text that runs unchanged in Spark and DuckDB.
Table references are written ``{name}``: Spark binds them to DataFrames via
``spark.sql(text, name=df)``; the DuckDB oracle formats them to view names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

RAW_CUSTOMER = """
SELECT c_custkey AS row_key,
  CASE WHEN c_custkey % 50 = 3 THEN 'x' || CAST(c_custkey AS STRING)
       WHEN c_custkey % 50 = 4 THEN '' ELSE CAST(c_custkey AS STRING) END AS id,
  CASE WHEN c_custkey % 40 = 1 THEN '  ' ELSE c_name END AS first_name,
  CASE WHEN c_custkey % 30 = 2 THEN 'abc'
       WHEN c_custkey % 30 = 5 THEN ' 1e3 ' ELSE CAST(CAST(c_nationkey AS INT) AS STRING) || '.5' END AS score,
  CASE WHEN c_custkey % 20 = 6 THEN '2024-02-30'
       WHEN c_custkey % 20 = 7 THEN '31/12/2024' ELSE '2024-1-5' END AS joined,
  CASE c_custkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'NO' WHEN 2 THEN 'sim'
       WHEN 3 THEN 'true ' WHEN 4 THEN NULL ELSE '1' END AS is_active
FROM {customer}
"""

# contract for raw_customer: email is required and absent
RAW_CONTRACT = {
    "subject": "sistema", "sub_subject": "clientes", "description": "clientes teste",
    "schema": {"table_name": "customers", "fields": [
        {"name": "id", "type": "int", "required": True},
        {"name": "first_name", "type": "str", "required": True},
        {"name": "score", "type": "float", "required": False},
        {"name": "joined", "type": "date", "required": False},
        {"name": "is_active", "type": "bool", "required": False},
        {"name": "email", "type": "str", "required": True},
    ]},
}

BASE = """
SELECT CAST(c_custkey AS STRING) AS id, c_name AS name,
       c_mktsegment AS segment, CAST(c_nationkey AS STRING) AS nation
FROM {customer}
"""

EDITED = """
SELECT CAST(c_custkey AS STRING) AS id,
       CASE WHEN c_custkey % 11 = 0 THEN c_name || '*' ELSE c_name END AS name,
       CASE WHEN c_custkey % 7 = 0 THEN 'EDITED' ELSE c_mktsegment END AS segment,
       CAST(c_nationkey AS STRING) AS nation
FROM {customer}
"""

# Ledger over base: every operation, blank fields, and keys absent from base
# (user ids are spread by 20, so about half of them fall past the last
# customer key at every scale factor).
LEDGER_FLAT = """
SELECT md5(CAST(event_id AS STRING)) AS id, 'customer' AS table_name, 'main' AS database_name,
  CASE event_type WHEN 'purchase' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation,
  CAST(user_id * 20 AS STRING) AS row_identifier,
  'old' || CAST(event_id % 3 AS STRING) AS before_segment,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'old' || CAST(event_id % 4 AS STRING) END AS after_segment,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE 'n' || CAST(event_id % 9 AS STRING) END AS after_name,
  'user' || CAST(event_id % 6 AS STRING) AS updated_by, ts AS updated_at,
  substring(md5(CAST(event_id % 100 AS STRING)), 1, 8) AS session_id, 'fixture' AS change_reason
FROM {events}
"""

MANIFEST = """
SELECT 'sistema/' || d.source || '/' || d.lang || '/' || CAST(d.doc_id AS STRING) ||
    CASE d.doc_id % 8 WHEN 0 THEN '.XLSX' WHEN 1 THEN '.txt' ELSE '.csv' END AS file_key,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE 'Orig_' || CAST(d.doc_id AS STRING) || '.CSV' END AS original_filename,
  e.ts AS upload_date, d.n_chars * 1000 AS file_size_bytes,
  CASE WHEN d.doc_id % 10 = 0 THEN NULL WHEN d.doc_id % 10 < 4 THEN 'vendas ' || d.source ELSE d.source END AS schema_used,
  CASE WHEN d.doc_id % 9 = 0 THEN 'n/a' ELSE CAST(d.doc_id % 500 AS STRING) END AS row_count_text,
  d.doc_id AS doc_id
FROM {documents} d LEFT JOIN {events} e ON e.event_id = d.doc_id * 5
"""

# Larger pair: orders snapshots, and a ledger with one record per lineitem.
# Order keys are doubled, so about half the ledger keys are absent from the
# base; lines 6 and 7 insert and delete, the rest update.  The record id
# hashes every column that shapes a record, so two records with one id are
# the same record.
BASE_ORDERS = """
SELECT CAST(o_orderkey AS STRING) AS id, o_orderstatus AS status, o_orderpriority AS priority,
       CAST(o_custkey AS STRING) AS customer
FROM {orders}
"""

EDITED_ORDERS = """
SELECT CAST(o_orderkey AS STRING) AS id,
       CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 17 = 0 THEN '9-EDITED' ELSE o_orderpriority END AS priority,
       CAST(o_custkey AS STRING) AS customer
FROM {orders}
"""

LEDGER_ORDERS_FLAT = """
SELECT md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
         CAST(l_suppkey AS STRING), l_linestatus, l_returnflag,
         CAST(CAST(round(l_discount * 100) AS BIGINT) AS STRING), CAST(l_shipdate AS STRING))) AS id,
  'orders' AS table_name, 'main' AS database_name,
  CASE WHEN l_linenumber = 7 THEN 'DELETE' WHEN l_linenumber = 6 THEN 'INSERT' ELSE 'UPDATE' END AS operation,
  CAST(l_orderkey * 2 AS STRING) AS row_identifier,
  l_linestatus AS after_status,
  CASE WHEN round(l_discount * 100) > 5 THEN '' ELSE l_returnflag || '-' || CAST(l_linenumber AS STRING) END
    AS after_priority,
  'clerk' || CAST(l_suppkey % 7 AS STRING) AS updated_by, l_shipdate AS updated_at,
  'batch' AS session_id, 'fixture' AS change_reason
FROM {lineitem}
"""

# Larger text table with faults, for validation and inference at scale.
RAW_LINEITEM = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS row_key,
  CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(l_quantity AS STRING) END AS quantity,
  CASE WHEN l_suppkey % 97 = 0 THEN '' WHEN l_suppkey % 89 = 0 THEN ' ' || CAST(l_partkey AS STRING)
       ELSE CAST(l_partkey AS STRING) END AS part,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS STRING)
       ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS shipped,
  CASE WHEN l_discount > 0.08 THEN 'yes' WHEN l_discount < 0.02 THEN 'maybe' ELSE 'no' END AS discounted,
  l_linestatus AS status
FROM {lineitem}
"""

LINEITEM_CONTRACT = {
    "description": "itens de pedido",
    "schema": {"table_name": "lineitems", "fields": [
        {"name": "row_key", "type": "str", "required": True},
        {"name": "quantity", "type": "float", "required": True},
        {"name": "part", "type": "int", "required": True},
        {"name": "shipped", "type": "date", "required": False},
        {"name": "discounted", "type": "bool", "required": False},
        {"name": "status", "type": "str", "required": True},
    ]},
}

# Event times as text in every accepted layout, and some that no layout accepts.
RAW_EVENTS = """
SELECT CAST(event_id AS STRING) AS row_key,
  CASE event_id % 10 WHEN 0 THEN substring(CAST(ts AS STRING), 1, 19) WHEN 1 THEN substring(CAST(ts AS STRING), 1, 16)
       WHEN 2 THEN replace(substring(CAST(ts AS STRING), 1, 19), ' ', 'T')
       WHEN 3 THEN replace(substring(CAST(ts AS STRING), 1, 19), ' ', 'T') || 'Z'
       WHEN 4 THEN substring(CAST(ts AS STRING), 9, 2) || '/' || substring(CAST(ts AS STRING), 6, 2) || '/' ||
                   substring(CAST(ts AS STRING), 1, 4) || ' ' || substring(CAST(ts AS STRING), 12, 5)
       WHEN 5 THEN substring(CAST(ts AS STRING), 1, 10) || ' 25:00' WHEN 6 THEN substring(CAST(ts AS STRING), 1, 10)
       WHEN 7 THEN '' WHEN 8 THEN '2023-02-29 ' || substring(CAST(ts AS STRING), 12, 8)
       ELSE substring(CAST(ts AS STRING), 1, 11) || 'x' END AS happened,
  CASE WHEN user_id % 7 = 3 THEN 'u' || CAST(user_id AS STRING) ELSE CAST(user_id AS STRING) END AS user_id
FROM {events}
"""

EVENTS_CONTRACT = {
    "description": "eventos",
    "schema": {"table_name": "events", "fields": [
        {"name": "row_key", "type": "str", "required": True},
        {"name": "happened", "type": "datetime", "required": True},
        {"name": "user_id", "type": "int", "required": True},
    ]},
}

# Empty texts, nulls and names.
EMPTY_TEXT = """
SELECT CAST(c_custkey AS STRING) AS k, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END AS v FROM {customer}
"""

DERIVED = {"raw_events": RAW_EVENTS, "empty_text": EMPTY_TEXT, "raw_customer": RAW_CUSTOMER, "raw_lineitem": RAW_LINEITEM, "base": BASE, "edited": EDITED,
           "ledger_flat": LEDGER_FLAT, "manifest_raw": MANIFEST,
           "base_orders": BASE_ORDERS, "edited_orders": EDITED_ORDERS, "ledger_orders_flat": LEDGER_ORDERS_FLAT}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _refs(text: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in text]


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = DERIVED[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _refs(text)})


def duck(name: str) -> str:
    """The derivation as DuckDB SQL (views are named after the tables)."""
    text = DERIVED[name]
    return text.format(**{t: t for t in TABLES}).replace("AS STRING", "AS VARCHAR")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture ledger with before/after packed into MAP images."""
    flat = derive(spark, sf_dir, "ledger_flat")
    return flat.select(
        "id", "table_name", "database_name", "operation", "row_identifier",
        F.create_map(F.lit("segment"), F.col("before_segment")).alias("before"),
        F.create_map(F.lit("segment"), F.col("after_segment"),
                     F.lit("name"), F.col("after_name")).alias("after"),
        "updated_by", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        "session_id", "change_reason")


def ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem-derived ledger over orders, images packed as maps."""
    flat = derive(spark, sf_dir, "ledger_orders_flat")
    return flat.select(
        "id", "table_name", "database_name", "operation", "row_identifier",
        F.create_map().cast("map<string,string>").alias("before"),
        F.create_map(F.lit("status"), F.col("after_status"),
                     F.lit("priority"), F.col("after_priority")).alias("after"),
        "updated_by", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        "session_id", "change_reason")
