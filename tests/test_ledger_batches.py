"""Exactly-once appends, Bloom filters, bounded facets and landings that don't share folders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vellum.operators import diff, manifest as mf, profile
from vellum.session import scratch_dir
from vellum.sinks.landing import land
from vellum.sinks.ledger_store import (append_changes, committed_batches, committed_changes, create_ledger, reset_ledger)
from vellum.sources.listing import list_landed

META = diff.ChangeMeta("db", "t", "me", dt.datetime(2024, 1, 1), "s1")


def changes(spark, n, mark):
    before = spark.range(n).selectExpr("cast(id as string) as id", "'a' as v")
    return diff.diff_updates(before, before.withColumn("v", F.lit(mark)), "id", META)


def ledger(spark, **how):
    loc = scratch_dir(spark, "ledger-batches")
    name = "ledger_b_" + loc.rsplit("-", 1)[-1]
    create_ledger(spark, name, loc, **how)
    return name, loc


def test_a_batch_counts_once(spark):
    name, loc = ledger(spark, by_batch=True)
    assert committed_batches(spark, name).count() == 0 and committed_changes(spark, name).count() == 0
    assert append_changes(changes(spark, 5, "b"), name, "x'1") == 5
    assert append_changes(changes(spark, 3, "c"), name, "y") == 3
    assert append_changes(changes(spark, 4, "d"), name, "x'1") == 4  # sent again: replaces the first
    got = committed_changes(spark, name)
    assert sorted((r.batch, r.after["v"]) for r in got.collect()) == [("x'1", "d")] * 4 + [("y", "c")] * 3
    assert sorted(tuple(r) for r in committed_batches(spark, name).collect()) == [("x'1", 4), ("y", 3)]
    # data without a commit record is no part of the ledger
    spark.sql(f"INSERT INTO {name} PARTITION (batch = 'half', database_name, table_name) SELECT * EXCEPT (batch) FROM {name} WHERE batch = 'y'")
    assert spark.table(name).count() == 10 and committed_changes(spark, name).count() == 7
    for bad in (None,):
        with pytest.raises(ValueError):
            append_changes(changes(spark, 1, "b"), name, bad)
    reset_ledger(spark, name, loc, confirm=True)
    assert "batch" in spark.table(name).columns and committed_changes(spark, name).count() == 0
    plain, _ = ledger(spark)
    with pytest.raises(ValueError):
        append_changes(changes(spark, 1, "b"), plain, "x")


def test_row_identifiers_have_bloom_filters(spark):
    name, loc = ledger(spark)
    append_changes(changes(spark, 20000, "b"), name)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = [f for f in spark.table(name).inputFiles() if f.endswith(".parquet")]
    found = {}
    for f in files:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
            jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), conf))
        for block in reader.getFooter().getBlocks():
            for column in block.getColumns():
                found.setdefault(column.getPath().toDotString(), []).append(column.getBloomFilterOffset() > 0)
        reader.close()
    assert all(found["row_identifier"]) and not any(found["session_id"])


def test_bounded_facets_agree_with_exact_ones(spark):
    wide = spark.range(3000).selectExpr("id", *[f"CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN '' ELSE 'v' || id % {n} END AS c{n}"
                                               for n in (1, 2, 49, 50, 51, 52, 60, 150, 160, 2999)],
                                        "cast(null as string) as none", "'None' as word")
    for df in (wide, wide.repartition(13), wide.limit(0), wide.limit(40)):
        want = {r["column"]: (r.pick_values, r.control) for r in profile.facet_profile(df).collect()}
        assert {r["column"]: (r.pick_values, r.control) for r in profile.facet_controls(df).collect()} == want
    plan = profile.facet_controls(wide)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_uploads_of_like_names_keep_their_manifest_rows(spark):
    root = scratch_dir(spark, "land-names")
    contract = {"description": "d", "schema": {"fields": [{"name": "id", "type": "int", "required": True}]}}
    df = spark.createDataFrame([("1",), ("2",)], "id string")
    for subject, sub in (("a.b", "c"), ("a", "b.c"), ("a", "b")):
        assert land(df, contract, root, {"subject": subject, "sub_subject": sub, "original_filename": "u.csv"}, dt.datetime(2024, 3, 1, 12)).ok
    got = mf.attach_metadata(list_landed(spark, root), spark.read.parquet(root + "/manifest").drop("upload"))
    assert got.filter("original_filename = 'u.csv'").count() == 3
    assert mf.manifest_stats(got, dt.date(2024, 3, 1)).first().total_rows == 6
