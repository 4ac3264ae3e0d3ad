"""Replay against a direct Python model of the ledger fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import types as T

from vellum.operators.diff import LEDGER_SCHEMA
from vellum.operators.replay import overlay_updates, replay

COLS = ["id", "name", "seg"]


def model(base_rows, records, newest_first):
    state = {r["id"]: dict(r) for r in base_rows}
    recs = sorted(records, key=lambda r: (r["updated_at"], r["id"]), reverse=newest_first)
    for r in recs:
        op, k, img = r["operation"], r["row_identifier"], r["after"] or {}
        if not op or not k:
            continue
        if op == "UPDATE":
            if k in state and img:
                for f, v in img.items():
                    if f in state[k] and v not in (None, ""):
                        state[k][f] = v
        elif op == "INSERT":
            if k not in state and img:
                state[k] = dict(img)
        elif op == "DELETE":
            state.pop(k, None)
    out = set()
    for k, row in state.items():
        out.add(tuple(row.get(c) if (c != "id" or "id" in row) else k for c in COLS))
    return out


def random_case(rng, n_base=12, n_keys=20, n_rec=120):
    base = [{"id": str(i), "name": f"b{i}", "seg": f"s{i % 3}"} for i in range(n_base)]
    t0 = dt.datetime(2024, 1, 1)
    recs = []
    for j in range(n_rec):
        op = rng.choice(["UPDATE", "UPDATE", "INSERT", "DELETE", "", "MERGE"])
        img = {}
        for f in ["name", "seg", "zz"]:
            if rng.random() < 0.6:
                img[f] = rng.choice(["", f"{f}{j}", None])
        if rng.random() < 0.2:
            img["id"] = f"img{j}"
        recs.append({
            "id": f"r{j:04d}", "table_name": "t", "database_name": "d", "operation": op,
            "row_identifier": rng.choice([str(rng.randrange(n_keys)), ""]) if rng.random() < 0.05
            else str(rng.randrange(n_keys)),
            "before": {}, "after": img, "updated_by": "u",
            # coarse times so ties happen and the record id breaks them
            "updated_at": t0 + dt.timedelta(minutes=rng.randrange(40)),
            "session_id": "s", "change_reason": "r"})
    return base, recs


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("precedence", ["latest", "as_written"])
def test_replay_matches_model(spark, seed, precedence):
    rng = random.Random(seed)
    base, recs = random_case(rng)
    bdf = spark.createDataFrame(base, "id string, name string, seg string")
    ldf = spark.createDataFrame(recs, LEDGER_SCHEMA)
    got = {tuple(r) for r in replay(bdf, ldf, "id", precedence=precedence).collect()}
    assert got == model(base, recs, newest_first=(precedence == "as_written"))


def test_empty_ledger_is_identity(spark):
    bdf = spark.createDataFrame([("1", "a", "x"), ("2", "b", None)], "id string, name string, seg string")
    ldf = spark.createDataFrame([], LEDGER_SCHEMA)
    assert sorted(replay(bdf, ldf, "id").collect()) == sorted(bdf.collect())


def test_overlay_updates_only(spark):
    rng = random.Random(7)
    base, recs = random_case(rng)
    recs = [r for r in recs if r["operation"] == "UPDATE"]
    bdf = spark.createDataFrame(base, "id string, name string, seg string")
    ldf = spark.createDataFrame(recs, LEDGER_SCHEMA)
    got = {tuple(r) for r in overlay_updates(bdf, ldf, "id").collect()}
    assert got == model(base, recs, newest_first=False)


def test_typed_base_columns_cast_back(spark):
    bdf = spark.createDataFrame([(1, 10.5), (2, 3.0)], "id long, amount double")
    recs = [{"id": "a", "table_name": "t", "database_name": "d", "operation": "UPDATE",
             "row_identifier": "1", "before": {}, "after": {"amount": "99.25"}, "updated_by": "u",
             "updated_at": dt.datetime(2024, 1, 1), "session_id": "s", "change_reason": "r"}]
    ldf = spark.createDataFrame(recs, LEDGER_SCHEMA)
    out = dict((r["id"], r["amount"]) for r in replay(bdf, ldf, "id").collect())
    assert out == {1: 99.25, 2: 3.0}


@pytest.mark.parametrize("broadcast", [True, False])
def test_uncastable_updates_are_reported_not_applied(spark, broadcast):
    from vellum.operators.replay import uncastable
    bdf = spark.createDataFrame([(1, 10)], "id long, v int")
    recs = [{"id": f"r{i}", "table_name": "t", "database_name": "d", "operation": op, "row_identifier": key, "before": {},
             "after": {"v": v}, "updated_by": "u", "updated_at": dt.datetime(2024, 1, 1 + i), "session_id": "s",
             "change_reason": "r"} for i, (op, key, v) in enumerate([
                 ("UPDATE", "1", "11"), ("UPDATE", "1", "abc"), ("INSERT", "x1", "3"), ("INSERT", "2", "4"), ("UPDATE", "2", "?")])]
    ldf = spark.createDataFrame(recs, LEDGER_SCHEMA)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit if broadcast else "-1")
        assert sorted(replay(bdf, ldf, "id").collect(), key=str) == [(1, 11), (2, 4), (None, 3)]
        assert overlay_updates(bdf, ldf, "id").collect() == [(1, 11)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    got = [(r["id"], r["field"], r["value"]) for r in uncastable(bdf, ldf).collect()]
    assert sorted(got) == [("r1", "v", "abc"), ("r4", "v", "?")]


def test_duplicate_base_key_rejected(spark):
    bdf = spark.createDataFrame([("1", "a"), ("1", "b")], "id string, name string")
    ldf = spark.createDataFrame([], LEDGER_SCHEMA)
    with pytest.raises(ValueError):
        replay(bdf, ldf, "id")


def test_hot_key_third_of_ledger(spark):
    """One key holds a third of all records, with deletes and re-inserts."""
    rng = random.Random(11)
    base, recs = random_case(rng, n_base=30, n_keys=40, n_rec=1500)
    t0 = dt.datetime(2024, 1, 1)
    for j in range(750):
        op = ["UPDATE", "INSERT", "DELETE", "UPDATE", "INSERT"][j % 5]
        recs.append({"id": f"h{j:05d}", "table_name": "t", "database_name": "d", "operation": op,
                     "row_identifier": "hot", "before": {}, "after": {"name": f"h{j}", "seg": "" if j % 3 else "s"},
                     "updated_by": "u", "updated_at": t0 + dt.timedelta(seconds=rng.randrange(3000)),
                     "session_id": "s", "change_reason": "r"})
    bdf = spark.createDataFrame(base, "id string, name string, seg string")
    ldf = spark.createDataFrame(recs, LEDGER_SCHEMA).repartition(8)
    for prec in ["latest", "as_written"]:
        got = {tuple(r) for r in replay(bdf, ldf, "id", precedence=prec).collect()}
        assert got == model(base, recs, newest_first=(prec == "as_written"))


@pytest.mark.parametrize("seed", [21, 22])
def test_replay_shuffle_path_matches_model(spark, seed):
    """Same fold when the ledger summary is too big to broadcast."""
    rng = random.Random(seed)
    base, recs = random_case(rng)
    bdf = spark.createDataFrame(base, "id string, name string, seg string")
    ldf = spark.createDataFrame(recs, LEDGER_SCHEMA)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for prec in ["latest", "as_written"]:
            out = replay(bdf, ldf, "id", precedence=prec)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" not in plan
            got = {tuple(r) for r in out.collect()}
            assert got == model(base, recs, newest_first=(prec == "as_written"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_replay_small_summary_streams_base(spark):
    rng = random.Random(5)
    base, recs = random_case(rng)
    bdf = spark.createDataFrame(base, "id string, name string, seg string")
    ldf = spark.createDataFrame(recs, LEDGER_SCHEMA)
    plan = replay(bdf, ldf, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "FullOuter" not in plan


def _rec(i, op, rid, after):
    return {"id": f"r{i}", "table_name": "t", "database_name": "d", "operation": op, "row_identifier": rid,
            "before": {}, "after": after, "updated_by": "u", "updated_at": dt.datetime(2024, 1, 1, 0, i),
            "session_id": "s", "change_reason": "r"}


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_numeric_key_matches_by_text(spark, threshold):
    bdf = spark.createDataFrame([(7, "a"), (8, "b")], "id long, v string")
    recs = [_rec(1, "UPDATE", "007", {"v": "x"}),   # not the text of any key: no match
            _rec(2, "UPDATE", "8", {"v": "y"}),
            _rec(3, "INSERT", "007", {"v": "n"}),   # absent by text, so it is created
            _rec(4, "INSERT", "7", {"v": "ignored"})]
    ldf = spark.createDataFrame(recs, LEDGER_SCHEMA)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = sorted(tuple(r) for r in replay(bdf, ldf, "id").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == [(7, "a"), (7, "n"), (8, "y")]


def test_bucketed_numeric_base_is_not_shuffled(spark):
    from vellum.session import scratch_dir
    from vellum.sinks.snapshots import save_snapshot
    base = spark.range(1000).selectExpr("id", "CAST(id % 5 AS STRING) AS v")
    t = save_snapshot(base, "num_base_bkt", "id", 8, scratch_dir(spark, "num-bkt"))
    recs = [_rec(i, "UPDATE", str(i * 3), {"v": "z"}) for i in range(50)]
    ldf = spark.createDataFrame(recs, LEDGER_SCHEMA)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = replay(spark.table(t), ldf, "id")
        plan = out._jdf.queryExecution().executedPlan().toString()
        # the full-row read of base keeps its bucket layout (no shuffle of
        # base rows); only key-only reads may be shuffled
        full = [ln for ln in plan.splitlines() if "num_base_bkt" in ln and "v:string" in ln]
        assert full and all("Bucketed: true" in ln for ln in full)
        assert out.filter("v = 'z'").count() == 50 and out.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
