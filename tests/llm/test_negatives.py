"""Operator 11 against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from vellum.llm.negatives import Tree, hard_negatives, tiles
from vellum.llm.queries import ORACLE, op11_hard_negatives

SCHEMA = "vec_id long, label string, embedding array<long>, vector int, shard string"


def plain(rows, positives=5, negatives=10, low=30, high=90):
    """rows: (id, label, vector, is_anchor); every row that takes part."""
    kept = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for i, a in enumerate(kept):
        if not a[3] or a[0] is None:
            continue
        scored = [(b[0], dot(a[2], b[2]), b[1]) for j, b in enumerate(kept) if j != i]
        for pid, p, _ in sorted((x for x in scored if x[2] == a[1]), key=order)[:positives]:
            fits = sorted((x for x in scored if x[2] != a[1] and low * p <= 100 * x[1] <= high * p), key=order)
            out += [(a[0], pid, k + 1, n, p, s) for k, (n, s, _) in enumerate(fits[:negatives])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def cases(seed, n=400, dims=6, scale=20):
    rng = np.random.default_rng(seed)
    rows = [(int(i), "abc"[rng.integers(3)], [int(x) for x in rng.integers(-scale, scale, dims)]) for i in range(n)]
    same = rows[7][2]
    rows += [(1000 + i, "abcd"[i % 4], list(same)) for i in range(n // 2)]  # a third share one vector
    rows += [(5, "a", rows[5][2]), (5, "b", [1, 2, 3]), (None, "a", [9] * dims), (None, None, [1] * dims), (2000, "b", None),
             (2001, "c", [1, None, 2]), (2002, "a", []), (2003, "lonely", [3] * dims), (2010, "c", [scale] * dims)]
    return rows


@pytest.mark.parametrize("seed, shard_rows, page_rows, scale", [(1, 50, 4, 20), (2, 1 << 18, 256, 20), (3, 40, 7, 1 << 28)])
def test_against_all_products(spark, seed, shard_rows, page_rows, scale):
    rows = cases(seed, scale=scale)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = hard_negatives(df, anchors=F.col("vec_id") % 10 == 0, shard_rows=shard_rows, page_rows=page_rows)
    want = plain([(*r, r[0] is not None and r[0] % 10 == 0) for r in rows])
    assert len(want) > 300 and got(out) == want


def test_edges(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in cases(4, 20)], SCHEMA)
    assert got(hard_negatives(df.limit(0))) == []
    assert got(hard_negatives(df.filter("label = 'a'"))) == []
    big = spark.createDataFrame([(0, "a", [1 << 40], 1, "x"), (1, "a", [1 << 40], 1, "x")], SCHEMA)
    with pytest.raises(ValueError):
        hard_negatives(big)
    low = df.filter("vec_id < 20")
    assert got(hard_negatives(low, positives=2, negatives=3, low=10, high=200)) == plain(
        [(*r, True) for r in cases(4, 20) if r[0] is not None and r[0] < 20], 2, 3, 10, 200)


def test_whole_table(spark):
    """The query against the SQL's engine and against plain Python on the given table."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF01}/embeddings.parquet'")
    want = sorted(con.execute(ORACLE["op11_hard_negatives"]).fetchall(), key=str)
    out = op11_hard_negatives(spark, SF01)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert len(want) > 100 and got(out) == want


def test_pages_and_boxes():
    rng = np.random.default_rng(0)
    v = rng.integers(-50, 50, (1000, 5)).astype(np.int16)
    pages = tiles(v, 16)
    assert sorted(np.concatenate(pages).tolist()) == list(range(1000)) and max(map(len, pages)) <= 16
    v = v[np.concatenate(pages)]
    tree = Tree(np.arange(1000), np.ones(1000, bool), ["x"] * 1000, v, [len(p) for p in pages], True)
    q = rng.integers(-50, 50, (7, 5)).astype(float)
    least, most = tree.bounds(q)[1]
    for i, (a, z) in enumerate(zip(tree.edges, tree.edges[1:])):
        s = q @ v[a:z].astype(float).T
        assert (least[:, i] <= s.min(axis=1)).all() and (s.max(axis=1) <= most[:, i]).all()
    seen = []
    scores = lambda p: seen.append(p) or v[tree.edges[p]:tree.edges[p + 1]].astype(float) @ q[0]
    tree.first(1, -10 ** 9, 10 ** 9, -10 ** 9, [(a[0], b[0]) for a, b in tree.bounds(q)], scores, lambda p: np.ones(tree.edges[p + 1] - tree.edges[p], bool))
    assert len(set(seen)) < len(pages) / 2  # the queue ends before most pages
