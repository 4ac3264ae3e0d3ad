"""Hard negatives by a packed R-tree over integer vectors (operator 11).

A row's score for an anchor is their inner product; higher scores come first,
ties by smaller id.  An anchor's positives are its first ``positives`` other
rows of the same label.  For each positive of score p, its hard negatives are
the first ``negatives`` rows of another label whose score s satisfies
``low * p <= 100 * s <= high * p``.

The tree is packed by sort-tile-recursion: rows are dealt into slabs by ranges
of the first coordinate, slabs into shards by ranges of the second (ties by id,
so that many equal vectors spread), and a task packs its shard into pages along
the further coordinates.  A minimum bounding box gives every coordinate an
interval, and with an anchor's signs an interval of the inner products of the
rows below it.  A search keeps a queue of boxes, best possible score first:
boxes that miss the score window are left out, and it ends when the best box
left is strictly below the k-th score found.

Each anchor is sent to every shard with the k-th score of its own shard as a
start, so that other shards return only what can still count; the shards'
answers are merged by rank.  The anchors are the stated query set against all
rows: a shard is read once per search and anchors stream past it.

Memory: one shard (``shard_rows`` rows, in the smallest integer type) and a
block of anchors per task.  Shards are cut by a sample of the rows, so their
number of rows is near the bound, not exact.

Rows that take no part (no anchor, no candidate): null label or vector, or a
null component.  Defined results: rows with a null id are candidates that come
after all others of their score, and no anchors; repeated rows and ids are rows
of their own (an anchor is only kept from itself); shorter vectors count as
ended by zeros; an anchor without another row of its label, or with positives
of a negative score (an empty window), gives no rows; other columns are
ignored; an empty table gives no rows.  Inner products are exact; vectors whose
products could pass 2^62 are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import materialize, shuffle_width

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
SHARD_ROWS = 1 << 18
PAGE_ROWS = 256
FANOUT = 16
BLOCK = 256  # anchors whose boxes are bounded at a time

LEAST, MOST = -(1 << 62), 1 << 62

_PAGES = ("kind long, shard long, page long, slot long, id long, ids binary, named binary, labels array<string>, vectors binary, "
          "seeds array<long>, scores array<long>")
_FOUND = "shard long, slot long, window long, score long, id long"


def tiles(vectors: np.ndarray, page_rows: int, coordinate: int = 2) -> list[np.ndarray]:
    """Rows in pages of at most ``page_rows``: cut into equal runs along one coordinate, each run along the next."""
    def cut(rows: np.ndarray, c: int) -> Iterator[np.ndarray]:
        pages = -(-len(rows) // page_rows)
        if pages <= 1:
            yield rows
            return
        left = max(1, vectors.shape[1] - c)
        runs = max(2, int(np.ceil(pages ** (1 / left))))
        size = -(-pages // runs) * page_rows
        rows = rows[np.argsort(vectors[rows, c % vectors.shape[1]], kind="stable")]
        for at in range(0, len(rows), size):
            yield from cut(rows[at:at + size], c + 1)

    return list(cut(np.arange(len(vectors)), coordinate))


class Tree:
    """A shard's pages and the boxes above them."""

    def __init__(self, ids: np.ndarray, named: np.ndarray, labels: list[str], vectors: np.ndarray, sizes: list[int], exact: bool):
        self.ids, self.named, self.vectors = ids, named, vectors
        self.number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        self.labels = np.array([self.number[x] for x in labels], np.int64)
        self.edges = np.concatenate(([0], np.cumsum(sizes)))
        self.kind = np.float64 if exact else np.int64
        pages = [f.reduceat(vectors, self.edges[:-1], axis=0).astype(self.kind) for f in (np.minimum, np.maximum)]
        above = np.arange(0, len(sizes), FANOUT)
        self.boxes = [[f.reduceat(p, above, axis=0) for f, p in zip((np.minimum, np.maximum), pages)], pages]

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(least, most)`` possible inner products, of the inner boxes and of the pages, for a block of anchors."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return [(up @ low.T + down @ high.T, up @ high.T + down @ low.T) for low, high in self.boxes]

    def first(self, k: int, low: int, high: int, seed: int, bounds: list[tuple[np.ndarray, np.ndarray]], scores, allowed) -> np.ndarray:
        """The slots of the first ``k`` allowed rows whose score lies in the window and is not below ``seed``."""
        (inner_least, inner_most), (least, most) = bounds
        kth, found = max(low, seed), np.zeros(0, np.int64)
        value = np.zeros(0, self.kind)
        some = np.flatnonzero((inner_most >= kth) & (inner_least <= high))
        queue = [(-min(m, high), -1, i) for m, i in zip(inner_most[some].tolist(), some.tolist())]
        heapify(queue)
        while queue:
            best, page, box = heappop(queue)
            if -best < kth:
                break
            if page < 0:
                at = box * FANOUT
                m, n = most[at:at + FANOUT], least[at:at + FANOUT]
                for i in np.flatnonzero((m >= kth) & (n <= high)).tolist():
                    heappush(queue, (-min(m[i].item(), high), at + i, 0))
                continue
            s = scores(page)
            new = np.flatnonzero((s >= kth) & (s <= high) & allowed(page))
            if len(new):
                found, value = np.concatenate([found, new + self.edges[page]]), np.concatenate([value, s[new]])
                if len(found) > k:
                    order = np.lexsort((self.ids[found], ~self.named[found], -value))[:k]
                    found, value = found[order], value[order]
                if len(found) == k:
                    kth = max(kth, value.min().item())
        return found

    def search(self, q: np.ndarray, labels: list[str], skip: list[int], same: bool, k: int, windows: list[list[tuple[int, int, int]]]
               ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(anchor, window, slots, scores)`` for a block of anchors, each with its windows ``(low, high, seed)``."""
        bounds = self.bounds(q)
        for i in range(len(q)):
            mine = [(least[i], most[i]) for least, most in bounds]
            label, seen = self.number.get(labels[i], -1), {}

            def scores(page: int) -> np.ndarray:
                if page not in seen:
                    seen[page] = self.vectors[self.edges[page]:self.edges[page + 1]].astype(self.kind) @ q[i]
                return seen[page]

            def allowed(page: int) -> np.ndarray:
                at = self.edges[page]
                out = (self.labels[at:self.edges[page + 1]] == label) == same
                if at <= skip[i] < self.edges[page + 1]:
                    out[skip[i] - at] = False
                return out

            for w, (low, high, seed) in enumerate(windows[i]):
                if low > high:
                    continue
                slots = self.first(k, low, high, seed, mine, scores, allowed)
                page = np.searchsorted(self.edges, slots, "right") - 1
                yield i, w, slots, np.array([scores(p)[s - self.edges[p]] for p, s in zip(page.tolist(), slots.tolist())], np.int64)


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with their shard: ranges of the second coordinate within slabs of the first."""
    at = lambda i: F.coalesce(F.get("vector", F.lit(i)), F.lit(0))
    slabs = int(np.ceil(np.sqrt(shards)))
    slab = materialize(rows.repartitionByRange(slabs, at(0), "id").withColumn("slab", F.spark_partition_id()), "negatives-slabs")
    return slab.repartitionByRange(shards, "slab", at(1), "id").withColumn("shard", F.spark_partition_id().cast("long"))


def _packed(dealt: DataFrame, dims: int, dtype: str, exact: bool, positives: int, page_rows: int) -> DataFrame:
    """Pages (kind 0) and anchors (kind 1, with the k-th positive score of their own shard) of every shard."""
    given = dealt.select("shard", "id", F.col("label").cast("string"), "anchor", "vector")
    schema = dealt.sparkSession.createDataFrame([], _PAGES).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, shard = [], None
        for b in batches:
            if not b.num_rows:
                continue
            shard, vector = b.column(0)[0].as_py(), b.column(4)
            length = pc.list_value_length(vector).to_numpy()
            matrix = np.zeros((b.num_rows, dims), dtype)
            row = np.repeat(np.arange(b.num_rows), length)
            matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = vector.flatten().to_numpy()
            parts.append((pc.fill_null(b.column(1), 0).to_numpy(), pc.is_valid(b.column(1)).to_numpy(zero_copy_only=False),
                          b.column(2).to_pylist(), b.column(3).to_numpy(zero_copy_only=False), matrix))
        if not parts:
            return
        ids, named, anchor, vectors = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3, 4))
        labels = [x for p in parts for x in p[2]]
        pages = tiles(vectors, page_rows)
        order = np.concatenate(pages)
        ids, named, anchor, vectors, labels = ids[order], named[order], anchor[order], vectors[order], [labels[i] for i in order]
        tree = Tree(ids, named, labels, vectors, [len(p) for p in pages], exact)
        rows = []
        for i, (a, z) in enumerate(zip(tree.edges, tree.edges[1:])):
            rows.append({"kind": 0, "shard": shard, "page": i, "ids": ids[a:z].tobytes(), "named": named[a:z].tobytes(),
                         "labels": labels[a:z], "vectors": vectors[a:z].tobytes()})
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        anchors = np.flatnonzero(anchor & named)
        for at in range(0, len(anchors), BLOCK):
            own, rows = anchors[at:at + BLOCK], []
            windows = [[(LEAST, MOST, LEAST)]] * len(own)
            found = tree.search(vectors[own].astype(tree.kind), [labels[i] for i in own], own.tolist(), True, positives, windows)
            for i, _, _, scores in found:
                s = own[i]
                rows.append({"kind": 1, "shard": shard, "slot": int(s), "id": int(ids[s]), "labels": [labels[s]],
                             "vectors": vectors[s].tobytes(),
                             "seeds": [int(scores.min()) if len(scores) == positives else LEAST]})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return given.mapInArrow(run, schema)


def _search(pages: DataFrame, anchors: DataFrame, dims: int, dtype: str, exact: bool, same: bool, k: int,
            percent: tuple[int, int] = (0, 0)) -> DataFrame:
    """``shard, slot, window, score, id``: what each shard has for the anchors sent to it (column ``target``).

    ``shard`` and ``slot`` name the anchor, ``window`` counts its windows from 0: one for each of its
    ``scores``, ``percent`` of that score, or a single open one.
    """
    sent = pages.filter("kind = 0").withColumn("target", F.col("shard")).unionByName(anchors)
    sent = sent.repartition("target").sortWithinPartitions("target", "kind", "page")
    names = ["kind", "target", "shard", "slot", "ids", "named", "labels", "vectors", "seeds", "scores"]
    low, high = percent

    def answers(tree: Tree, target: int, b: pa.RecordBatch) -> pa.RecordBatch:
        home, slot = b.column(2).to_numpy(), b.column(3).to_numpy()
        q = np.frombuffer(b"".join(b.column(7).to_pylist()), dtype).reshape(-1, dims).astype(tree.kind)
        windows = [[(LEAST, MOST, seeds[0])] if scores is None else [(-(-low * p // 100), high * p // 100, s) for p, s in zip(scores, seeds)]
                   for scores, seeds in zip(b.column(9).to_pylist(), b.column(8).to_pylist())]
        skip = np.where(home == target, slot, -1).tolist()
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        valid = [np.zeros(0, bool)]
        for i, w, slots, scores in tree.search(q, [x[0] for x in b.column(6).to_pylist()], skip, same, k, windows):
            for part, x in zip(out, (home[i], slot[i], w)):
                part.append(np.full(len(slots), x))
            out[3].append(scores)
            out[4].append(tree.ids[slots])
            valid.append(tree.named[slots])
        arrays = [np.concatenate(x) for x in out]
        return pa.RecordBatch.from_arrays([*map(pa.array, arrays[:4]), pa.array(arrays[4], mask=~np.concatenate(valid))],
                                          names=["shard", "slot", "window", "score", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tree = None, [], None
        for batch in batches:
            target, kind = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            place = target * 2 + kind
            edges = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1), len(place)]
            for at, to in zip(edges, edges[1:]):
                if at == to:
                    continue
                if target[at] != now:
                    now, parts, tree = target[at], [], None
                mine = batch.slice(at, to - at)
                if kind[at] and tree is None and not parts:
                    continue  # no row was dealt there
                if kind[at] == 0:
                    parts += zip(*(mine.column(c).to_pylist() for c in (4, 5, 6, 7)))
                    continue
                if tree is None:
                    tree = Tree(np.frombuffer(b"".join(p[0] for p in parts), np.int64), np.frombuffer(b"".join(p[1] for p in parts), bool),
                                [x for p in parts for x in p[2]],
                                np.frombuffer(b"".join(p[3] for p in parts), dtype).reshape(-1, dims), [len(p[2]) for p in parts], exact)
                    parts = []
                for s in range(0, mine.num_rows, BLOCK):
                    yield answers(tree, int(now), mine.slice(s, BLOCK))

    return sent.select(*names).mapInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("shard", "slot", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   anchors: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   shard_rows: int = SHARD_ROWS, page_rows: int = PAGE_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``rank`` counts a positive's negatives from 1.

    ``vector_col`` holds arrays of integers, ``id_col`` integers; ``anchors`` is a condition on ``rows`` (default: all).
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<long>").alias("vector"),
                       F.coalesce(anchors if anchors is not None else F.lit(True), F.lit(False)).alias("anchor"))
    kept = kept.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    most = F.greatest(F.max(F.array_max("vector")), -F.min(F.array_min("vector")))
    n, dims, most = kept.agg(F.count("*"), F.max(F.size("vector")), most).first()
    dims, most = max(1, dims or 0), max(1, most or 0)
    if dims * most ** 2 >= MOST:
        raise ValueError(f"inner products of {dims} components up to {most} don't fit")
    dtype = next(t for t in ("int16", "int32", "int64") if most <= np.iinfo(t).max)
    exact = dims * most ** 2 < 1 << 53
    shards = max(shuffle_width(rows), -(-n // shard_rows))
    pages = materialize(_packed(_dealt(kept, shards), dims, dtype, exact, positives, page_rows), "negatives-pages")
    asked = pages.filter("kind = 1")
    last = pages.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))

    def search(anchors: DataFrame, target: Column, same: bool, k: int) -> DataFrame:
        return _first(_search(pages, anchors.withColumn("target", target), dims, dtype, exact, same, k, (low, high)), k)

    best = search(asked, everywhere, True, positives).select(
        "shard", "slot", (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = materialize(best, "negatives-positives")
    scores = best.groupBy("shard", "slot").agg(F.sort_array(F.collect_list(F.struct("window", "positive_score"))).alias("p"))
    asked = asked.drop("scores", "seeds").join(scores, ["shard", "slot"]).withColumn("scores", F.col("p.positive_score"))
    asked = materialize(asked.withColumn("seeds", F.transform("p", lambda x: F.lit(LEAST))).select(*pages.columns), "negatives-asked")

    own = search(asked, F.col("shard"), False, negatives)
    seeds = (own.groupBy("shard", "slot", "window").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == negatives)
             .groupBy("shard", "slot").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("m")))
    started = asked.join(seeds, ["shard", "slot"], "left").withColumn(
        "seeds", F.transform("seeds", lambda x, i: F.coalesce(F.try_element_at("m", i.cast("long")), x))).select(*pages.columns)
    found = search(started, everywhere, False, negatives)
    names = asked.select("shard", "slot", F.col("id").alias("anchor_id"))
    return (found.join(best, ["shard", "slot", "window"]).join(names, ["shard", "slot"])
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
