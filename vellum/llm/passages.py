"""Repeated passages: what the byte and the word operator share.

A text is a sequence of symbols (bytes or words); a window is ``width``
consecutive symbols of one document.  Which windows repeat is found without
moving every window:

1. ``pack``: documents in slices of a few MB, compressed, written once.
2. *Cover positions.*  Of the ``width - gram + 1`` grams (``gram`` symbols) in a
   window, the one with the least hash is its cover position.  Equal windows
   have equal grams, hence the same cover position at the same offset: the
   positions are a difference cover of all windows, of about
   ``2 / (width - gram + 2)`` of the positions, that depends on content only.
3. Cover grams are dealt into buckets by hash; a gram found once proves that
   its windows occur once.  Slices are told which of their grams are shared.
4. Only the surroundings of shared cover positions (all windows they cover)
   are dealt into buckets, and each bucket is judged on its own, one at a time,
   by the operator's method.  Equal surroundings within a slice go once, with
   the smallest document id, so that the copies of one passage are reduced
   before they meet.
5. A gram that occurs ``HOT_COVERS`` times or more is split: its surroundings
   are cut by the windows' distance from the cover position into 2, 4, ...
   parts, the more the oftener it occurs, and each part is dealt by the gram,
   the distance and the symbols that all its windows share.  Equal windows have
   these in common, so none is lost.  In the last resort a part is one window,
   and what meets is equal windows, one a slice.
6. Starts of repeated windows go back to their slices, which remove.

Bucket counts follow the input, so a bucket holds about the same at any size;
a gram or part brings at most ``HOT_COVERS`` times the windows of a position to
one bucket, or one row a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import byte_values, materialize, slices

SLICE_BYTES = 4 << 20
CHUNK_SYMBOLS = 1 << 19
BUCKET_COVERS = 300_000
HOT_COVERS = 1 << 15
NO_ID = np.iinfo(np.int64).max  # a null document id: after all others

_K = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit moves about half of the output's."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * _K


def squeeze(a: np.ndarray | bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(a if isinstance(a, bytes) else a.tobytes())


def unsqueeze(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``slice, ids, sizes, body``: documents in slices of about ``SLICE_BYTES``."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, held = TaskContext.get().partitionId() << 16, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                 pa.array([squeeze(b"".join(texts))])], names=["slice", "ids", "sizes", "body"])

        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), byte_values(b.column(1)), strict=True):
                ids.append(doc_id)
                texts.append(text)
                held += len(text) + 1
                if held >= SLICE_BYTES:
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield row()

    return materialize(given.mapInArrow(run, "slice long, ids array<long>, sizes array<long>, body binary"), "packed")


class Slice:
    """One row of ``pack``: ids (null: ``NO_ID``) and texts."""

    def __init__(self, number: int, ids: list, sizes: list, body: bytes):
        self.number = number
        self.given = ids
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.body, self.ends = unsqueeze(body), np.cumsum(np.array(sizes, np.int64))
        self.texts = [self.body[e - n:e] for n, e in zip(sizes, self.ends.tolist(), strict=True)]
        self.unique = (np.int64(number) << 22) + np.arange(len(ids))  # names the document


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[Slice, list]]:
    """The slices of a batch and what is joined to each (its last column)."""
    for i in range(batch.num_rows):
        number, ids, sizes, body, *rest = (c[i].as_py() for c in batch.columns)
        yield Slice(number, ids, sizes, body), (rest[0] or [] if rest else [])


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` consecutive symbols, by doubling."""
    power, size, out, have = symbols, 1, None, 0
    while True:
        if gram & size:
            if out is None:
                out, have = power, size
            else:
                n = max(0, len(symbols) - have - size + 1)
                out, have = mixed(out[:n] * _K) + power[have:have + n], have + size
        if 2 * size > gram:
            return mixed(out)
        n = max(0, len(power) - size)
        power, size = mixed(power[:n] * _K) + power[size:size + n], 2 * size


class Covers:
    """Cover positions of a run of documents: place, document, first window and number of windows, gram hash."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, width: int, gram: int):
        self.at = self.doc = self.first = self.count = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        starts = len(symbols) - width + 1
        if starts <= 0:
            return
        g = gram_hashes(symbols, gram)
        least = (g & ~np.uint64(0xFFFFFFFF)) | np.arange(len(g), dtype=np.uint64)
        size, wide = 1, width - gram + 1
        while 2 * size <= wide:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < wide:
            least = np.minimum(least[:size - wide], least[wide - size:])
        begins = np.concatenate([[0], ends[:-1]])
        long = ends - begins >= width
        edge = np.zeros(starts + 1, np.int32)
        np.add.at(edge, begins[long], 1)
        np.add.at(edge, ends[long] - width + 1, -1)
        window = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        at = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        doc = np.searchsorted(ends, window, "right")
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])) if len(window) else window
        self.at, self.doc, self.first = at[new], doc[new], window[new]
        self.count, self.hash = np.diff(np.append(new, len(window))), g[self.at]


def covers_of(symbols_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], texts: list[bytes], width: int, gram: int) -> Covers:
    """``Covers`` of a slice, found for a bounded run of documents at a time; places count symbols of the slice."""
    parts, begin, place = [], 0, 0
    while begin < len(texts):
        to, held = begin, 0
        while to < len(texts) and (to == begin or held + len(texts[to]) <= CHUNK_SYMBOLS):
            held += len(texts[to])
            to += 1
        symbols, ends = symbols_of(texts[begin:to])
        part = Covers(symbols, ends, width, gram)
        part.at, part.first, part.doc = part.at + place, part.first + place, part.doc + begin
        parts.append(part)
        place += len(symbols)
        begin = to
    out = Covers(np.zeros(0, np.uint64), np.zeros(0, np.int64), width, gram)
    for name in ("at", "doc", "first", "count", "hash"):
        if parts:
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
    return out


def split_hot(covers: Covers, chosen: np.ndarray, level: np.ndarray, wide: int) -> tuple[Covers, np.ndarray, np.ndarray]:
    """The chosen cover positions, those of ``level`` j > 0 cut into parts of ``wide / 2**j`` distances or fewer: the parts,
    the least distance in each and how many distances it spans (0: not cut)."""
    size = np.where(level > 0, -(-wide >> level), 0)
    far, whole = covers.at[chosen] - covers.first[chosen], np.where(level > 0, size, wide)
    near = far - covers.count[chosen] + 1
    pieces = far // whole - near // whole + 1
    own = np.repeat(np.arange(len(chosen)), pieces)
    block = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + (near // whole)[own]
    low, high = np.maximum(near[own], block * whole[own]), np.minimum(far[own], (block + 1) * whole[own] - 1)
    out = Covers(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, 1)
    out.at, out.doc, out.hash = covers.at[chosen][own], covers.doc[chosen][own], covers.hash[chosen][own]
    out.first, out.count = out.at - high, high - low + 1
    return out, block * whole[own], size[own]


def part_hashes(symbols: np.ndarray, parts: Covers, least: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The hash that deals each part: its gram's, and for a cut one also of its distance and the symbols all its windows share."""
    out = parts.hash.copy()
    for n in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == n)
        begin, h = parts.at[own] - least[own], mixed(out[own] + least[own].astype(np.uint64) * _K)
        for k in range(width - n + 1):
            h = mixed(h * _K + symbols[begin + k])
        out[own] = h
    return out


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each bucket (first column), one bucket at a time; a partition is sorted by it."""
    rows: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and rows[-1][0] != row[0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def repeated_starts(packed: DataFrame, symbols_of, symbol_bytes: int, width: int, gram: int, describe, judge,
                    within: bool) -> DataFrame:
    """``slice, starts``: compressed runs (start, number) of windows that occur earlier, by slice.

    ``describe(slice, covers, chosen)`` gives the surroundings of the chosen
    cover positions: a key per position (equal keys, equal surroundings and
    windows) and a function from positions to bytes.  ``judge(bodies)`` reads
    the bodies of a bucket and gives, for each window in their order, its class.
    ``symbol_bytes``: about how many bytes a symbol takes.  ``within``: a window that starts earlier in the same document counts too.
    """
    total = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = int(total / symbol_bytes * 2 / (width - gram + 2) // BUCKET_COVERS) + 1
    hot = min(HOT_COVERS, BUCKET_COVERS // 8 or 1)  # a fraction of a bucket, whatever its size

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, _ in _slices(b):
                hashes, first, times = np.unique(covers_of(symbols_of, s.texts, width, gram).hash, return_index=True, return_counts=True)
                names, own = [], []
                for k, part in _by_bucket((hashes % np.uint64(buckets)).astype(np.int64)):
                    part = part[np.argsort(first[part])]
                    names.append(k)
                    own.append((hashes[part].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes(),  # 48 bits and the bucket
                                squeeze(np.concatenate([np.diff(first[part], prepend=0), times[part]]).astype(np.uint32))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array([s.number] * len(names), pa.int64()),
                     pa.array([x for x, _ in own], pa.binary()), pa.array([x for _, x in own], pa.binary())],
                    names=["bucket", "slice", "hashes", "places"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            names, times = [], []
            for r in rows:
                six = np.frombuffer(r[2], np.uint8).reshape(-1, 6)
                names.append(np.pad(six, ((0, 0), (0, 2))).view(np.uint64).ravel())
                times.append(np.frombuffer(unsqueeze(r[3]), np.uint32)[len(six):])
            _, inverse, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
            total = np.bincount(inverse, np.concatenate(times))
            level = np.minimum(np.ceil(np.log2(total // hot + 1)), 6).astype(np.uint8)[inverse]
            often, at, out = count[inverse] > 1, 0, []
            for r, own in zip(rows, names, strict=True):
                chosen, high = often[at:at + len(own)], level[at:at + len(own)]
                at += len(own)
                if chosen.any():
                    places = np.cumsum(np.frombuffer(unsqueeze(r[3]), np.uint32)[:len(own)], dtype=np.int64)
                    out.append((r[1], squeeze(places[chosen].astype(np.uint32).tobytes() + high[chosen].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())],
                                             names=["slice", "places"])

    def joined(replies: DataFrame, column: str, how: str) -> DataFrame:
        own = replies.groupBy("slice").agg(F.collect_list(column).alias(column))  # a slice's: bounded by its size
        return packed.join(own, "slice", how).select("slice", "ids", "sizes", "body", column)

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, replies in _slices(b):
                covers = covers_of(symbols_of, s.texts, width, gram)
                hashes, inverse, count = np.unique(covers.hash, return_inverse=True, return_counts=True)
                known, level = count > 1, np.zeros(len(hashes), np.int64)
                for r in replies:
                    r = unsqueeze(r)
                    told = inverse[np.frombuffer(r, np.uint32, len(r) // 5)]
                    known[told], level[told] = True, np.frombuffer(r, np.uint8, len(r) // 5, len(r) // 5 * 4)
                chosen = np.flatnonzero(known[inverse])
                covers, least, size = split_hot(covers, chosen, level[inverse][chosen], width - gram + 1)
                symbols = np.concatenate([symbols_of([t])[0] for t in s.texts]) if size.any() else np.zeros(0, np.uint64)
                dealt_by = part_hashes(symbols, covers, least, size, width)
                chosen = np.arange(len(covers.at))
                key, body_of = describe(s, covers, chosen)
                ids = s.ids[covers.doc[chosen]]
                order = np.lexsort([ids, key])
                first = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, bool)
                least = np.zeros(len(chosen), np.int64)
                least[order] = ids[order][np.flatnonzero(first)][np.cumsum(first) - 1]
                copy = ids > least
                sure = chosen[copy]
                rows = [(int(s.number % buckets), s.number, True, squeeze(np.stack([covers.first[sure], covers.count[sure]])))]
                chosen = chosen[~copy]
                for k, part in _by_bucket((dealt_by[chosen] % np.uint64(buckets)).astype(np.int64)):
                    own = chosen[part]
                    head = np.stack([covers.at[own], covers.first[own], covers.count[own], s.ids[covers.doc[own]],
                                     s.unique[covers.doc[own]]])
                    rows.append((k, s.number, False, squeeze(np.int64(len(own)).tobytes() + head.tobytes() + body_of(own))))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(4)],
                                                 names=["bucket", "slice", "sure", "body"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            out = [(r[1], r[3]) for r in rows if r[2]]
            heads, bodies, of = [], [], []
            for _, number, sure, body in rows:
                if not sure:
                    body = unsqueeze(body)
                    n = int(np.frombuffer(body, np.int64, 1)[0])
                    heads.append(np.frombuffer(body, np.int64, 5 * n, 8).reshape(5, n))
                    bodies.append(body[8 + 40 * n:])
                    of.append(np.full(n, number))
            if heads:
                at, first, count, ids, unique = np.concatenate(heads, axis=1)
                row = np.repeat(np.arange(len(at)), count)
                start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
                kind = judge(bodies, at, first, count)
                order = np.argsort(kind, kind="stable")
                new = np.concatenate([[True], kind[order][1:] != kind[order][:-1]])
                of_row = ids[row][order]
                least = np.minimum.reduceat(of_row, np.flatnonzero(new))[np.cumsum(new) - 1]
                earlier = of_row > least
                found = order[earlier]
                if within:  # among the windows of the smallest id, those that aren't their document's first
                    rest = order[~earlier]
                    rest = rest[np.lexsort([start[rest], unique[row[rest]], kind[rest]])]
                    again = (kind[rest][1:] == kind[rest][:-1]) & (unique[row[rest]][1:] == unique[row[rest]][:-1])
                    found = np.concatenate([found, rest[1:][again]])
                for number, part in _by_bucket(np.concatenate(of)[row][found]):
                    mine = np.sort(start[found[part]])
                    cut = np.flatnonzero(np.concatenate([[True], np.diff(mine) != 1]))
                    out.append((number, squeeze(np.stack([mine[cut], np.diff(np.append(cut, len(mine)))]))))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())],
                                             names=["slice", "starts"])

    dealt = lambda df: df.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    names = dealt(packed.mapInArrow(grams, "bucket long, slice long, hashes binary, places binary"))
    replies = names.mapInArrow(shared, "slice long, places binary")
    bodies = joined(replies, "places", "left").mapInArrow(surroundings, "bucket long, slice long, sure boolean, body binary")
    starts = dealt(bodies).mapInArrow(judged, "slice long, starts binary")
    return joined(starts, "starts", "left")


def covered(length: int, width: int, replies: list[bytes]) -> np.ndarray:
    """For each symbol of a slice: whether a window that starts at one of the runs covers it."""
    edge = np.zeros(length + 1, np.int32)
    for r in replies:
        first, count = np.frombuffer(unsqueeze(r), np.int64).reshape(2, -1)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + count + width - 1, -1)
    return np.cumsum(edge[:-1]) > 0
