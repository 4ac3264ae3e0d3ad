"""Suffix-array dedup of bytes (operator 5).

Every byte covered by a ``width``-byte string that also starts in a document
with a smaller id is removed; strings are judged on the input.

Difference-cover construction, blockwise: cover positions (see ``passages``:
chosen by content, so that equal strings hold a cover position at the same
offset) are sampled first, and suffixes are sorted one bucket at a time.
Within a bucket only the cover positions are sorted, by the bytes from the
position on and, apart, by the bytes before it read backwards; common prefix
lengths of neighbours turn either order into ranks at every depth.  All other
suffixes of the bucket are never sorted: a string that starts ``d`` bytes
before a cover position is fully named by ``d``, the rank at depth ``d`` of what
lies before and the rank at depth ``width - d`` of what follows.  Memory is
bounded by the bucket's cover positions.

A plain modular cover would need about a fifth of all positions at this width
and would have to ship each; this one needs about an eighteenth, and most of
those prove unique by their gram alone.

Defined results: null is an empty text; texts under ``width`` bytes lose
nothing; matches never cross documents; documents of one id are not earlier
than each other; a null id is after all others; other columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.passages import Covers, Slice, _slices, covered, mixed, pack, repeated_starts

WIDTH = 50
GRAM = 16

_SYMBOL = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _SYMBOL[np.frombuffer(b"".join(texts), np.uint8)], np.cumsum([len(t) for t in texts], dtype=np.int64)


def _surroundings(width: int, gram: int):
    before = width - gram  # a window starts at most this far before its cover position
    span = before + width

    def describe(s: Slice, covers: Covers, chosen: np.ndarray):
        body = np.frombuffer(s.body, np.uint8)

        def rows(own: np.ndarray) -> np.ndarray:
            place = covers.at[own, None] + np.arange(-before, width)
            inside = (place >= covers.first[own, None]) & (place < (covers.first + covers.count + width - 1)[own, None])
            return np.where(inside, body[np.clip(place, 0, len(body) - 1)], 0).astype(np.uint8)

        # a 128-bit name of range and bytes, folded to numbers: equal keys stand for equal surroundings
        names = []
        for at in range(0, len(chosen), 1 << 15):
            own = chosen[at:at + (1 << 15)]
            some = np.concatenate([rows(own), np.stack([covers.at[own] - covers.first[own], covers.count[own]], 1).astype(np.uint8)], 1)
            names += [hashlib.blake2b(r, digest_size=16).digest() for r in some]
        name = np.frombuffer(b"".join(names), np.dtype("S16")) if names else np.zeros(0, "S16")
        return np.unique(name, return_inverse=True)[1].ravel(), lambda own: rows(own).tobytes()

    def ranks(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the rows and, for each in that order, the bytes it shares with the one before."""
        wide = -(-rows.shape[1] // 8) * 8
        keys = np.pad(rows, ((0, 0), (0, wide - rows.shape[1]))).view(">u8").astype(np.uint64)
        order = np.lexsort(keys.T[::-1])
        differ = rows[order][1:] != rows[order][:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        return order, np.concatenate([[-1], same])

    def judge(bodies: list[bytes], at: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        rows = np.concatenate([np.frombuffer(b, np.uint8).reshape(-1, span) for b in bodies])
        after, shared_after = ranks(rows[:, before:])
        back, shared_back = ranks(rows[:, :before][:, ::-1])
        far, n = at - first, len(rows)
        end = np.cumsum(count)
        out = np.zeros(end[-1], np.int64)
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        for d in range(before + 1):
            right[after] = np.cumsum(shared_after < width - d)
            left[back] = np.cumsum(shared_back < d)
            own = np.flatnonzero((far >= d) & (far - count < d))
            if len(own):
                out[(end - count)[own] + far[own] - d] = (d * (n + 1) + left[own]) * (n + 1) + right[own]
        return out

    return describe, judge


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM,
                   texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``texts`` also the kept bytes and the
    removed spans (begin, end)."""
    describe, judge = _surroundings(width, gram)
    found = repeated_starts(pack(docs, id_col, text_col), byte_symbols, 1, width, gram, describe, judge, within=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, replies in _slices(b):
                gone, body, begin, rows = covered(len(s.body), width, replies), np.frombuffer(s.body, np.uint8), 0, []
                for end, doc_id in zip(s.ends.tolist(), s.given, strict=True):
                    own = gone[begin:end]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).reshape(-1, 2)
                    kept = body[begin:end][~own].tobytes() if len(edge) else s.body[begin:end]
                    rows.append({"doc_id": doc_id, "n_bytes": end - begin, "n_removed": int(own.sum()), "n_spans": len(edge),
                                 "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept, "spans": edge.tolist()})
                    begin = end
                yield pa.RecordBatch.from_pylist(rows, schema)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))]
    schema = pa.schema(fields if texts else fields[:5])
    more = ", kept binary, spans array<array<long>>" if texts else ""
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more)
