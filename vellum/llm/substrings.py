"""Substring dedup of words by a compressed FM-index per shard (operator 8).

Every word covered by a window of ``width`` words whose sequence also starts
earlier (in a document with a smaller id, or earlier in the same document) is
removed; windows are judged on the input.

Shards hold content, not documents: ``passages`` deals the surroundings of
shared cover positions, so that all windows that could be equal meet in one
shard, and a document's windows are streamed only to the shards that can hold
them (with shards of documents every document would have to visit all shards).

A shard's index is the Burrows-Wheeler transform of its surroundings as a
wavelet matrix: one bit row per bit of the word number, packed, with sampled
counts in two levels (a quarter of the bits).  The surroundings are streamed
past it in blocks: for each place, backward search extends to the left, one word
a step for the whole block, until the interval is down to one row (its own) or
the surroundings begin.  That gives the matching statistics: the length of the
longest string ending there that occurs elsewhere too.  Where it reaches
``width``, the string is reported as an interval of repeated words; its last
window's class is the search's interval after ``width`` words, which equal
windows share.  Suffixes are sorted to the depth of the longest surroundings,
beyond which no search goes.

Defined results: null has no words; texts under ``width`` words lose nothing;
matches never cross documents; documents of one id are not earlier than each
other; a null id is after all others; other columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.passages import Covers, Slice, _slices, covered, pack, repeated_starts

WIDTH = 20
GRAM = 6
BLOCK = 1 << 12  # windows that are searched at a time: their state stays in the processor's cache


def word_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    from xxhash import xxh3_64_intdigest

    words = [t.split() for t in texts]
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(ends[-1]) if len(ends) else 0), ends


_ONE, _SIX, _TEN, _LOW = np.uint64(1), np.uint64(6), np.uint64(10), np.uint64(63)


class WaveletMatrix:
    """Counts of a symbol before a place, from one packed bit row per bit of the symbols.

    Set bits before a word of 64 are counted in two levels: from the row's
    begin for every 1,024th word, from there on in 16 bits for each word.
    """

    def __init__(self, symbols: np.ndarray, size: int):
        self.rows = []
        for b in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> b) & 1 == 1
            words = np.packbits(np.pad(bit, (0, 64 - len(bit) % 64)), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.uint64)
            far = before[::1 << 10]
            near = (before - far[np.arange(len(words)) >> 10]).astype(np.uint16)
            self.rows.append((np.uint64(b), words, far, near, np.uint64(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.base = self._down(np.arange(size, dtype=np.uint64), np.zeros(size, np.uint64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for b, words, far, near, zeros in self.rows:
            at = place >> _SIX
            ones = far.take(at >> _TEN) + near.take(at) + np.bitwise_count(words.take(at) & ((_ONE << (place & _LOW)) - _ONE))
            place = np.where((symbol >> b) & _ONE, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``place``."""
        return self._down(symbol, place) - self.base[symbol]


class FMIndex:
    """Of a text of numbers (0 parts its pieces), for patterns of up to ``depth`` numbers."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        n = len(text)
        rank, order, h = text.astype(np.int64), None, 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[:n - h] = rank[h:] + 1
            key = rank * (max(n, size) + 2) + ahead
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            h *= 2
            if h >= depth or new[-1] == n - 1:
                break
        self.n, self.matrix = n, WaveletMatrix(text[order - 1], size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]).astype(np.uint64)

    def statistics(self, numbers: np.ndarray, begin: np.ndarray, end: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of strings of ``numbers`` that end at ``end`` (included) and begin at ``begin`` at the earliest.

        For each end: the length of the longest such string that the index
        holds twice or more, and the first row of the interval of its last
        ``mark`` numbers (-1 where the length is below).
        """
        symbol = numbers[end].astype(np.uint64)
        low, high = self.smaller[symbol], self.smaller[symbol + _ONE]
        length, row = np.zeros(len(end), np.int64), np.full(len(end), -1, np.int64)
        live, done = np.arange(len(end)), 0
        while len(live):
            stay = high - low > 1
            live, low, high = live[stay], low[stay], high[stay]
            done += 1
            length[live] = done
            if done == mark:
                row[live] = low
            stay = end[live] - done >= begin[live]
            live, low, high = live[stay], low[stay], high[stay]
            symbol = numbers[end[live] - done].astype(np.uint64)
            both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = self.smaller[symbol] + both[:len(live)], self.smaller[symbol] + both[len(live):]
        return length, row


def _surroundings(width: int):
    def describe(s: Slice, covers: Covers, chosen: np.ndarray):
        words = list(chain.from_iterable(t.split() for t in s.texts))

        def piece(i: int) -> bytes:
            return b" ".join(words[covers.first[i]:covers.first[i] + covers.count[i] + width - 1])

        names = [hashlib.blake2b(piece(i), digest_size=16).digest() for i in chosen]
        name = np.frombuffer(b"".join(names), np.dtype("S16")) if names else np.zeros(0, "S16")
        return np.unique(name, return_inverse=True)[1].ravel(), lambda own: b"\n".join(map(piece, own))

    def judge(bodies: list[bytes], at: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        # equal surroundings have equal windows: each is indexed and searched once
        own: dict[bytes, int] = {}
        piece = np.array([own.setdefault(p, len(own)) for p in b"\n".join(bodies).split(b"\n")], np.int64)
        windows = np.empty(len(own), np.int64)
        windows[piece] = count
        number: dict[bytes, int] = {b"\n": 0}
        words = b" \n ".join(own).split(b" ")
        text = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        text = np.append(text, 0)
        index = FMIndex(text, len(number), int(windows.max()) + width - 1)
        begin = np.cumsum(windows + width) - (windows + width)
        head = np.cumsum(windows) - windows
        start = np.arange(windows.sum()) + np.repeat(begin - head, windows)
        first_word = np.repeat(begin, windows)
        kind = np.empty(len(start), np.int64)
        for k in range(0, len(start), BLOCK):
            some = start[k:k + BLOCK]
            length, row = index.statistics(text, first_word[k:k + BLOCK], some + width - 1, width)
            kind[k:k + BLOCK] = np.where(length >= width, row, -1 - some)
        return kind[np.arange(count.sum()) + np.repeat(head[piece] - (np.cumsum(count) - count), count)]

    return describe, judge


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM,
                   texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; with ``texts`` also the kept words and the removed
    spans of words (begin, end)."""
    describe, judge = _surroundings(width)
    found = repeated_starts(pack(docs, id_col, text_col), word_symbols, 6, width, gram, describe, judge, within=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, replies in _slices(b):
                sizes = [len(t.split()) for t in s.texts]
                gone, begin, rows = covered(sum(sizes), width, replies), 0, []
                for text, n, doc_id in zip(s.texts, sizes, s.given, strict=True):
                    own, words = gone[begin:begin + n], text.split()
                    if own.any():
                        words = [w for w, x in zip(words, own.tolist(), strict=True) if not x]
                    kept = b" ".join(words)
                    rows.append({"doc_id": doc_id, "n_words": n, "n_removed": int(own.sum()),
                                 "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept, "spans": np.flatnonzero(np.diff(
                                     np.concatenate([[0], own.astype(np.int8), [0]]))).reshape(-1, 2).tolist() if texts else []})
                    begin += n
                yield pa.RecordBatch.from_pylist(rows, schema)

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
              ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))]
    schema = pa.schema(fields if texts else fields[:4])
    more = ", kept binary, spans array<array<long>>" if texts else ""
    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + more)
