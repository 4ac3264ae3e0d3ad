"""Scores under a context-tree-weighting model of bytes (operator 13).

A text (A-Z lower-cased, UTF-8) is its bytes and an end symbol.  Each symbol is
nine binary decisions: whether the text ends, then the byte's bits from the
top, each decision a node of the byte's binary tree.  A node in the context of
the last d bytes (before a text's start stands a start symbol) has counts of
its zeros and ones over the training texts, and a Krichevsky-Trofimov estimate
from them.  Contexts of 0 to ``depth`` bytes form a tree; the weighted
probability of a node in a context is half its own estimate's and half the
product of its children's (one byte longer) weighted probabilities, at
``depth`` the estimate's alone.  Predictions so mix the estimates of all
depths by the evidence of the training texts, which fixes the weights; a text's
score is the log probability of its symbols, ``bits`` its code length.

On Spark: texts are taken in chunks of ``chunk_bytes``; a chunk names its
distinct grams (context and symbol) and words once, with their counts in
training texts.  These rows are summed by gram and by word.  A subtree of all
contexts that share their last two bytes is worked by one task, longest
contexts first and back again; what lies above, one row per last byte and node
(at most 257 x 256), is summed from the subtrees' roots and given to them.  Every
chunk gets the log probabilities of its own grams and the counts of its own
words back, ahead of its texts, in one sorted pass.  A gram that every text
holds is one row per chunk.

Memory: a chunk or one longer text; a run of subtrees, the largest of which
has at most 257 ^ (depth - 2) contexts.

The base score beside it is Laplace-smoothed word counts: the sum over a text's
words and one end token of log10((c + 1) / (N + V + 1)).

Defined results: a null text is empty: it has its end only, and
``bits_per_byte`` null; repeated rows and ids are texts of their own; a null id
counts as the empty text for the fold and comes out null; with no training texts
every decision has probability 1/2 and ``base_score`` is 0; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import byte_values, materialize, sized_chunks

DEPTH = 4
CHUNK_BYTES = 32 << 20
SLICE_BYTES = 1 << 20
RUN_GRAMS = 1 << 19
FOLDS, HELD_OUT = 7, 2

_BITS, _NODE, _MARK = 9, 8, 256  # bits of a symbol, of a node; the symbol of a text's start and end
_END_WORD = b"\n"  # no word holds it


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series above 8."""
    low = x < 8
    z = np.where(low, x + 8, x)
    series = 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7) + 1 / (1188 * z ** 9)
    out = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series
    y = x[low]
    out[low] -= np.log(y * (y + 1) * (y + 2) * (y + 3)) + np.log((y + 4) * (y + 5) * (y + 6) * (y + 7))
    return out


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)


def gram_codes(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, ends)``: a code for each symbol of each text, nearest context byte first, the symbol last."""
    mark = np.full(depth, _MARK, np.int64)
    parts = [p for t in texts for p in (mark, np.frombuffer(t, np.uint8).astype(np.int64), mark[:1])]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    line = np.concatenate(parts) if parts else mark[:0]
    codes = np.zeros(len(line), np.int64)
    for back in range(1, depth + 1):
        codes[back:] = (codes[back:] << _BITS) | line[:-back]
        codes[:back] = codes[:back] << _BITS
    codes = (codes << _BITS) | line
    ends = np.cumsum(sizes)
    inside = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(np.arange(1, len(sizes) + 1) * depth, sizes)
    return codes[inside], ends


class Subtrees:
    """The nodes of whole subtrees below contexts of two bytes, from their grams in order."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, depth: int):
        symbol, context = codes & ((1 << _BITS) - 1), codes >> _BITS
        byte = symbol < _MARK
        self.path = np.full((9, len(codes)), -1)
        self.ones = np.zeros((9, len(codes)), bool)
        keys, size = [], 0
        zeros, ones = [], []
        for level in range(9):
            at = slice(None) if level == 0 else byte
            s = symbol[at]
            one = s == _MARK if level == 0 else (s >> (8 - level)) & 1 == 1
            node = np.zeros(len(s), np.int64) if level == 0 else (1 << (level - 1)) | (s >> (9 - level))
            key = (context[at] << _NODE) | node  # in order: grams are sorted by context and symbol
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            own = np.cumsum(first) - 1
            self.path[level, at], self.ones[level, at] = own + size, one
            keys.append(key[first])
            size += len(keys[-1])
            zeros.append(np.bincount(own, np.where(one, 0, n[at]), len(keys[-1])))
            ones.append(np.bincount(own, np.where(one, n[at], 0), len(keys[-1])))
        key, n0, n1 = (np.concatenate(x) for x in (keys, zeros, ones))
        own = kt_log(n0, n1)
        self.levels = [(None, n0, n1, own, own)]  # from the longest contexts up
        for _ in range(depth - 2):
            key, up = np.unique(((key >> (_NODE + _BITS)) << _NODE) | (key & ((1 << _NODE) - 1)), return_inverse=True)
            below = self.levels[-1]
            n0, n1, product = (np.bincount(up, x, len(key)) for x in (below[1], below[2], below[4]))
            own = kt_log(n0, n1)
            self.levels.append((up, n0, n1, own, np.logaddexp(own, product) - np.log(2)))
        self.key = key

    def roots(self) -> pa.RecordBatch:
        _, n0, n1, _, weighted = self.levels[-1]
        last, node = self.key >> (_NODE + _BITS), self.key & ((1 << _NODE) - 1)
        return pa.RecordBatch.from_arrays([pa.array(last), pa.array(node), pa.array(n0), pa.array(n1), pa.array(weighted)],
                                          names=["last", "node", "n0", "n1", "weighted"])

    def gram_logs(self, top: np.ndarray) -> np.ndarray:
        """Each gram's log probability; ``top`` as from ``top_mixture``."""
        place = ((self.key >> (_NODE + _BITS)) << _NODE) | (self.key & ((1 << _NODE) - 1))
        mixed = top[:, place]
        for i in range(len(self.levels) - 1, -1, -1):
            _, n0, n1, own, weighted = self.levels[i]
            mixed = mix_in(mixed, n0, n1, own, weighted, i == 0)
            if i:
                mixed = mixed[:, self.levels[i][0]]  # a parent's to each of its children
        logs = np.log(np.where(self.ones, mixed[1][self.path], mixed[0][self.path]))
        logs[self.path < 0] = 0
        return logs.sum(axis=0)


def mix_in(mixed: np.ndarray, n0: np.ndarray, n1: np.ndarray, own: np.ndarray, weighted: np.ndarray, deepest: bool) -> np.ndarray:
    """``(zero, one, rest)`` with one more depth: what the shorter contexts gave, and the weight left to longer ones."""
    share = np.ones(len(n0)) if deepest else np.exp(own - weighted - np.log(2))
    zero, one, rest = mixed
    total = n0 + n1 + 1
    return np.stack([zero + rest * share * ((n0 + 0.5) / total), one + rest * share * ((n1 + 0.5) / total), rest * (1 - share)])


def top_mixture(rows: pd.DataFrame) -> np.ndarray:
    """The mixture over contexts of no and one byte at ``last << 8 | node``, from the sums of the roots below each."""
    size = (_MARK + 1) << _NODE
    place = (rows["last"].to_numpy(np.int64) << _NODE) | rows["node"].to_numpy(np.int64)
    n0, n1, product = (np.bincount(place, rows[c].to_numpy(float), size) for c in ("n0", "n1", "weighted"))
    own = kt_log(n0, n1)
    weighted = np.logaddexp(own, product) - np.log(2)
    node = np.arange(size) & ((1 << _NODE) - 1)
    r0, r1, root_product = (np.bincount(node, x, 1 << _NODE) for x in (n0, n1, weighted))
    root_own = kt_log(r0, r1)
    root = mix_in(np.stack([np.zeros(1 << _NODE), np.zeros(1 << _NODE), np.ones(1 << _NODE)]), r0, r1, root_own,
                  np.logaddexp(root_own, root_product) - np.log(2), False)
    return mix_in(root[:, node], n0, n1, own, weighted, False)


def _chunked(docs: DataFrame, id_col: str, text_col: str, held_out: Column, depth: int, chunk_bytes: int) -> DataFrame:
    """The first pass: one row per text, and one per chunk with its distinct grams and words and their counts in training texts."""
    given = docs.select(F.spark_partition_id().cast("long").alias("task"), F.col(id_col).alias("doc_id"), held_out.alias("held_out"),
                        F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("kind", T.LongType()), given.schema["doc_id"],
                           T.StructField("held_out", T.BooleanType()), T.StructField("text", T.BinaryType()),
                           T.StructField("grams", T.BinaryType()), T.StructField("grams_n", T.BinaryType()),
                           T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("words_n", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for c in sized_chunks(batches, 3, chunk_bytes):
            chunk, seen = (c.column(0)[0].as_py() << 32) + seen, seen + 1
            parts: dict[bool, list] = {False: [], True: []}
            words: Counter = Counter()
            for s in sized_chunks([c], 3, SLICE_BYTES):
                texts, out = [t.lower() for t in byte_values(s.column(3))], s.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(texts), chunk)), pa.array(np.full(len(texts), 2)), s.column(1), s.column(2),
                    pa.array(texts, pa.binary()), *(pa.nulls(len(texts), f) for f in (pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary()))],
                    names=schema.names)
                for held in (False, True):
                    mine = [t for t, h in zip(texts, out, strict=True) if h == held]
                    parts[held].append(np.unique(gram_codes(mine, depth)[0], return_counts=True))
                    for t in mine:
                        own = t.split()
                        own.append(_END_WORD)
                        if held:
                            words.update(dict.fromkeys(own, 0))
                        else:
                            words.update(own)
            codes = np.concatenate([p[0] for held in (False, True) for p in parts[held]])
            n = np.concatenate([p[1] * (not held) for held in (False, True) for p in parts[held]])
            grams, own = np.unique(codes, return_inverse=True)
            nulls = [pa.nulls(1, t) for t in (c.column(1).type, pa.bool_(), pa.binary())]
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk]), pa.array([0]), *nulls, pa.array([grams.tobytes()]),
                pa.array([np.bincount(own, n, len(grams)).astype(np.int64).tobytes()]),
                pa.array([list(words)], pa.list_(pa.binary())), pa.array([np.fromiter(words.values(), np.int64, len(words)).tobytes()])],
                names=schema.names)

    return given.mapInArrow(run, schema)


def _rows(chunks: DataFrame, column: str, kind: str) -> DataFrame:
    """``chunk, <column>, n``: the distinct grams or words of each chunk as rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = pa.array(np.frombuffer(b.column(2)[i].as_py(), np.int64))
                value = b.column(1).slice(i, 1).flatten() if kind == "binary" else pa.array(np.frombuffer(b.column(1)[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), b.column(0)[i].as_py())), value, n], names=["chunk", column, "n"])

    return (chunks.filter("kind = 0").select("chunk", f"{column}s", f"{column}s_n")
            .mapInArrow(run, f"chunk long, {column} {kind}, n long"))


def _subtrees(counts: DataFrame, depth: int, run_grams: int, out, schema: str) -> DataFrame:
    """``out(codes, Subtrees)`` over runs of whole subtrees, each worked by one task."""
    below = _BITS * (depth - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            codes, n = np.concatenate([codes, b.column(0).to_numpy()]), np.concatenate([n, b.column(1).to_numpy()])
            if len(codes) >= run_grams:
                cut = int(np.searchsorted(codes, codes[-1] >> below << below))
                if cut:
                    yield out(codes[:cut], Subtrees(codes[:cut], n[:cut], depth))
                    codes, n = codes[cut:], n[cut:]
        if len(codes):
            yield out(codes, Subtrees(codes, n, depth))

    return (counts.repartition(F.shiftrightunsigned("gram", below)).sortWithinPartitions("gram").select("gram", "n").mapInArrow(run, schema))


def gram_logs(counts: DataFrame, depth: int = DEPTH, run_grams: int = RUN_GRAMS) -> DataFrame:
    """``gram, log``: the model's log probability of each gram's symbol in its context, from ``gram, n`` (n may be 0)."""
    roots = _subtrees(counts, depth, run_grams, lambda codes, tree: tree.roots(),
                      "last long, node long, n0 double, n1 double, weighted double")
    sums = roots.groupBy("last", "node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "weighted")))
    top = top_mixture(sums.toPandas())  # at most 257 x 256 rows
    return _subtrees(counts, depth, run_grams, lambda codes, tree: pa.RecordBatch.from_arrays(
        [pa.array(codes), pa.array(tree.gram_logs(top))], names=["gram", "log"]), "gram long, log double")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held: int = HELD_OUT,
                depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES, run_grams: int = RUN_GRAMS) -> DataFrame:
    """One row per text: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, bits_per_byte``.

    Texts whose ``crc32`` of the id as text leaves ``held`` modulo ``folds`` are held out of
    training.  ``score`` is log10 of the text's probability, ``bits`` its code length.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6: a gram is held in 63 bits")
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held
    chunks = materialize(_chunked(docs, id_col, text_col, held_out, depth, chunk_bytes), "weighting-chunks", "zstd")
    grams, words = _rows(chunks, "gram", "long"), _rows(chunks, "word", "binary")
    counts = materialize(grams.groupBy("gram").agg(F.sum("n").alias("n")), "weighting-grams")
    vocabulary = materialize(words.groupBy("word").agg(F.sum("n").alias("count")), "weighting-words")
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > 0)).first()
    floor = float(np.log10(tokens + distinct + 1))
    logs = materialize(gram_logs(counts, depth, run_grams), "weighting-logs")
    known = (grams.join(logs, "gram").select("chunk", F.lit(0).cast("long").alias("kind"), "gram", "log")
             .unionByName(words.join(vocabulary, "word").select("chunk", F.lit(1).cast("long").alias("kind"), "word", "count"),
                          allowMissingColumns=True))
    both = known.unionByName(chunks.filter("kind = 2").select("chunk", "kind", "doc_id", "held_out", "text"), allowMissingColumns=True)
    both = both.select("chunk", "kind", "gram", "log", "word", "count", "text", "doc_id", "held_out")
    schema = T.StructType([*both.schema.fields[7:], *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
                           *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "bits", "bits_per_byte"))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grams, logs, index, seen = None, [], [], None, {}
        for batch in batches:
            place = batch.column(0).to_numpy() * 4 + batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1), len(place)]
            for at, to in zip(edges, edges[1:]):
                if at == to:
                    continue
                chunk, kind = divmod(int(place[at]), 4)
                if chunk != now:
                    now, grams, logs, index, seen = chunk, [], [], None, {}
                mine = batch.slice(at, to - at)
                if kind == 0:
                    grams.append(mine.column(2).to_numpy())
                    logs.append(mine.column(3).to_numpy())
                elif kind == 1:
                    seen.update(zip(mine.column(4).to_pylist(), mine.column(5).to_pylist(), strict=True))
                else:
                    if index is None:
                        index, log = pd.Index(np.concatenate(grams)), np.concatenate(logs)
                        grams, logs = [], []
                    for s in sized_chunks([mine], 6, SLICE_BYTES):
                        yield scored(s, index, log, seen)

    def scored(s: pa.RecordBatch, index: pd.Index, log: np.ndarray, seen: dict) -> pa.RecordBatch:
        texts = byte_values(s.column(6))
        codes, ends = gram_codes(texts, depth)
        nats = np.add.reduceat(log[index.get_indexer(codes)], np.concatenate(([0], ends[:-1])))
        n_tokens, n_known, base = [], [], []
        for t in texts:
            own = t.split()
            own.append(_END_WORD)
            c = np.fromiter(map(seen.__getitem__, own), np.int64, len(own))
            n_tokens.append(len(own))
            n_known.append(int((c > 0).sum()))
            base.append(float(np.log10(c + 1).sum()) - len(own) * floor)
        size = np.array([len(t) for t in texts], float)
        bits = -nats / np.log(2)
        rows = len(texts)
        return pa.RecordBatch.from_arrays([
            s.column(7), s.column(8), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
            pa.array(np.full(rows, tokens, np.int64)), pa.array(base, pa.float64()), pa.array(nats / np.log(10)), pa.array(bits),
            pa.array(np.where(size > 0, bits / np.maximum(size, 1), 0), mask=size == 0)], names=schema.names)

    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(finish, schema)
