"""Alignment of two tokenizers' tokens over the same texts (operator 12).

A text's tokens A and B are two partitions of the same bytes.  Where a token
of either ends at the same byte, the text can be cut; the pieces between
neighbouring cuts are the groups.  They are found by divide and conquer: in an
interval whose two ends are shared, the shared end nearest the middle token of
A is looked for (each candidate by bisection among B's ends, in rings of
doubling radius around the middle), and both halves are searched in turn; an
interval without a cut inside is a group.  All open intervals of all texts of
a chunk are handled together, level by level.

Neither tokenizer's tokens reach over the place between a printable ASCII
character and a space, and what lies on one side has no say in the tokens of
the other (true for this pattern and for BPE models whose pieces don't hold
such a place; other files' texts are not cut).  So these places are shared
ends from the start, and a chunk's texts are rows of words: each distinct word
of a chunk is tokenized, cut into groups and linked once, and texts take their
words' tokens, groups and links.

Inside a text an A and a B token are linked where their byte ranges overlap.
The count of an id pair is the number of its links in the whole corpus.  Texts
are taken in chunks of ``chunk_bytes``; a chunk names its distinct pairs once,
so that pairs are counted by (chunk, pair) and not by link, and every chunk
gets the corpus counts of its own pairs back, ahead of its texts, in one
sorted pass.  A pair that every text holds is one row per chunk.

Memory: one chunk, or one longer text, per task.  Tokenizers are files that
each executor opens once (``a_file`` a byte-level BPE of ``tokenizers``,
``b_file`` a ``sentencepiece`` model).  A's file is run by ``tiktoken`` where its
merges are in id order, which is the form that library takes, else by
``tokenizers``.

Defined results: null and empty texts, and those that either tokenizer does
not give back byte by byte, have no tokens: zeros and an empty ``groups``;
repeated rows and repeated ids are texts of their own, each counted; null ids
pass; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import byte_values, materialize, sized_chunks

CHUNK_BYTES = 4 << 20
#: distinct words are tokenized this many bytes at a time
GROUP_BITS = 12
FOLDER = "/opt/tokenizers"
#: fixed value: the pre-tokenization pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's characters: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _cuttable(names: list[bytes]) -> bool:
    """No token holds a printable ASCII character with a space after it."""
    return not any(re.search(rb"[!-~] ", x) for x in names)


@lru_cache(maxsize=4)
def byte_level_bpe(path: str) -> tuple[Callable[[str], np.ndarray], list[bytes], bool]:
    """``(encode, bytes of each id, words are independent)`` of a byte-level BPE file; special tokens' strings are plain text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
    special = {t["id"] for t in spec["added_tokens"]}
    names = [b""] * (1 + max([*vocab.values(), *special]))
    for token, i in vocab.items():
        if i not in special:
            names[i] = bytes(alphabet[c] for c in token)
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    in_order = all(vocab["".join(m)] == 256 + i for i, m in enumerate(merges))
    kind = spec["pre_tokenizer"]
    if in_order and spec["normalizer"] is None and kind["type"] == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"]:
        import tiktoken

        ranks = {name: i for i, name in enumerate(names) if name}
        enc = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: enc.encode_to_numpy(text, disallowed_special=()).astype(np.int64), names, _cuttable(names)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.int64), names, False


def _plain_bpe(path: str) -> bool:
    """A sentencepiece model that is a BPE and changes nothing but the space it puts in front."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False
    with open(path, "rb") as f:
        spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    how, kind = spec.normalizer_spec, spec.trainer_spec
    return (kind.model_type == kind.BPE and not kind.treat_whitespace_as_suffix and how.add_dummy_prefix
            and how.escape_whitespaces and not how.remove_extra_whitespaces and not how.precompiled_charsmap)


@lru_cache(maxsize=4)
def piece_model(path: str) -> tuple[Callable[[str], np.ndarray], list[bytes], bool]:
    """``(encode, bytes of each id, words are independent)`` of a sentencepiece model; pieces that hold no bytes (control, unknown) are empty."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            names.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            names.append(b"")
        else:
            names.append(piece.replace("▁", " ").encode())
    return lambda text: np.array(sp.encode(text), np.int64), names, _plain_bpe(path) and _cuttable(names)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``count[i]`` of them, for every i in turn."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def leaf_groups(a_ends: np.ndarray, b_ends: np.ndarray, a_to: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(a, b)``: for each group, in order, the numbers of A and B tokens up to its end.

    ``a_ends`` and ``b_ends`` are rising byte offsets; text t holds the tokens before
    ``a_to[t]``, ``b_to[t]`` and after the text before it, and ends at a shared byte.
    """
    todo = np.stack([np.concatenate(([0], a_to))[:-1], a_to, np.concatenate(([0], b_to))[:-1], b_to]).astype(np.int64)
    leaves = []
    while todo.shape[1]:
        a0, a1, b0, b1 = todo
        middle = (a0 + a1 - 1) // 2  # the ends of a0 .. a1 - 2 lie inside
        cut_a = np.full(len(a0), -1)
        cut_b = np.full(len(a0), -1)
        open_ = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
        near, far = 0, 1
        while len(open_):
            m, low, high = middle[open_], a0[open_], a1[open_] - 2
            right, right_to = np.minimum(m + near, high + 1), np.minimum(m + far, high + 1)
            left, left_to = np.maximum(m - far + 1, low), np.maximum(m - max(near, 1) + 1, low)
            n_right, n_left = right_to - right, left_to - left
            at = _ranges(np.stack([right, left], 1).ravel(), np.stack([n_right, n_left], 1).ravel())
            owner = np.repeat(np.arange(len(open_)), n_right + n_left)
            place = np.searchsorted(b_ends, a_ends[at])
            hit = np.flatnonzero(b_ends[np.minimum(place, len(b_ends) - 1)] == a_ends[at])
            order = hit[np.lexsort((np.abs(at[hit] - m[owner[hit]]), owner[hit]))]
            found, first = np.unique(owner[order], return_index=True)
            cut_a[open_[found]], cut_b[open_[found]] = at[order[first]] + 1, place[order[first]] + 1
            more = (cut_a[open_] < 0) & ((m + far <= high) | (m - far >= low))
            open_ = open_[more]
            near, far = far, 2 * far
        whole = cut_a < 0
        leaves.append(todo[1::2, whole])
        split = ~whole
        ca, cb = cut_a[split], cut_b[split]
        todo = np.concatenate([np.stack([a0[split], ca, b0[split], cb]), np.stack([ca, a1[split], cb, b1[split]])], axis=1)
    a, b = np.concatenate(leaves, axis=1) if leaves else np.zeros((2, 0), np.int64)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token pairs ``(a, b)`` whose byte ranges overlap, by a and then b."""
    starts = np.concatenate(([0], a_ends))[:-1]
    first, last = np.searchsorted(b_ends, starts, "right"), np.searchsorted(b_ends, a_ends, "left")
    count = last - first + 1
    return np.repeat(np.arange(len(a_ends)), count), _ranges(first, count)


class _Writer:
    """Token ids as text: a table of every id with each thing that can follow it."""

    def __init__(self, size_a: int, size_b: int):
        self.size_a, self.size_b = size_a, size_b
        a, b = [b"%d" % i for i in range(size_a)], [b"%d" % i for i in range(size_b)]
        self.table = [x + c for ids, follow in ((a, b",|"), (b, b",;")) for c in (bytes([f]) for f in follow) for x in ids]
        self.length = np.array([len(x) for x in self.table], np.int64)

    def write(self, a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Groups, each with the ';' behind it, from the ids and the groups' ends among them; cut where so many ids have come."""
        code_a, code_b = a.copy(), b + 2 * self.size_a
        code_a[a_to - 1] += self.size_a
        code_b[b_to - 1] += self.size_b
        a_from, b_from = np.concatenate(([0], a_to))[:-1], np.concatenate(([0], b_to))[:-1]
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(b_from, a_to - a_from)] = code_a
        out[np.arange(len(b)) + np.repeat(a_to, b_to - b_from)] = code_b
        text = b"".join(map(self.table.__getitem__, out.tolist()))
        to = np.concatenate(([0], np.cumsum(self.length[out])))[ends].tolist()
        return [text[i:j] for i, j in zip([0, *to], to)]


def _ids(text: bytes, tok_a, tok_b) -> tuple[np.ndarray, np.ndarray] | None:
    """The ids of a text that starts with a space, if both tokenizers give it back byte by byte."""
    (encode_a, names_a, _), (encode_b, names_b, _) = tok_a, tok_b
    plain = text.decode()
    a, b = encode_a(plain), encode_b(plain[1:])
    same = b"".join(map(names_a.__getitem__, a.tolist())) == b"".join(map(names_b.__getitem__, b.tolist())) == text
    return (a, b) if same else None


def _words(texts: list[bytes], cut: bool) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """``(word, to, groups, count)``: the texts as distinct words' numbers, where each text's end, and the words
    by number, in groups that can be tokenized as one text each, with their lengths.

    A word that ends in a printable ASCII character can have another behind it; any other is a group by itself.
    """
    raw = b"".join(b" " + x for x in texts if x)
    begins = np.cumsum([0, *(len(x) + 1 for x in texts if x)])[:-1]
    data = np.frombuffer(raw, np.uint8)
    printable = (data > 0x20) & (data < 0x7F)
    first = np.zeros(len(raw), bool)
    if cut:
        first[1:] = (data[1:] == 0x20) & printable[:-1]
    first[begins] = True
    starts = np.flatnonzero(first)
    to = np.searchsorted(starts, np.cumsum([len(x) + 1 if x else 0 for x in texts]))
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
    ends = np.append(starts, len(raw))[1:]
    word = found.indices.to_numpy()
    open_ = np.zeros(len(found.dictionary), bool)
    open_[word] = ~printable[ends - 1] | (not cut)
    order = np.argsort(open_, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ordered = found.dictionary.take(pa.array(order, pa.int64()))
    size = pa.compute.binary_length(ordered).to_numpy()
    at, alone = np.cumsum(size), np.sort(open_)
    own = np.where(alone, np.arange(len(order)) + len(raw), (at - 1) >> GROUP_BITS)
    last = np.flatnonzero(np.append(own[1:] != own[:-1], True)) if len(own) else own
    joined = b"".join(ordered.to_pylist())
    bounds = [0, *at[last].tolist()]
    return place[word], to, [joined[i:j] for i, j in zip(bounds, bounds[1:])], size


def _tokenized(texts: list[bytes], tok_a, tok_b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(word, to, a, b, ends)``: the texts as numbers of entries (distinct words, mostly), where each text's end,
    the ids of all entries, and the entries' ends in bytes.  What has no tokens is an entry of no bytes."""
    word, to, groups, size = _words(texts, tok_a[2] and tok_b[2])
    parts, at, bad = [], 0, np.zeros(len(size) + 1, bool)
    place = np.concatenate(([0], np.cumsum(size)))
    for group in groups:
        here = int(np.searchsorted(place, at))
        at += len(group)
        there = int(np.searchsorted(place, at))
        ids = _ids(group, tok_a, tok_b)
        if ids is not None:
            parts.append(ids)
            continue
        for i in range(here, there):
            start = int(place[i]) - at + len(group)
            ids = _ids(group[start:start + int(size[i])], tok_a, tok_b) if there - here > 1 else None
            bad[i] = ids is None
            parts += [ids] * (not bad[i])
    nothing = len(size)
    size = [np.where(bad[:-1], 0, size), [0]]
    if bad.any():  # a text with such a word is one entry, as a whole
        hit = np.concatenate(([0], np.cumsum(bad[word])))
        begin = np.concatenate(([0], to[:-1]))
        for t in np.flatnonzero(hit[to] > hit[begin]).tolist():
            ids = _ids(b" " + texts[t], tok_a, tok_b)
            word[begin[t]:to[t]] = nothing
            if ids is not None:
                word[begin[t]] = nothing + len(size) - 1
                parts.append(ids)
                size.append([len(texts[t]) + 1])
    a, b = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
    return word, to, a, b, np.cumsum(np.concatenate(size))


def _aligned(given: DataFrame, a_file: str, b_file: str, chunk_bytes: int, digest: bool) -> DataFrame:
    """The first pass: one row per document (``own``: its links by the chunk's numbers of pairs) and one per chunk (its pairs)."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("is_doc", T.BooleanType()), given.schema["doc_id"],
                           *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                           T.StructField("groups", T.StringType()), T.StructField("own", T.BinaryType()), T.StructField("own_n", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        tok_a, tok_b = byte_level_bpe(a_file), piece_model(b_file)
        len_a, len_b = (np.array([len(x) for x in t[1]], np.int64) for t in (tok_a, tok_b))
        writer, seen = _Writer(len(len_a), len(len_b)), 0
        for c in sized_chunks(batches, 2, chunk_bytes):
            word, to, a, b, ends = _tokenized(byte_values(c.column(2)), tok_a, tok_b)
            chunk, seen = (c.column(0)[0].as_py() << 32) + seen, seen + 1
            a_ends, b_ends = np.cumsum(len_a[a]), np.cumsum(len_b[b])
            a_to, b_to = np.searchsorted(a_ends, ends, "right"), np.searchsorted(b_ends, ends, "right")
            full = np.diff(a_to, prepend=0) > 0
            ga, gb = leaf_groups(a_ends, b_ends, a_to[full], b_to[full])
            g_to = np.searchsorted(ga, a_to, "right")
            la, lb = overlaps(a_ends, b_ends)
            l_to = np.searchsorted(la, a_to, "left")
            pairs, number = np.unique(a[la] * len(len_b) + b[lb], return_inverse=True)
            written = writer.write(a, b, ga, gb, a_to + b_to)
            links = number[_ranges(np.concatenate(([0], l_to))[word], np.diff(l_to, prepend=0)[word])]
            # a text's figures are sums over its words
            n_a, n_b, n_g, n_l = (np.diff(np.concatenate(([0], np.cumsum(np.diff(x, prepend=0)[word])))[to], prepend=0)
                                  for x in (a_to, b_to, g_to, l_to))
            texts, own, own_n, w, at = [], [], [], 0, 0
            for end, n in zip(to.tolist(), n_l.tolist()):
                text = b"".join(map(written.__getitem__, word[w:end].tolist()))[:-1]
                texts.append(sha256(text).hexdigest() if digest and text else text.decode())
                some, times = np.unique(links[at:at + n], return_counts=True)
                own.append(some.astype(np.int32).tobytes())
                own_n.append(times.astype(np.int32).tobytes())
                w, at = end, at + n
            rows = len(to)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(rows, chunk)), pa.array([True] * rows), c.column(1), pa.array(n_a), pa.array(n_b), pa.array(n_g),
                pa.array(n_l), pa.array(texts, pa.string()), pa.array(own, pa.binary()), pa.array(own_n, pa.binary())], names=schema.names)
            nulls = [pa.nulls(1, t) for t in (c.column(1).type, *[pa.int64()] * 4, pa.string())]
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk]), pa.array([False]), *nulls, pa.array([pairs.tobytes()]),
                pa.array([np.bincount(links, minlength=len(pairs)).astype(np.int64).tobytes()])], names=schema.names)

    return given.mapInArrow(run, schema)


def _pairs(chunks: DataFrame) -> DataFrame:
    """``chunk, place, pair, n``: each chunk's distinct pairs, by their number in the chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, pairs, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pairs, n = np.frombuffer(pairs, np.int64), np.frombuffer(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), chunk)), pa.array(np.arange(len(n))), pa.array(pairs),
                                                  pa.array(n)], names=["chunk", "place", "pair", "n"])

    return chunks.filter("not is_doc").select("chunk", "own", "own_n").mapInArrow(run, "chunk long, place long, pair long, n long")


def align(docs: DataFrame, a_file: str = f"{FOLDER}/byte_bpe_50k.json", b_file: str = f"{FOLDER}/piece_bpe_32k.model",
          id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, digest: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum``.

    ``groups`` lists the groups as ``a1,a2|b1;a3|b2,b3`` (ids of A, then of B), or with
    ``digest`` that text's SHA-256.  ``n_best``: links whose pair has the highest count of
    all pairs of its B id; ``count_sum``: the sum of the counts over all links.
    """
    given = docs.select(F.spark_partition_id().cast("long").alias("task"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chunks = materialize(_aligned(given, a_file, b_file, chunk_bytes, digest), "alignment")
    size_b = F.lit(len(piece_model(b_file)[1]))
    pairs = _pairs(chunks)
    counts = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("n_pair")), "alignment-counts")
    best = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n_pair").alias("most"))  # a row per B id: bounded by the vocabulary
    ranked = counts.join(F.broadcast(best), F.col("pair") % size_b == F.col("b")).select(
        "pair", "n_pair", (F.col("n_pair") == F.col("most")).alias("is_best"))
    known = pairs.join(ranked, "pair").select("chunk", F.lit(False).alias("is_doc"), "place", "n_pair", "is_best")
    counted = ["n_a", "n_b", "n_groups", "n_links"]
    both = known.unionByName(chunks.filter("is_doc").select("chunk", "is_doc", "doc_id", *counted, "groups", "own", "own_n"),
                             allowMissingColumns=True)
    both = both.select("chunk", "is_doc", "place", "n_pair", "is_best", "own", "own_n", "doc_id", *counted, "groups")
    schema = T.StructType([*both.schema.fields[7:], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, n_pair, is_best = None, [], None, None
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1), len(chunk)]
            for at, to in zip(edges, edges[1:]):
                run = batch.slice(at, to - at)
                if to > at and chunk[at] != now:
                    now, parts, n_pair = chunk[at], [], None
                docs_from = int(np.searchsorted(run.column(1).to_numpy(zero_copy_only=False), True))
                if docs_from:
                    parts.append((run.column(3).slice(0, docs_from).to_numpy(), run.column(4).slice(0, docs_from).to_numpy(zero_copy_only=False)))
                if docs_from == run.num_rows:
                    continue
                if n_pair is None:
                    n_pair, is_best = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
                mine, most, total = run.slice(docs_from), [], []
                for own, n in zip(mine.column(5).to_pylist(), mine.column(6).to_pylist(), strict=True):
                    own, n = np.frombuffer(own, np.int32), np.frombuffer(n, np.int32).astype(np.int64)
                    most.append(int(n[is_best[own].astype(bool)].sum()))
                    total.append(int((n * n_pair[own]).sum()))
                yield pa.RecordBatch.from_arrays([*mine.columns[7:], pa.array(most, pa.int64()), pa.array(total, pa.int64())], names=schema.names)

    return both.repartition("chunk").sortWithinPartitions("chunk", "is_doc", "place").mapInArrow(finish, schema)
