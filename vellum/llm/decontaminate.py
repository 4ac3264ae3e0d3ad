"""Benchmark decontamination by a distributed positional inverted index (operator 6).

1. ``build_index``: one pass over the documents.  Runs of documents form
   shards of bounded size; a shard is one row of the index: its documents and
   the sorted postings (term, position) of all terms that occur in the tests.
   The index is written to the shared folder.
2. Corpus counts of the test terms come from the index, over all shards.
3. ``find``: per shard, all windows of a block of tests at once.  A window's
   postings lists are taken from its rarest term (in the whole corpus, ties by
   place in the window) to its commonest; each is shifted by the term's offset
   and intersected with the starts that are left.  Starts that survive exactly
   are phrase matches; starts where the rarest term is in its place and every
   other lies within ``slack`` words of its own, not all in place, are
   proximity matches.  Either lies wholly in one document: documents of a shard
   are ``slack`` positions apart.

The tests are taken in blocks of ``block_words`` words, which bounds the windows
sent to the tasks (a single longer item is a block of its own).  The documents
are read once for all blocks: the index holds the terms of them all, and each
block searches it.  Only where the tests have more than ``max_terms`` distinct
terms, which bounds the dictionary sent to the tasks, does a further index
follow for the blocks beyond (a block's terms stay together).

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lowered.
A window is ``window`` consecutive words of an item, or the whole item if it
has fewer.

Defined results: a null or empty text has no words and no matches; an item
without words has no windows; a null item id hits but isn't listed; rows that
repeat are documents of their own; items of one id count once; other columns
are ignored; an empty benchmark leaves all documents clean, empty documents
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from vellum.llm.common import byte_values, materialize, slices, with_prefix

WINDOW = 10
SLACK = 2
BLOCK_WORDS = 250_000
SHARD_WORDS = 500_000
MAX_TERMS = 2_000_000

#: what is no word character becomes a space, A-Z become a-z
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Tests:
    """The windows of one block of items, as arrays that are sent to the tasks."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, term: dict[bytes, int]):
        rows, self.item, length = [], [], []
        for item, text in items:
            ids = [term[w] for w in words_of(text)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                rows.append(ids[i:i + n] + [-1] * (window - n))
                self.item.append(item)
                length.append(n)
        self.terms = np.array(rows, np.int64).reshape(-1, window)
        self.length = np.array(length, np.int64)

    def rank(self, counts: np.ndarray) -> None:
        """Order each window's offsets from the rarest term to the commonest; drop windows with a term that never occurs."""
        often = np.where(self.terms >= 0, counts[self.terms], np.iinfo(np.int64).max)
        there = np.flatnonzero((often > 0).all(axis=1)) if len(often) else np.zeros(0, np.int64)
        self.offsets = np.argsort(often[there], axis=1, kind="stable")
        self.terms = np.take_along_axis(self.terms[there], self.offsets, 1)
        self.length, self.item = self.length[there], [self.item[i] for i in there]


def build_index(docs: DataFrame, term: dict[bytes, int], gap: int = SLACK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard from ``key, doc_id, text``: its documents, its terms, how often each occurs, and where, term by term.

    Positions run through a shard's documents with ``gap`` free ones after each.
    """
    columns = (T.StructType().add("docs", T.ArrayType(T.StructType().add("key", T.LongType()).add("n_words", T.LongType())
                                                      .add("doc_id", docs.schema["doc_id"].dataType)))
               .add("terms", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.IntegerType()))
               .add("positions", T.BinaryType()))
    known = docs.sparkSession.sparkContext.broadcast(term)

    def shard(docs: list[dict], ids: list[np.ndarray]) -> dict:
        flat = np.concatenate(ids)
        at = np.flatnonzero(flat >= 0)
        order = np.argsort(flat[at], kind="stable")
        terms, counts = np.unique(flat[at], return_counts=True)
        return {"docs": docs, "terms": terms, "counts": counts.astype(np.int32),
                "positions": at[order].astype(np.int32).tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, own, ids, held = known.value.get, [], [], 0
        schema = None
        for b in slices(batches):
            doc = pa.struct([("key", pa.int64()), ("n_words", pa.int64()), ("doc_id", b.column(1).type)])
            schema = pa.schema([("docs", pa.list_(doc)), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())),
                                ("positions", pa.binary())])
            for key, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_values(b.column(2)), strict=True):
                words = words_of(text)
                own.append({"key": key, "n_words": len(words), "doc_id": doc_id})
                found = np.full(len(words) + gap, -1, np.int32)
                found[:len(words)] = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                ids.append(found)
                held += len(words) + 1
                if held >= shard_words:
                    yield pa.RecordBatch.from_pylist([shard(own, ids)], schema)
                    own, ids, held = [], [], 0
        if own:
            yield pa.RecordBatch.from_pylist([shard(own, ids)], schema)

    return materialize(docs.select("key", "doc_id", "text").mapInArrow(run, columns), "positional-index")


def intersect(tests: Tests, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, slack: int,
              most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``window, start, exact`` of one shard's matches, windows in runs of about ``most`` starts."""
    if not len(terms) or not len(tests.length):
        return
    span = np.int64(positions.max()) + 2 * tests.terms.shape[1] + 2 * slack + 2  # so that lists of two terms never touch
    pad = tests.terms.shape[1] + slack
    lists = np.repeat(np.arange(len(terms)), counts) * span + positions + pad
    begin = np.cumsum(counts) - counts
    slot = np.searchsorted(terms, tests.terms)
    found = (terms[np.minimum(slot, len(terms) - 1)] == tests.terms) | (tests.terms < 0)
    live = np.flatnonzero(found.all(axis=1))
    first = slot[live, 0]
    total = np.cumsum(counts[first])
    at = 0
    while at < len(live):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        n = counts[first[at:to]]
        window = np.repeat(live[at:to], n)
        where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[first[at:to]], n)
        start = positions[where] - tests.offsets[window, 0]
        exact = np.ones(len(window), bool)
        for k in range(1, tests.terms.shape[1]):
            used = k < tests.length[window]
            want = slot[window, k] * span + start + tests.offsets[window, k] + pad
            i = np.searchsorted(lists, want)
            after = lists[np.minimum(i, len(lists) - 1)]
            off = np.minimum(np.abs(after - want), np.abs(lists[np.maximum(i - 1, 0)] - want))
            exact &= ~used | (off == 0)
            stay = ~used | (off <= slack)
            window, start, exact = window[stay], start[stay], exact[stay]
            if not len(window):
                break
        if len(window):
            yield window, start, exact
        at = to


def find(index: DataFrame, tests: Tests, slack: int = SLACK) -> DataFrame:
    """``key, item_id, start, length, exact``: every window's matches in an index built with ``slack`` as its gap."""
    sent = index.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = sent.value
        items = pa.array(tests.item, pa.string())
        for b in batches:
            for row in range(b.num_rows):
                docs = b.column(0)[row].values
                keys, size = docs.field(0).to_numpy(), docs.field(1).to_numpy()
                begins = np.cumsum(size + slack) - size - slack
                terms, counts = (b.column(c)[row].values.to_numpy().astype(np.int64) for c in (1, 2))
                positions = np.frombuffer(b.column(3)[row].as_py(), np.int32).astype(np.int64)
                for window, start, exact in intersect(tests, terms, counts, positions, slack):
                    doc = np.searchsorted(begins, start + tests.offsets[window, 0], "right") - 1  # where its rarest term is
                    own = start - begins[doc]
                    inside = (own >= 0) & (own + tests.length[window] <= size[doc])
                    window, doc, exact, own = window[inside], doc[inside], exact[inside], own[inside]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[doc]), items.take(pa.array(window)), pa.array(own), pa.array(tests.length[window]),
                         pa.array(exact)], names=["key", "item_id", "start", "length", "exact"])

    return index.select("docs", "terms", "counts", "positions").mapInArrow(
        run, "key long, item_id string, start long, length long, exact boolean")


def _blocks(benchmark: DataFrame, block_words: int) -> DataFrame:
    """The items with a ``block`` each; the words of a block are ``block_words`` at most, or one item's."""
    bound = 2 * block_words  # a word and what parts it from the next are two bytes at least
    if (benchmark.agg(F.sum("size")).first()[0] or 0) <= bound:
        return benchmark.withColumn("block", F.lit(0))
    before = with_prefix(benchmark, [], ["item_id", "text"], F.col("size"), "before")
    return materialize(before.withColumn("block", F.expr(f"(before + size - 1) div {bound}")), "tests")


def _groups(blocks: list[int], items, max_terms: int) -> Iterator[tuple[list[int], dict[bytes, int]]]:
    """Runs of blocks with the numbers of their terms, ``max_terms`` at most or one block's."""
    group, term = [], {}
    for k in blocks:
        own = {w for _, text in items(k) for w in words_of(text)}
        if group and len(term) + sum(w not in term for w in own) > max_terms:
            yield group, term
            group, term = [], {}
        group.append(k)
        for w in own:
            term.setdefault(w, len(term))
    yield group, term


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slack: int = SLACK,
            block_words: int = BLOCK_WORDS, max_terms: int = MAX_TERMS) -> tuple[DataFrame, DataFrame]:
    """``(documents, matches)``: ``key, doc_id, n_words`` and ``key, item_id, start, length, exact``."""
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"),
                        F.col(text_col).alias("text"))
    tests = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"),
                             F.coalesce(F.octet_length(item_text_col), F.lit(0)).cast("long").alias("size"))
    tests = _blocks(tests, block_words)
    blocks = sorted(r.block for r in tests.select("block").distinct().collect()) or [0]

    def items(block: int) -> list[tuple[str | None, bytes]]:
        return [(r.item_id, (r.text or "").encode()) for r in tests.filter(F.col("block") == block).select("item_id", "text").collect()]

    documents = found = None
    for group, term in _groups(blocks, items, max_terms):
        if documents is None and len(group) < len(blocks):
            keyed = materialize(keyed, "keyed")  # one numbering for all indexes
        index = build_index(keyed, term, slack)
        counts = np.zeros(len(term), np.int64)
        total = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts"))
        for number, n in total.collect():  # at most the dictionary's terms
            counts[number] = n
        for k in group:
            block = Tests(items(k), window, term)
            block.rank(counts)
            own = materialize(find(index, block, slack), "test-matches")
            found = own if found is None else found.union(own)
        if documents is None:
            documents = index.select(F.explode("docs").alias("d")).select("d.*")
    return documents, found


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    ``n_near`` counts the document's proximity matches, one per window of an
    item and start; they don't make it contaminated.
    """
    documents, found = matches(docs, benchmark, **options)
    phrases = found.filter("exact")
    before = F.max("stop").over(W.partitionBy("key").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1))
    hit = (phrases.select("key", "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
           .withColumn("from", F.greatest("start", F.coalesce(before, "start")))
           .groupBy("key").agg(F.sum(F.greatest(F.col("stop") - F.col("from"), F.lit(0))).alias("n_hit")))
    items = phrases.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    near = found.filter("not exact").groupBy("key").agg(F.count("*").alias("n_near"))
    none = F.array().cast("array<string>")
    zero = F.lit(0).cast("long")
    return (documents.join(hit, "key", "left").join(items, "key", "left").join(near, "key", "left")
            .withColumn("items", F.coalesce("items", none))
            .select("doc_id", "key", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", zero) > 0).alias("contaminated"), F.coalesce("n_near", zero).alias("n_near")))
