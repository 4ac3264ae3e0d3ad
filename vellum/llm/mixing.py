"""Mixing sources to target weights (operator 3).

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share
the corpus's size; no target passes ``cap`` times its source.  Then:

1. each source's documents, in id order, are one stream of words, cut into
   blocks of ``block_words`` (a block may cross documents);
2. a source with target t gets its quota of block slots: as many whole passes
   as fit into t, then single blocks until the rest is met, of which the last is
   cut to the words still due, so that a source gets its target to the word;
3. output shards hold ``shard_slots`` slots each, the last one the rest, and
   every shard's count of slots per source is drawn: a pseudorandom permutation
   of all slots deals them into the shards' places.  A shard's counts are thus
   multinomial at the target shares, corrected to meet every quota exactly (a
   draw without replacement), and no task holds the counts of all shards or
   sources;
4. the source's k-th slot takes block ``perm(k mod blocks)`` of the pass
   ``k div blocks``, each pass of each source with its own pseudorandom
   permutation (Feistel network, walked until in range), so that no block is
   taken again before all the others were;
5. slots and blocks are joined by block index.

A block occurs in at most ``cap`` passes, so no document gives more than
``cap`` times its size.  All draws are keyed by source and seed: reruns agree.

Defined results: a null text has size 0 and is taken 0 times; null is a source
of its own; repeated rows are documents of their own; other columns are
ignored; with no words at all every target is 0; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import WORD_RE, materialize, with_prefix

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
SLOT_RUN = 4096
ROUNDS = 6
PASS_KEY = 1000003


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_no, source_size, target`` from ``source, size``.

    The level that all uncapped sources share per unit of weight rises until
    no target is above its cap; each round is one aggregate over the sources.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_prefix(totals, [], ["source"], F.lit(1).cast("long"), "source_no")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight), "mix-sources")
    most = cap * F.col("source_size")
    total, share = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (total / share if share else 0.0), -1
    while True:
        over = most < level * F.col("weight")
        n, spent, left = ranked.agg(F.count_if(over), F.sum(F.when(over, most).otherwise(0)),
                                    F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if not left or n == capped:
            break
        level, capped = (total - spent) / left, n
    target = F.least(most.cast("double"), F.lit(float(level)) * F.col("weight"))
    return ranked.select("source", "source_no", "source_size", target.alias("target"))


def _key(source: str | None, seed: int) -> int:
    return zlib.crc32(b"\xff" if source is None else source.encode(), seed) + (seed << 32)


def _round(right: np.ndarray, key: np.ndarray, r: int, mask: np.ndarray) -> np.ndarray:
    f = (right + key + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
    f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (f ^ (f >> np.uint64(32))) & mask


def _half_bits(size: np.ndarray) -> np.ndarray:
    bits = np.ones(len(size), np.uint64)
    for b in range(1, 32):
        bits[(np.uint64(1) << np.uint64(2 * b)) < size] = b + 1
    return bits


def slot_of(block: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The index that ``permuted`` sends to ``block``: the same rounds backwards."""
    bits = _half_bits(size)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = block.astype(np.uint64), np.arange(len(block))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = out[todo] >> b, out[todo] & m
        for r in range(ROUNDS - 1, -1, -1):
            left, right = right ^ _round(left, k, r, m), left
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``index`` under the pseudorandom permutation of ``range(size)`` that ``key`` names.

    A balanced Feistel network over the next power of 4; values that fall
    outside the range go through it again until they are inside.
    """
    bits = _half_bits(size)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = out[todo] >> b, out[todo] & m
        for r in range(ROUNDS):
            left, right = right, left ^ _round(right, k, r, m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def slot_quotas(targets: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """``targets`` with each source's ``blocks, passes, rest, short, short_at, key, slots``: whole passes over its blocks,
    words due beyond them, the size of its last block and that block's slot in the pass that is not whole, the seed of
    its permutations, and the number of slots that meet its target, each with a word at least."""
    schema = T.StructType([*targets.schema.fields, *(T.StructField(c, T.LongType()) for c in ("blocks", "passes", "rest", "key", "short_at"))])
    passes = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0).cast("long"))
    counted = targets.withColumn("blocks", F.ceil(F.col("source_size") / block_words)).withColumn("passes", passes).withColumn(
        "rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key = np.array([_key(x, seed) for x in pdf["source"]], np.uint64)
            at = slot_of(pdf["blocks"].to_numpy(np.uint64) - np.uint64(1), pdf["blocks"].to_numpy(np.uint64),
                         key + pdf["passes"].to_numpy(np.uint64) * np.uint64(PASS_KEY))
            yield pdf.assign(key=key.astype(np.int64), short_at=at)

    out = counted.filter("source_size > 0").mapInPandas(keyed, schema)
    out = out.withColumn("short", F.col("source_size") - (F.col("blocks") - 1) * block_words)
    single = F.ceil(F.col("rest") / block_words)
    # the short last block may be among the slots that meet the rest: then one more may be needed
    lacking = (F.col("short_at") < single) & (single * block_words - (block_words - F.col("short")) < F.col("rest"))
    return out.withColumn("slots", F.col("passes") * F.col("blocks") + single + lacking.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS,
        shard_slots: int = SHARD_SLOTS, seed: int = 7, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(documents, pieces)`` of the mix.

    ``documents``: one row per input row: doc_id, source, ``carry`` (columns
    taken along), size, source_size, target, source_no, start (its first word's place in its source's stream).
    ``pieces``: the mix itself, one row per slot and document in it: shard,
    place (in the shard), slot (of the source), source_no, block, start, doc_id, word_from, word_to (words of the
    document, end exclusive).
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_RE)).cast("long"), F.lit(0).cast("long"))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
                        *carry)
    sized = materialize(sized, "mix-sizes")  # else dealing by range would count the words twice
    placed = materialize(with_prefix(sized, ["source"], ["doc_id", "size"], F.col("size"), "start"), "mix-placed")
    targets = source_targets(placed, weights, cap)
    documents = (placed.join(targets.select(F.col("source").alias("__source"), "source_no", "source_size", "target"),
                             F.col("source").eqNullSafe(F.col("__source"))).drop("__source"))
    quotas = slot_quotas(targets, block_words, seed).filter("slots > 0")
    quotas = materialize(with_prefix(quotas, [], ["source_no"], F.col("slots"), "offset"), "mix-quotas")
    total = quotas.agg(F.sum("slots")).first()[0] or 0

    @F.pandas_udf(T.LongType())
    def index_of(index: pd.Series, of: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(np.uint64), of.to_numpy(np.uint64), key.to_numpy(np.uint64)))

    # runs of slots first, so that one source's slots are dealt over many tasks
    slots = (quotas.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(SLOT_RUN).cast("long"))))
             .repartition("source_no", "first")
             .withColumn("slot", F.explode(F.sequence("first", F.least(F.col("first") + SLOT_RUN, F.col("slots")) - 1)))
             .withColumn("dealt", index_of(F.col("offset") + F.col("slot"), F.lit(total), F.lit(seed).cast("long")))
             .withColumn("shard", F.expr(f"dealt div {shard_slots}")).withColumn("place", F.expr(f"dealt % {shard_slots}"))
             .withColumn("block", index_of(F.expr("slot % blocks"), "blocks", F.expr(f"key + (slot div blocks) * {PASS_KEY}"))))
    # words of the rest before this slot of the pass that is not whole, and so what the slot takes of its block
    nth = F.col("slot") - F.col("passes") * F.col("blocks")
    before = nth * block_words - F.when(F.col("short_at") < nth, block_words - F.col("short")).otherwise(0)
    words = F.when(nth < 0, F.lit(block_words)).otherwise(F.least(F.lit(block_words), F.col("rest") - before))
    slots = slots.select("shard", "place", "slot", "source_no", "block", words.alias("words"))
    end = F.col("start") + F.col("size")
    cut = (documents.filter("size > 0").select("doc_id", "source_no", "start", "size", F.explode(F.sequence(
        F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block"))
        .select("doc_id", "source_no", "start", "block",
                F.greatest(F.lit(0), F.col("block") * block_words - F.col("start")).alias("word_from"),
                (F.least(end, (F.col("block") + 1) * block_words) - F.col("start")).alias("word_to")))
    # slots come out of a small table, from which the optimizer would infer that they can be broadcast
    due = F.col("block") * block_words + F.col("words") - F.col("start")  # the slot's end among the document's words
    pieces = slots.join(cut.hint("merge"), ["source_no", "block"]).withColumn("word_to", F.least("word_to", due))
    return documents, pieces.filter("word_to > word_from").drop("words")


def mix_totals(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """``documents`` with ``taken``: the words that the mix takes of each, repeats counted."""
    taken = pieces.groupBy(F.col("source_no").alias("__s"), F.col("start").alias("__a")).agg(
        F.sum(F.col("word_to") - F.col("word_from")).alias("__taken"))
    same = (F.col("source_no") == F.col("__s")) & (F.col("start") == F.col("__a")) & (F.col("size") > 0)
    return (documents.join(taken, same, "left").withColumn("taken", F.coalesce("__taken", F.lit(0).cast("long")))
            .drop("__s", "__a", "__taken"))
