"""Line dedup by a suffix array over line-id sequences (operator 10).

A document is the sequence of its lines that hold a word (``\\n``-split,
compared as they are).  Suffixes of all sequences are ranked by distributed
prefix doubling: the rank of a line, then of 2, 4, ... lines from the pair of
ranks ``(rank of h lines here, rank of h lines h further on)``.  Positions
whose rank nobody shares have no repeat of that length and leave the round.

Doubling goes on until no rank is shared, and the ranks of every depth are
kept.  The suffixes that share a rank at depth ``h`` are an interval of the
suffix array whose longest common prefix is ``h`` lines or more.  Within an
interval the start with the smallest (document, place) is the original; every
other start is a later copy of ``h`` lines.  A copy whose length is no depth of
the doubling is covered by overlapping intervals of its starts, so copies of a
document's lines that overlap or touch are merged into maximal repeated runs,
and these are deleted.  Runs are judged on the input, not on what is left.

With ``min_words`` (operator 10 and the pipeline: 50) a run is measured by its
words as well: one of fewer than ``min_lines`` lines is a run too if it holds
that many words in total, so that a long repeated paragraph without a newline
goes wherever it stands.  Each depth below ``min_lines`` is then visited (at 2,
only the line ranks that are there already).

Ranks come from counts per pair of ranks (combined map side, with the
interval's first start), ordered by range, and are joined back: a line that a
third of all documents share is one row on the counting side and is never
gathered.  Deeper rounds hold only starts that are still shared, so their rows
fall; there are about log2 (lines of the longest repeated run) rounds.  Runs
are merged per document, in a window that spills.

Defined results: null and empty texts have no lines and stay as they are;
blank lines and those not deleted stay, in order; rows with the same id and
text are one document, so neither is the other's copy; null ids come last;
other columns pass; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import byte_values, materialize, slices, with_prefix

MIN_LINES, MIN_WORDS, SALTS = 2, 50, 32


def _marked(docs: DataFrame, id_col: str, text_col: str) -> list:
    """A document's key: its id and a hash of its text."""
    return [F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("hash")]


def line_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: bool = False) -> DataFrame:
    """``doc, hash, seq, line, a, b``: each line with a word; 128 bits name its content.  With ``words`` also its number of words."""
    given = docs.select(*_marked(docs, id_col, text_col), F.col(text_col).alias("text")).filter("text is not null")
    schema = T.StructType([given.schema["doc"], T.StructField("hash", T.LongType()), T.StructField("seq", T.LongType()),
                           T.StructField("line", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                           *[T.StructField("words", T.LongType())] * words])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in slices(batches):
            names, lines, counts, sizes = [], [], [], []
            for text in byte_values(b.column(2)):
                own = [(i, xxh3_128_digest(x)) for i, x in enumerate(text.split(b"\n")) if x.strip()]
                if words:
                    sizes += filter(None, (len(x.split()) for x in text.split(b"\n")))
                lines += (i for i, _ in own)
                names += (x for _, x in own)
                counts.append(len(own))
            name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            row = pa.array(np.repeat(np.arange(len(counts)), counts))
            seq = np.arange(len(names)) - np.repeat(np.cumsum(counts, dtype=np.int64) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(1).take(row), pa.array(seq), pa.array(lines, pa.int64()),
                 pa.array(name[:, 0]), pa.array(name[:, 1]), *[pa.array(sizes, pa.int64())] * words], names=schema.names)

    return given.mapInArrow(run, schema)


def _order() -> Column:
    return F.struct(F.col("doc").isNull().alias("n"), F.col("doc"), F.col("hash"), F.col("seq"))


def _ranked(rows: DataFrame, by: list[str], copies: bool) -> DataFrame:
    """``rows`` whose ``by`` occurs twice or more, with its ``rank`` in place of it; with ``copies`` also whether a row is
    a ``later`` one of its rank."""
    first = [F.min(_order()).alias("first")] * copies
    shared = rows.groupBy(*by).agg(F.count("*").alias("n"), *first).filter("n > 1").drop("n")
    ranks = with_prefix(shared, [], by, F.lit(1).cast("long"), "rank")
    out = rows.join(ranks, by).drop(*by)
    if copies:
        out = out.withColumn("later", ~_order().eqNullSafe(F.col("first"))).drop("first")
    return materialize(out, "line-ranks")


def _doubled(ranked: DataFrame, step: int, more: list[str]) -> DataFrame:
    """``ranked`` with ``own``, its rank, and ``next``, the rank ``step`` lines further on; starts without one leave."""
    there = ranked.select("doc", "hash", (F.col("seq") - step).alias("seq"), F.col("rank").alias("next"),
                          *(F.col(c).alias(f"next_{c}") for c in more)).alias("y")
    same = (F.col("x.doc").eqNullSafe(F.col("y.doc")) & (F.col("x.hash") == F.col("y.hash")) & (F.col("x.seq") == F.col("y.seq")))
    return ranked.alias("x").join(there, same).select(
        "x.doc", "x.hash", "x.seq", *(f"x.{c}" for c in more), F.col("x.rank").alias("own"), "y.next", *(f"y.next_{c}" for c in more))


def _long_copies(ranked: DataFrame, min_words: int) -> DataFrame:
    """The later starts of ranks whose run holds ``min_words`` words; a frequent rank's starts meet its first in ``SALTS`` parts."""
    starts = ranked.filter(F.col("words") >= min_words).withColumn("salt", F.pmod(F.xxhash64("doc", "hash", "seq"), F.lit(SALTS)))
    first = starts.groupBy("rank").agg(F.min(_order()).alias("first")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return starts.join(first, ["rank", "salt"]).filter(~_order().eqNullSafe(F.col("first")))


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES,
                 min_words: int | None = None) -> DataFrame:
    """``doc, hash, seq, n``: a run of ``n`` lines at ``seq`` that occurs earlier too, for each depth ``n`` of the
    doubling from ``min_lines`` on, and for each below where the run holds ``min_words`` words."""
    by_words, found = min_words is not None, []
    run = lambda n: ["doc", "hash", "seq", F.lit(n).cast("long").alias("n")]
    lines = line_ids(docs, id_col, text_col, by_words)
    ranked = _ranked(lines, ["a", "b"], min_lines == 1).dropDuplicates(["doc", "hash", "seq"])
    ranked = ranked.drop("line")
    if by_words:
        ranked = ranked.withColumn("head", F.col("words"))  # of the run's first line
    depth = 1
    while depth < min_lines:
        if by_words:
            found.append(_long_copies(ranked, min_words).select(*run(depth)))
        step = 1 if by_words else min(depth, min_lines - depth)
        pairs = _doubled(ranked, step, ["words", "head"] if by_words else [])
        if by_words:
            pairs = pairs.withColumn("words", F.col("head") + F.col("next_words")).drop("next_words", "next_head")
        depth += step
        ranked = _ranked(pairs, ["own", "next"], depth == min_lines)
    while not ranked.isEmpty():
        found.append(ranked.filter("later").select(*run(depth)))
        ranked = _ranked(_doubled(ranked, depth, []), ["own", "next"], True)
        depth *= 2
    return reduce(DataFrame.unionByName, found) if found else ranked.select(*run(depth))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES,
                  min_words: int | None = None) -> DataFrame:
    """``doc, hash, begin, end``: the maximal runs of later copies, as numbers among a document's lines with a word
    (``end`` exclusive)."""
    at, end = W.partitionBy("doc", "hash").orderBy("seq"), F.col("seq") + F.col("n")
    before = F.max(end).over(at.rowsBetween(W.unboundedPreceding, -1))
    opened = later_copies(docs, id_col, text_col, min_lines, min_words).withColumn(
        "opens", F.coalesce(F.col("seq") > before, F.lit(True)).cast("long"))
    part = F.sum("opens").over(at.rowsBetween(W.unboundedPreceding, 0))
    return (opened.withColumn("part", part).groupBy("doc", "hash", "part")
            .agg(F.min("seq").alias("begin"), F.max(end).alias("end")).drop("part"))


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES,
                       min_words: int | None = None, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with the deleted lines taken out of the text, and beside it the numbers of its lines with a word and of
    those deleted, in the columns ``counts`` (which ``docs`` may not have)."""
    if clash := {c.lower() for c in counts} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has columns of the names {sorted(clash)}: pass other counts")
    gone = repeated_runs(docs, id_col, text_col, min_lines, min_words).groupBy(
        F.col("doc").alias("__doc"), F.col("hash").alias("__hash")).agg(F.collect_list(F.struct("begin", "end")).alias("__runs"))
    mine = F.col(id_col).eqNullSafe(F.col("__doc")) & (F.xxhash64(text_col) == F.col("__hash"))
    joined = docs.join(gone, mine, "left").drop("__doc", "__hash")
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept, total, removed = [], [], []
            for text, runs in zip(b.column(place).cast(pa.binary()).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                lines = text.split(b"\n") if text is not None else []
                full = [i for i, x in enumerate(lines) if x.strip()]
                drop = {i for r in runs or () for i in full[r["begin"]:r["end"]]}
                kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
                total.append(len(full))
                removed.append(len(drop))
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns[place] = pa.array(kept, pa.binary()).cast(b.column(place).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=schema.names)

    return joined.mapInArrow(cut, schema)
