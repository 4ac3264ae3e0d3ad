"""Delimited records from splittable text (A1, E6): quoted newlines without whole-file readers.

A file is read as lines by as many tasks as it has splits; a split's lines are
dealt on in blocks, so that no task takes a whole split, or several that hash
alike.  Quotes are counted per line; a line ends inside a quoted field if the
quotes before its end are odd in number.  Blocks don't know what came before
them, so each is summarised both ways: its quotes' parity, and how many records
start in it if it begins outside a quoted field and if it begins inside one.  A
running sum over a file's blocks (one row each) tells which holds and how many
records lie before.
Lines then know the number of their record; a record of one line is done, the
lines of the others are put together by (file, number).

This is the quoting of RFC 4180: a field with quotes, separators or newlines is
enclosed in quotes, and quotes inside are doubled.  ``probe`` marks files that
break it (a quote inside an open field, or an odd number of quotes at the end);
callers leave those to Spark's own whole-file reader.

Lines end in ``\\n``; a ``\\r`` before it is part of the line ending at the end
of a record and kept inside a quoted field.  Empty lines between records are no
records.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators.materialize import materialize

_PACKING = "spark.sql.files.openCostInBytes"
#: a block holds two to this many lines
BLOCK_BITS = 12


@contextmanager
def one_split_per_task(spark: SparkSession):
    """While open, no task of a file scan takes more than one split.

    A line's place in its task is then its place in its split.  Spark packs
    splits by their size plus a cost per file; with a cost of a whole task
    nothing is packed.  Scans are planned when they run, so the result must be
    written inside the block.
    """
    before = spark.conf.get(_PACKING)
    spark.conf.set(_PACKING, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(_PACKING, before)


def scanned_file() -> Column:
    """The file a row was read from, as paths are written (``_metadata.file_path`` is URL-encoded)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def numbered_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, start, place, line``: each line with its split's first byte and its number there (inside ``one_split_per_task``)."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.option("lineSep", "\n").text(files).select(
        scanned_file().alias("file"), F.col("_metadata.file_block_start").alias("start"), place.alias("place"),
        F.col("value").alias("line"))
    first = (F.col("start") == 0) & (F.col("place") == 0)
    return lines.withColumn("line", F.when(first, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line")))


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _stray(line: Column) -> Column:
    """A quote that neither opens nor closes a field nor is doubled: none of its neighbours is a separator or the line's end."""
    return F.replace(line, F.lit('""'), F.lit("")).rlike('[^,;\\t|]"[^,;\\t|\\r]')


def probe(spark: SparkSession, files: list[str], head_bytes: int, skip: int) -> DataFrame:
    """One row per file: ``file, head`` (its first ``head_bytes`` bytes), ``header`` (the first line that is not empty
    after ``skip`` others), ``spans`` (some record holds a newline), ``broken`` (its quotes don't pair).

    One pass over the files by tasks, reduced per split in place; each split's first lines
    are kept only where the file begins.
    """
    with one_split_per_task(spark):
        lines = numbered_lines(spark, files)
        body = (F.col("start") > 0) | (F.col("place") >= skip)  # a preamble is taken to lie in the first split
        odd = F.when(body, _quotes(F.col("line")) % 2).otherwise(0)
        begins = (F.col("start") == 0) & (F.col("place") < max(head_bytes, skip + 1))
        kept = F.when(F.col("place").between(skip, skip + 15), F.col("line")).otherwise(F.substring("line", 1, head_bytes))
        found = lines.groupBy("file").agg(
            F.sum(odd).alias("odd"), F.bool_or(body & _stray(F.col("line"))).alias("stray"),
            F.sort_array(F.collect_list(F.when(begins, F.struct("place", kept.alias("line"))))).alias("first"))
        head = F.substring(F.encode(F.array_join("first.line", "\n"), "UTF-8"), 1, head_bytes).cast("string")
        filled = F.filter("first", lambda x: (x["place"] >= skip) & (F.rtrim(x["line"], F.lit("\r")) != ""))
        header = F.coalesce(F.get(filled, F.lit(0))["line"], F.lit(""))
        found, _, _ = materialize(found.select("file", head.alias("head"), header.alias("header"), (F.col("odd") > 0).alias("spans"),
                                               (F.col("stray") | (F.col("odd") % 2 == 1)).alias("broken")), "file-heads")
    return found


def records(spark: SparkSession, files: list[str], skip: int = 0) -> DataFrame:
    """``file, number, record``: the files' records from their header on (number 0), after ``skip`` lines.

    Written to the shared folder: the numbers hold only for the scan that gave them.
    """
    block = ["file", "start", "block"]
    with one_split_per_task(spark):
        lines = numbered_lines(spark, files).filter((F.col("start") > 0) | (F.col("place") >= skip))
        lines = lines.withColumn("block", F.shiftright("place", BLOCK_BITS))
        by = W.partitionBy(*block).orderBy("place")
        odd = F.coalesce(F.sum(_quotes(F.col("line")) % 2).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2
        lines = lines.withColumn("inside", odd).withColumn("odd", _quotes(F.col("line")) % 2)
        empty = F.rtrim("line", F.lit("\r")) == ""
        for i in (0, 1):  # the block begins outside (0) or inside (1) a quoted field
            starts = (F.col("inside") == i) & ~empty
            lines = lines.withColumn(f"n{i}", F.sum(starts.cast("long")).over(by.rowsBetween(W.unboundedPreceding, 0)))
        lines, _, _ = materialize(lines, "file-lines", compression="zstd")
    blocks = lines.groupBy(*block).agg(F.sum("odd").alias("odds"), F.max("n0").alias("all0"), F.max("n1").alias("all1"))
    before = W.partitionBy("file").orderBy("start", "block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("enters", F.coalesce(F.sum("odds").over(before), F.lit(0)) % 2)
    own = F.when(F.col("enters") == 0, F.col("all0")).otherwise(F.col("all1"))
    blocks = blocks.withColumn("offset", F.coalesce(F.sum(own).over(before), F.lit(0))).select(*block, "enters", "offset")
    blocks, _, _ = materialize(blocks, "file-blocks")  # its size is known before the lines are dealt for the join
    lines = lines.join(blocks, block)
    began = F.when(F.col("enters") == 0, F.col("n0")).otherwise(F.col("n1"))
    inside = (F.col("inside") + F.col("enters")) % 2 == 1
    lines = lines.select("file", "start", "place", "line", (F.col("offset") + began - 1).alias("number"), inside.alias("inside"),
                         (F.col("odd") == 1).alias("odd"))
    whole = lines.filter(~F.col("inside") & ~F.col("odd") & (F.rtrim("line", F.lit("\r")) != ""))
    parts = lines.filter(F.col("inside") | F.col("odd")).groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("start", "place", "line"))).alias("p"))
    out = whole.select("file", "number", "line").unionByName(parts.select("file", "number", F.array_join("p.line", "\n").alias("line")))
    return out.select("file", "number", F.regexp_replace("line", "\r$", "").alias("record"))


def numbered(found: DataFrame) -> DataFrame:
    """``records`` with ``row``: the data records' numbers, from 1, over all files by name."""
    counts = found.groupBy("file").agg(F.max("number").alias("last"))
    before = F.coalesce(F.sum("last").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("file", before.alias("before"))  # a row per file
    return found.join(offsets, "file").withColumn("row", F.col("before") + F.col("number")).drop("before")
