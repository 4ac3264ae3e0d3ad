"""The corpus pipeline: documents to a training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``:

1. ``quality_rules``: documents that the rules reject go.
2. ``line_dedup``: later copies of repeated line runs (two lines, or 50 words)
   leave the texts; a document that loses all its lines goes.
3. ``simhash``: of each group of near duplicates one document stays, the one
   with the smallest id (null ids last).
4. ``decontaminate``: documents with a benchmark phrase go.
5. ``mix``: the documents that the mix takes words of, with ``size,
   source_size, target, taken``.

All but the last return the columns of ``docs``, whatever these are beside
``doc_id, text, lang, source``; ``n_chars`` follows the text.  An empty table
passes through every stage.  Documents are told apart by id and text, so null ids do
not merge; rows that repeat are judged alike in stages 1, 2 and 4, and come out
of stages 3 and 5 once (there with the words taken of all of them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.decontaminate import contamination
from vellum.llm.lines import MIN_WORDS, drop_repeated_runs
from vellum.llm.mixing import mix, mix_totals
from vellum.llm.quality import quality_rules
from vellum.llm.simhash import near_duplicates
from vellum.session import scratch_dir

KEY = "__pipeline_key"
LINE_COUNTS = ("__n_lines", "__n_removed")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a 128-bit key of id and text; rows that share it are the same document."""
    return docs.withColumn(KEY, F.struct(F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("a"),
                                         F.xxhash64("text", "doc_id").alias("b")))


def _rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    return docs.join(chosen, KEY, "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs).withColumn("__stratum", F.coalesce("lang", F.lit("")))
    judged = quality_rules(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=(KEY,))
    kept = judged.filter("kept").select(KEY, F.col("stratum").alias("__stratum"))
    return rows.join(kept, [KEY, "__stratum"], "left_semi").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = drop_repeated_runs(docs, min_words=MIN_WORDS, counts=LINE_COUNTS)
    total, removed = (F.col(c) for c in LINE_COUNTS)
    out = out.filter((total == 0) | (removed < total))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(removed > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col(KEY))).alias("first")
    kept = near_duplicates(rows, carry=(KEY,)).groupBy("component").agg(first)
    return _rows(rows, kept.select(f"first.{KEY}")).dropDuplicates([KEY]).drop(KEY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    judged = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=KEY)
    return _rows(rows, judged.filter("not contaminated").select(F.col("doc_id").alias(KEY))).drop(KEY)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    totals = mix_totals(*mix(rows, carry=(KEY,))).groupBy(KEY, F.struct("source").alias("__source")).agg(
        F.sum("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum("taken").alias("taken")).filter("taken > 0")
    rows = rows.withColumn("__source", F.struct("source")).drop("size", "source_size", "target", "taken")
    return rows.join(totals, [KEY, "__source"]).dropDuplicates([KEY, "__source"]).drop(KEY, "__source")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontamination_stage),
    ("mix", mixing_stage),
]

#: SQL has no XXH64 and no seeded draws: tests hold each stage against a brute-force version instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
