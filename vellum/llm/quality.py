"""Quality rules with risk-controlled thresholds (operator 9).

Every document gets its text statistics in one Arrow pass.  Two base rules
reject outright; beside them, each of ``RULES`` rejects documents whose share
exceeds a cutoff that labelled documents have to justify:

* the candidates are a fixed grid, lenient to strict, so the labelled rows are
  a true holdout for it;
* for each stratum (``lang``), a cutoff is admissible if the exact binomial
  test over that stratum's documents labelled good refutes "it falsely rejects
  more than ``risk / rules`` of them" at level ``error / rules``;
* the grid is walked from lenient to strict and stops at the first cutoff that
  isn't admissible (fixed-sequence testing, which needs no further
  correction), and the split over rules is Bonferroni's.

With probability ``1 - error`` the rules together then falsely reject at most
``risk`` of a stratum's good documents.  A stratum with too few labels gets no
cutoffs: only the base rules apply there.

Defined results: a null or empty text has no words, all counts are 0 and it
fails the base rules; a null stratum is the stratum ``""``; a document without
label is judged but justifies nothing; of several labels of one document the
least counts; repeated rows give repeated results; other columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import SPACE_BYTES, byte_values, materialize, slices

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: fixed values: the symbols that are counted
SYMBOL_BYTES = b"#*$%&|<>"
_NOT_FIRST = bytes(range(0x80, 0xC0))  # all but the first byte of a code point
_UPPER = bytes(range(ord("A"), ord("Z") + 1))

#: what each rule compares with its cutoff
RULES = {
    "symbol_share": "n_symbols / nullif(n_words, 0)",
    "upper_share": "n_upper / nullif(word_chars, 0)",
    "dup_line_share": "n_dup_lines / nullif(n_lines, 0)",
    "repeat_share": "n_repeat_words / nullif(n_words, 0)",
}
#: the candidate cutoffs, lenient to strict
GRID = tuple(round(1.0 - 0.04 * i, 2) for i in range(1, 25))

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside ``width``-word windows that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    number = {w: i for i, w in enumerate(set(words))}
    if len(number) == n:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, n)
    starts = n - width + 1
    h = np.zeros(starts, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[j:j + starts] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(starts, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe)
    # equal hashes only nominate; the windows themselves decide
    _, inverse, count = np.unique(np.lib.stride_tricks.sliding_window_view(ids, width)[at], axis=0,
                                  return_inverse=True, return_counts=True)
    at = at[count[inverse.ravel()] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """The counts of ``_COUNTS`` for one text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(text.translate(None, SPACE_BYTES + _NOT_FIRST)),
            len(text) - len(text.translate(None, SYMBOL_BYTES)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), len(text) - len(text.translate(None, _UPPER)))


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, stratum, ``carry`` (columns taken along), the counts and ``base_failed``."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"),
                        *carry, F.col(text_col).alias("__text"))
    schema = T.StructType([*given.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in _COUNTS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = np.array([text_counts(t) for t in byte_values(b.column(b.num_columns - 1))], np.int64).reshape(-1, len(_COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c) for c in rows.T)], names=schema.names)

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return given.mapInArrow(count, schema).withColumn("base_failed", failed)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), 1e-300)
    value = d
    for m in range(1, 10_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                  -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + t * d or tiny)
            c = 1.0 + t / c or tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-13:
            break
    return value


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly, by the incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1.0, 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(p))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, p) / b


def fit_cutoffs(features: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05,
                label_col: str = "quality") -> DataFrame:
    """One row per stratum: a cutoff for each rule, null where none is justified.

    Labelled documents are reduced to counts per stratum, rule and grid step
    before anything leaves its task, so a group below holds at most
    ``rules x steps`` rows whatever the number of labels.
    """
    good = (labels.groupBy(F.col("doc_id")).agg(F.min(label_col).alias("__q")).filter("__q = 1").select("doc_id"))
    steps = F.explode(F.array(*(
        F.struct(F.lit(r).alias("rule"), sum((F.expr(f"coalesce({RULES[r]}, 0)") > c).cast("int") for c in GRID).alias("step"))
        for r in RULES))).alias("s")
    counts = (features.filter("not base_failed").join(good, "doc_id", "left_semi").select("stratum", steps)
              .groupBy("stratum", "s.rule", "s.step").agg(F.count("*").alias("n")))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"stratum": [pdf["stratum"].iloc[0]]}
        for r in RULES:
            own = pdf[pdf["rule"] == r]
            n, best = int(own["n"].sum()), None
            for i, cutoff in enumerate(GRID):
                rejected = int(own.loc[own["step"] >= len(GRID) - i, "n"].sum())  # a step counts from the strict end
                if binomial_cdf(rejected, n, risk / len(RULES)) > error / len(RULES):
                    break
                best = cutoff
            out[r] = [best]
        return pd.DataFrame(out)

    schema = "stratum string, " + ", ".join(f"{r} double" for r in RULES)
    return counts.groupBy("stratum").applyInPandas(choose, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang", risk: float = 0.02, error: float = 0.05,
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``failed_rules`` and ``kept``."""
    features = materialize(text_features(docs, id_col, text_col, stratum_col, carry), "quality-features")
    cutoffs = fit_cutoffs(features, labels.withColumnRenamed(id_col, "doc_id"), risk, error)
    cutoffs = cutoffs.select("stratum", *(F.col(r).alias(f"__{r}") for r in RULES))
    failed = F.filter(F.array(*(F.when(F.expr(f"{RULES[r]} > __{r}"), F.lit(r)) for r in RULES)), lambda r: r.isNotNull())
    return (features.join(cutoffs, "stratum", "left").withColumn("failed_rules", F.concat_ws(",", failed))
            .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")).drop(*(f"__{r}" for r in RULES)))
