"""Column profiling, display casting and faceted filtering
(C4-C6, C8, C15, D3, H6, H7, K4).

Type inference for every column is one ``agg`` pass: each cell becomes four bits
(what it can be read as), which a ``bit_and`` per column combines map side, then
unpivoted to one row per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.predicates import py_strip_some
from vellum.operators.materialize import materialize

# Inference patterns and accepted boolean words.
INFER_INT = r"^-?\d+$"
INFER_FLOAT = r"^-?\d*\.?\d+([eE][+-]?\d+)?$"
INFER_BOOL_WORDS = ["true", "false", "1", "0", "yes", "no", "sim", "não", "verdadeiro", "falso"]
INFER_DATE_PREFIXES = [r"^\d{4}-\d{2}-\d{2}", r"^\d{2}/\d{2}/\d{4}", r"^\d{2}-\d{2}-\d{4}"]

# Inferred type labels, in the order they are tried.
LABELS = ["int64", "float64", "bool", "datetime64", "object"]

# Friendly names, matched by substring in this order.
FRIENDLY = [("int", "Whole numbers"), ("float", "Decimal numbers"), ("object", "Text"),
            ("datetime", "Date/Time"), ("bool", "True/False")]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


#: what a cell's text can be read as: one bit each, in the order of ``LABELS``
_INT, _FLOAT, _BOOL, _DATE = 1, 2, 4, 8


# the same languages as INFER_INT and INFER_FLOAT (with its comma for a point), without backtracking
_INT_RE = r"^-?\d++$"
_FLOAT_RE = r"^-?(?:\d++(?:[.,]\d++)?|[.,]\d++)(?:[eE][+-]?\d++)?$"
_WORD_BYTES = 24  # longer texts are no boolean word in any case


def _cell_bits(s: Column) -> Column:
    """What a stripped cell can be read as.

    A cell's first characters decide which patterns it can meet, so most cells
    meet one: numbers and dates begin with a digit, a sign, a point or a comma; a
    date has its separator at the third or fifth place, where a number has none.
    """
    at = lambda i: F.substring(s, i, 1)
    word = F.when((F.octet_length(s) <= _WORD_BYTES) & F.lower(s).isin(INFER_BOOL_WORDS), _BOOL).otherwise(0)
    dates = "|".join(p.removeprefix("^") for p in INFER_DATE_PREFIXES)
    dated = (at(5).isin("-", "/") | at(3).isin("-", "/")) & s.rlike(f"^(?:{dates})")
    return (F.when(~at(1).between("!", "9"), word)
            .when(dated, _DATE)
            .when(s.rlike(_INT_RE), F.when(s.isin("0", "1"), _BOOL).otherwise(0) + (_INT + _FLOAT))
            .when(s.rlike(_FLOAT_RE), _FLOAT).otherwise(0))


def _type_exprs(df: DataFrame) -> tuple[DataFrame, list[Column], list[Column]]:
    """``df``'s stripped texts, one aggregate pass over them, and the label of each column from its result.

    The texts are projected first: inside the aggregates each test would strip its cell again.
    """
    texts = df.select(*[py_strip_some(_q(c).cast("string")).alias(f"s{i}") for i, c in enumerate(df.columns)])
    aggs, labels = [], []
    for i in range(len(df.columns)):
        s = F.col(f"s{i}")
        aggs += [F.count(s).alias(f"n{i}"), F.bit_and(F.when(s.isNotNull(), _cell_bits(s))).alias(f"t{i}")]
        label = F.when(F.col(f"n{i}") == 0, "object")
        for bit, name in zip((_INT, _FLOAT, _BOOL, _DATE), LABELS):
            label = label.when(F.col(f"t{i}").bitwiseAND(F.lit(bit)) > 0, name)
        labels.append(label.otherwise("object"))
    return texts, aggs, labels


def infer_types(df: DataFrame, sample: int | None = None) -> DataFrame:
    """C4: one row per column: (ordinal, column, inferred_type).

    Whole table by default; ``sample`` limits to the first n rows when asked.
    """
    src = df.limit(sample) if sample else df
    texts, aggs, labels = _type_exprs(src)
    one = texts.agg(*aggs) if aggs else src.agg(F.count(F.lit(1)))
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), lab.alias("inferred_type"))
                     for i, (c, lab) in enumerate(zip(df.columns, labels))])
    return one.select(F.inline(rows))


def profile(df: DataFrame, fmt: str = "csv", separator: str | None = None) -> DataFrame:
    """Format, column count, row count and the type of every column, from
    the same single aggregation pass as C4."""
    texts, aggs, labels = _type_exprs(df)
    one = texts.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    types = F.create_map(*[x for c, lab in zip(df.columns, labels) for x in (F.lit(c), lab)])
    return one.select(F.lit(fmt).alias("format"), F.lit(len(df.columns)).alias("column_count"),
                      F.col("__rows").alias("row_count"), types.alias("column_types"),
                      F.lit(separator).cast("string").alias("separator"))


def type_label(dtype: Column) -> Column:
    """Friendly label for a dtype name; unknown names pass through."""
    low = F.lower(dtype)
    out = None
    for frag, label in FRIENDLY:
        out = (F.when(low.contains(frag), F.lit(label)) if out is None
               else out.when(low.contains(frag), F.lit(label)))
    return out.otherwise(dtype)


def type_labels(types_df: DataFrame, col: str = "inferred_type") -> DataFrame:
    return types_df.withColumn("label", type_label(F.col(col)))


def stringify(df: DataFrame) -> DataFrame:
    """Every column as text, null -> '' (display / export edge only)."""
    return df.select(*[F.coalesce(_q(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows; with ``order_by`` a deterministic top-n."""
    if order_by:
        return df.orderBy(*[_q(c) for c in order_by]).limit(n)
    return df.limit(n)


def _facet_values(df: DataFrame, cols: list[tuple[int, str]] | None = None) -> DataFrame:
    """Distinct non-blank text values per column (null and 'None' excluded)."""
    cols = cols if cols is not None else list(enumerate(df.columns))
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), _q(c).cast("string").alias("value"))
        for i, c in cols])))
    return (long.filter(F.col("value").isNotNull() & (F.col("value") != "") & (F.col("value") != "None"))
            .distinct())


def facet_profile(df: DataFrame, max_picks: int = 50) -> DataFrame:
    """H6: per column: distinct count and the control a filter UI would offer
    (none <= 1 < pick list <= max_picks < search); pick values are listed
    only for pick-list columns, so no unbounded set is ever collected.

    Exact: distinct (column, value) pairs are shuffled once, and written, so
    that the counts and the pick lists read them instead of finding them twice.
    """
    names = df.columns
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal int, column string, n_distinct long, pick_values string, control string")
    vals, _, _ = materialize(_facet_values(df), "facet-values")
    counts = vals.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_distinct"))
    small = counts.filter(F.col("n_distinct") <= max_picks).select("ordinal")
    # at most one row per column of df: bounded by the schema, safe to broadcast
    picks = (vals.join(F.broadcast(small), "ordinal", "left_semi")
             .groupBy("ordinal").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("pick_values")))
    allcols = df.sparkSession.createDataFrame(list(enumerate(names)), "ordinal int, column string")
    control = (F.when(F.col("n_distinct") <= 1, "none")
               .when(F.col("n_distinct") <= max_picks, "pick").otherwise("search"))
    return (allcols.join(counts, "ordinal", "left").join(picks, "ordinal", "left")
            .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
            .withColumn("control", control)
            .select("ordinal", "column", "n_distinct",
                    F.when(F.col("control") == "pick", F.col("pick_values")).alias("pick_values"), "control"))


def facet_controls(df: DataFrame, max_picks: int = 50) -> DataFrame:
    """H6 without distinct counts: the control of each column, and a pick list's values.

    A column's values are held in a frequent-items sketch that is exact while it
    holds all of them, and is dropped to a bounded number otherwise; counts that
    add up to the column's rows prove the first (what a full sketch throws away
    is more than what its remaining items could make up for).  So no task holds
    or sends more than the sketch of ``4 * max_picks`` items a column, however
    many values a search column has.
    """
    names = df.columns
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal int, column string, pick_values string, control string")
    texts = df.select(*[F.when(~_q(c).cast("string").isin("", "None"), _q(c).cast("string")).alias(f"v{i}") for i, c in enumerate(names)])
    held = [F.expr(f"approx_top_k(v{i}, {max_picks + 2}, {4 * (max_picks + 2)})").alias(f"k{i}") for i in range(len(names))]
    one = texts.agg(F.count(F.lit(1)).alias("n"), *held)
    rows = []
    for i, c in enumerate(names):
        all_ = F.aggregate(f"k{i}", F.lit(0).cast("long"), lambda a, x: a + x["count"]) == F.col("n")
        values = F.sort_array(F.transform(F.filter(f"k{i}", lambda x: x["item"].isNotNull()), lambda x: x["item"]))
        control = (F.when(~all_ | (F.size(values) > max_picks), "search").when(F.size(values) <= 1, "none").otherwise("pick"))
        rows.append(F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.when(control == "pick", F.array_join(values, "|")).alias("pick_values"),
                             control.alias("control")))
    return one.select(F.inline(F.array(*rows)))


def facet_predicate(picks: dict[str, list[str]] | None = None,
                    searches: dict[str, str] | None = None) -> Column:
    """D3: AND over columns of 'text in picked set' / 'contains term, case-blind'."""
    cond = F.lit(True)
    for c, values in (picks or {}).items():
        if values:
            cond = cond & F.coalesce(_q(c).cast("string"), F.lit("None")).isin(list(values))
    for c, term in (searches or {}).items():
        if term:
            cond = cond & F.lower(F.coalesce(_q(c).cast("string"), F.lit("None"))).contains(term.lower())
    return cond


def facet_filter(df: DataFrame, picks: dict[str, list[str]] | None = None,
                 searches: dict[str, str] | None = None) -> DataFrame:
    return df.filter(facet_predicate(picks, searches))


def filter_counts(df: DataFrame, pred: Column) -> DataFrame:
    """H7: total rows, rows passing ``pred`` and column count, one pass."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_if(F.coalesce(pred, F.lit(False))).alias("filtered_rows"),
                  F.lit(len(df.columns)).alias("column_count"))
