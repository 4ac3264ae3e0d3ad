"""Connected components of links between documents or classes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a``, ``b``): the least node reachable.

    Alternating large and small stars (Kiveris et al., 2014).  Each step takes
    a minimum per node, combined map side, and joins it back: no group is
    gathered in memory.  The links of one node pass that join under one key; its
    other side has one row per node, so AQE may split such a partition where it
    is skewed.  Every round is written to
    the shared folder; it ends when a round changes nothing.
    """
    def stars(links: DataFrame, large: bool) -> DataFrame:
        both = links.union(links.select("b", "a")) if large else links.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(least, F.col("a") == F.col("u"))
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        return out.filter("a <> b").distinct()

    links = materialize(edges.select("a", "b").filter("a <> b").distinct(), "links")
    state = None
    while True:
        links = materialize(stars(stars(links, True), False), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        links.select("b", "b").distinct()).distinct()
