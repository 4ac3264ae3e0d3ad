"""URL filters by a character language-model ratio (operator 4), DataFrame functions only.

Rules decide first: a rule (verdict, host, path) fits its host and all
subdomains if the URL's path starts with its path; the longest fitting wins.
URLs that rules accept and URLs that rules reject train two variable-order
Markov models over the characters of host and path: n-gram counts up to
``order``, smoothed by Witten-Bell interpolation from each order to the next
shorter.  All other URLs get their log-likelihood difference per character;
above the cutoff they are blocked.  The cutoff is calibrated on a fifth of the
accepted URLs that the models don't see: the least step of 0.01 above which at
most ``risk`` of them lie.

Every distinct text is scored once under its MD5 key, n-grams are counted before they are
joined, and sums are exact decimals, so reruns agree.  ``rules`` is a
parameter list (a chain of conditions).  Models and cutoff are over the
distinct texts of host and path, not over pages: a text that a third of all
pages share counts once, and ``risk`` is a share of accepted texts.

Defined results: null or no ``://`` gives empty host and path, no rule and
"allow", as does everything that no rule fits while a model has no URLs;
repeated rows give repeated results; other columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import ascii_lower, materialize

#: fixed values: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    return (ascii_lower(F.coalesce(F.regexp_extract(url, _SHAPE, 1), F.lit(""))),
            F.coalesce(F.regexp_extract(url, _SHAPE, 2), F.lit("")))


def _by_rule(rules, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == rule[1]) | F.col("host").endswith("." + rule[1])) & F.col("path").startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _grams(texts: DataFrame, order: int) -> DataFrame:
    """Each position's ``gram`` in ``part``, its character behind ``order`` others (padded at the start, closed at the end).

    The other columns go along, the text doesn't: a row per character with the whole text in it would be quadratic.
    """
    padded = F.concat(F.lit("\u0002" * order), F.col("part"), F.lit("\u0003"))
    every = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))."), F.lit(1))  # one character a match: linear in the text
    return texts.select(*(c for c in texts.columns if c != "part"), F.explode(every).alias("gram"))


def gram_scores(train: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """``gram, score``: log(P(character | rejected) / P(character | accepted)) for every wanted gram.

    ``train``: gram, accepted, rejected (counts).  The wanted grams' tails are
    reduced to distinct ones, level by level of length, before any join; a level
    meets its contexts and the next shorter level, where a key has at most one
    row for each character of the alphabet.
    """
    suffixes = F.explode(F.sequence(F.lit(1), F.lit(order + 1)))
    counts = (train.withColumn("k", suffixes).withColumn("tail", F.expr("right(gram, k)"))
              .groupBy("tail").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")))
    heads = (counts.groupBy(F.expr("left(tail, length(tail) - 1)").alias("head"))
             .agg(F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.expr("a > 0")).alias("ta"), F.count_if(F.expr("r > 0")).alias("tr")))
    steps = (wanted.select("gram").distinct().withColumn("k", suffixes).select("k", F.expr("right(gram, k)").alias("tail")).distinct()
             .withColumn("head", F.expr("left(tail, length(tail) - 1)"))
             .join(counts, "tail", "left").join(heads, "head", "left").na.fill(0, ["a", "r", "na", "nr", "ta", "tr"]))
    steps = materialize(steps, "url-tails")

    def model(n: str, total: str, types: str, shorter: Column) -> Column:
        n, total, types = F.col(n), F.col(total), F.col(types)
        return F.when(total > 0, (n + types * shorter) / (total + types)).otherwise(shorter)

    level = None
    for k in range(1, order + 2):  # shortest context first
        own = steps.filter(F.col("k") == k)
        if level is None:
            accepted = rejected = F.lit(1 / 4096)
        else:
            own = own.withColumn("next", F.expr("right(tail, k - 1)")).join(level, "next")
            accepted, rejected = F.col("p_accepted"), F.col("p_rejected")
        level = own.select(F.col("tail").alias("next"), model("a", "na", "ta", accepted).alias("p_accepted"),
                           model("r", "nr", "tr", rejected).alias("p_rejected"))
    return level.select(F.col("next").alias("gram"), F.log(F.col("p_rejected") / F.col("p_accepted")).cast("decimal(20,9)").alias("score"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = 4,
               risk: float = 0.05) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``, one row per page."""
    host, path = host_and_path(F.col(url_col))
    urls = (pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
            .withColumn("rule", _by_rule(rules, lambda r: r[1] + r[2])).withColumn("by_rule", _by_rule(rules, lambda r: r[0]))
            .withColumn("part", F.concat("host", "path")).withColumn("key", F.unhex(F.md5("part"))))
    texts = materialize(urls.groupBy("part", "key").agg(F.min("by_rule").alias("label"))
                        .withColumn("held", F.pmod(F.xxhash64("part"), F.lit(5)) == 0), "url-texts")
    grams = _grams(texts.filter("part <> ''"), order).groupBy("key", "label", "held", "gram").agg(F.count("*").alias("times"))
    grams = materialize(grams, "url-grams")
    train = (grams.filter("label = 'block' or label = 'allow' and not held").groupBy("gram")
             .agg(F.sum(F.expr("if(label = 'allow', times, 0)")).alias("accepted"), F.sum(F.expr("if(label = 'block', times, 0)")).alias("rejected")))
    scored = (grams.join(gram_scores(train, grams, order), "gram").groupBy("key", "label", "held")
              .agg((F.sum(F.col("score") * F.col("times")) / F.sum("times")).cast("decimal(20,6)").alias("score")))
    scored = materialize(scored, "url-scores")
    seen = scored.agg(F.count_if(F.expr("label = 'block'")), F.count_if(F.expr("label = 'allow' and not held"))).first()
    cutoff = None
    if all(seen):  # one number out of counts per step; the steps are few
        steps = (scored.filter("label = 'allow' and held").groupBy(F.ceil(F.col("score") * 100).cast("long").alias("step"))
                 .agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect())
        total, above = sum(r.n for r in steps), 0
        for r in steps:
            above += r.n
            if above > risk * total:
                cutoff = r.step / 100
                break
    over = F.col("score") > F.lit(max(cutoff, 0.0)) if cutoff is not None else F.lit(False)
    verdict = F.coalesce("by_rule", F.when(over, "block").otherwise("allow"))
    return urls.join(scored.select("key", "score"), "key", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("score").cast("double").alias("score"))
