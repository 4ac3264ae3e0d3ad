"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.secrets import BASE_RULES, scan

    base = [name for name, _ in BASE_RULES]
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, base), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        joined("spans").alias("spans"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.quality import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "failed_rules")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.licenses import license_scan

    # the documents table has no paths: source, language and hundred stand for directories
    path = F.concat_ws("/", "source", "lang", F.expr("doc_id div 100"), "doc_id")
    return license_scan(table(spark, sf_dir, "documents").withColumn("path", path))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.mixing import mix, mix_totals

    out = mix_totals(*mix(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.decontaminate import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.lines import MIN_WORDS, drop_repeated_runs

    out = drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=MIN_WORDS)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.negatives import hard_negatives

    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, sf_dir, "embeddings").filter(finite).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("embedding"))
    return hard_negatives(rows, anchors=F.col("vec_id") % 100 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.alignment import align

    out = align(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.weighting import score_texts

    return score_texts(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_alignment": op12_alignment,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLE: dict[str, str] = {
    "op8_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS h
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
        later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM win)
                  WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
        removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op6_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
               FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw))),
        hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw USING (n, win)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1),
        dt AS (SELECT doc_id, len(w) AS words, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        often AS (SELECT x, count(*) AS c FROM dt GROUP BY 1),
        win AS (SELECT row_number() OVER () AS id, w[s : s + n - 1] AS t, n
                FROM (SELECT w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
        wt AS (SELECT id, n, x, o, c FROM (SELECT id, n, unnest(t) AS x, unnest(range(n)) AS o FROM win) JOIN often USING (x)),
        rare AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c, o) AS k, count(*) OVER (PARTITION BY id) AS found FROM wt),
        put AS (SELECT id, n, doc_id, p - o AS s FROM rare JOIN dt USING (x) WHERE k = 1 AND found = n AND p > o AND p - o + n - 1 <= words),
        two AS (SELECT DISTINCT put.* FROM put LEFT JOIN rare r ON r.id = put.id AND r.k = 2
                LEFT JOIN dt ON dt.doc_id = put.doc_id AND dt.x = r.x AND dt.p - put.s - r.o BETWEEN -2 AND 2
                WHERE put.n = 1 OR dt.p IS NOT NULL),
        off AS (SELECT two.id, two.n, two.doc_id, two.s, r.o, min(abs(dt.p - two.s - r.o)) AS far
                FROM two JOIN rare r ON r.id = two.id AND r.k > 1
                JOIN dt ON dt.doc_id = two.doc_id AND dt.x = r.x AND dt.p - two.s - r.o BETWEEN -2 AND 2 GROUP BY ALL),
        near AS (SELECT doc_id, count(*) AS n_near FROM (SELECT id, n, doc_id, s FROM off GROUP BY ALL HAVING count(*) = n - 1 AND max(far) > 0)
                 GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op10_line_dedup": r"""
        WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x,
                            unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
        full_lines AS (SELECT doc_id, line, x, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq
                       FROM raw WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
        pairs AS (SELECT * FROM (SELECT doc_id, seq, x, lead(x) OVER (PARTITION BY doc_id ORDER BY seq) AS y FROM full_lines)
                  WHERE y IS NOT NULL),
        later AS (SELECT doc_id, seq FROM (SELECT doc_id, seq, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, seq) AS k
                                           FROM pairs) WHERE k > 1),
        long_later AS (SELECT doc_id, seq FROM (SELECT doc_id, seq, row_number() OVER (PARTITION BY x ORDER BY doc_id, seq) AS k
                                                FROM full_lines WHERE len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 50)
                       WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, seq FROM (SELECT doc_id, seq FROM later UNION ALL SELECT doc_id, seq + 1 FROM later
                                                   UNION ALL SELECT doc_id, seq FROM long_later)),
        marked AS (SELECT raw.doc_id, raw.line, raw.x, f.seq IS NOT NULL AS has_word, g.seq IS NOT NULL AS gone
                   FROM raw LEFT JOIN full_lines f ON f.doc_id = raw.doc_id AND f.line = raw.line
                   LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.seq = f.seq)
        SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN (
            SELECT doc_id, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (gone) AS n_removed,
                   string_agg(x, chr(10) ORDER BY line) FILTER (NOT gone) AS kept
            FROM marked GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
    "op11_hard_negatives": r"""
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id AS id, r.label, list_dot_product(a.e, r.e)::BIGINT AS score
              FROM v a, v r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
        p AS (SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score,
                                    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE label = own)
              WHERE k <= 5),
        n AS (SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own
                   AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
