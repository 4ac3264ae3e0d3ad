"""Each operator against brute force or SQL, on a fixture with nulls, ties, repeats, long and empty texts."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp long, key long, hash long, slice long"
PASSAGE = " ".join(f"shared{i}" for i in range(60))
TEXTS = [None, "", "  \n\t\n", "one", "a b", PASSAGE, "intro words " + PASSAGE + " and an end", PASSAGE, "é" * 30 + " " + PASSAGE[:120],
         "first line here\nsecond line here\nthird\n\nfirst line here\nsecond line here", "x\nfirst line here\nsecond line here\ny",
         "token = abcdef12 AKIA" + "Z9" * 10 + " " + "0a" * 20 + " é password: 'short'", "rep eat " * 3000,
         " ".join(f"w{i % 997}" for i in range(30000)), "Released under the MIT License.", "clean text " + " ".join(f"c{i}" for i in range(40))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 4 else i, t, [None, "en"][i % 2], [None, "s1", "s2"][i % 3], 0, 1, 2, 3, 4, 5) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[9], (None, "one two three", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_simhash(spark, docs):
    import xxhash

    from vellum.llm.simhash import near_duplicates

    def fp(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(i, fp(t)) for i, t in pairs(docs)]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 3:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    want = []
    for k, (i, f) in enumerate(rows):
        ids = [x for (x, _), g in zip(rows, group, strict=True) if g == group[k] and x is not None]
        want.append((i, f"{f:016x}", min(ids, default=None)))
    got = near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
    assert rows_of(got) == sorted(want, key=repr)
    assert rows_of(near_duplicates(docs, bucket=1).select("doc_id", "fingerprint", "component_id")) == sorted(want, key=repr)


def test_bit_sliced_groups():
    import numpy as np

    from vellum.llm.simhash import grouped

    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 12, 300, dtype=np.uint64)
    root = grouped(fps, np.array([120, 1, 179]), 1, block=64)
    for at, to in ((0, 120), (120, 121), (121, 300)):
        group = list(range(at, to))
        label = dict(zip(group, group, strict=True))
        for a in group:
            for b in group:
                if bin(int(fps[a] ^ fps[b])).count("1") <= 1 and label[a] != label[b]:
                    old, new = label[a], label[b]
                    label = {k: new if v == old else v for k, v in label.items()}
        assert len({(label[i], root[i]) for i in group}) == len(set(label.values())) == len({root[i] for i in group})


def covered(seq, width, earlier):
    out = [False] * len(seq)
    for k in range(len(seq) - width + 1):
        if earlier(k, tuple(seq[k:k + width])):
            out[k:k + width] = [True] * width
    return out


def test_byte_dedup(spark, docs):
    from vellum.llm.suffixes import remove_repeats

    inf = float("inf")
    least = {}
    for i, t in pairs(docs):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            least[b[k:k + 50]] = min(least.get(b[k:k + 50], inf), inf if i is None else i)
    want = []
    for i, t in pairs(docs):
        b = (t or "").encode()
        gone = covered(b, 50, lambda k, w, i=i: least[bytes(w)] < (inf if i is None else i))
        want.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)),
                     hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert rows_of(remove_repeats(docs)) == sorted(want, key=repr)


def test_word_dedup(spark, docs):
    from vellum.llm.substrings import remove_repeats

    inf = float("inf")
    first = {}
    rows = [(inf if i is None else i, n, (t or "").encode().split()) for n, (i, t) in enumerate(pairs(docs))]
    for i, n, w in rows:
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k:k + 20]), []).append((i, n, k))
    least = {w: (min(x[0] for x in at), {n: min(k for _, m, k in at if m == n) for n in {x[1] for x in at}}) for w, at in first.items()}
    want = []
    for i, n, w in rows:
        gone = covered(w, 20, lambda k, x, i=i, n=n: least[x][0] < i or least[x][1][n] < k)
        want.append((None if i == inf else i, len(w), sum(gone),
                     hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    assert rows_of(remove_repeats(docs)) == sorted(want, key=repr)


def test_secrets(spark, docs):
    from vellum.llm.secrets import scan

    base = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
             lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
            ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    want = {t or "": [x for _, x in sorted(((m.start(), n), (k, m.start(), m.end())) for n, (k, p, ok) in enumerate(base)
                                     for m in p.finditer(t or "") if ok(m))] for _, t in pairs(docs)}
    got = {r.doc_id: [tuple(s) for s in r.spans if s.kind in ("assign", "access", "hex")] for r in scan(docs).collect()}
    assert got[11] and all(got[i] == want[t or ""] for i, t in pairs(docs) if i is not None)


def test_quality(spark, docs):
    from vellum.llm.quality import binomial_cdf, quality_rules

    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    for i, t in pairs(docs):
        if i is None:
            continue
        w = (t or "").encode().split()
        seen = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k:k + 8]), []).append(k)
        hit = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")]
        assert (got[i].n_words, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), len(hit), len(lines) - len(set(lines)))
        assert got[i].base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and got[i].kept == (not got[i].base_failed)
    import math
    assert abs(binomial_cdf(3, 40, 0.05) - sum(math.comb(40, k) * 0.05**k * 0.95 ** (40 - k) for k in range(4))) < 1e-9


def test_mixing(spark, docs):
    from vellum.llm.mixing import mix, mix_totals, permuted, slot_of

    out = mix_totals(*mix(docs, block_words=16)).collect()
    again = mix_totals(*mix(docs, block_words=16)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == docs.count()
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
        assert all(r.taken <= 3 * r.size for r in own)
    import numpy as np
    p = permuted(np.arange(1000, dtype=np.uint64), np.full(1000, 1000, np.uint64), np.full(1000, 5, np.uint64))
    assert sorted(p) == list(range(1000))
    assert slot_of(p.astype(np.uint64), np.full(1000, 1000, np.uint64), np.full(1000, 5, np.uint64)).tolist() == list(range(1000))


@pytest.mark.parametrize("sizes", [[30] * 300, [1, 2, 3, 1000], [129, 130, 700, 5, 128], [0, 50, 0, 7]])
def test_small_sources_meet_their_targets(spark, sizes):
    from vellum.llm.mixing import mix, mix_totals

    rows = [(i, " ".join(["w"] * n), f"s{i:03d}") for i, n in enumerate(sizes)]
    rows += [(1000 + i, " ".join(["w"] * (n // 2)), f"s{i:03d}") for i, n in enumerate(sizes)]
    for block in (16, 128):
        documents, pieces = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=block)
        out = mix_totals(documents, pieces).collect()
        taken = {s: sum(r.taken for r in out if r.source == s) for s in {r.source for r in out}}
        assert all(abs(taken[r.source] - r.target) <= 0.5 and r.taken <= 3 * r.size for r in out)
        assert pieces.filter("word_to <= word_from").count() == 0


@pytest.mark.parametrize("hot", [1, 5, 40])
def test_hot_grams_are_split_without_loss(spark, monkeypatch, hot):
    """One phrase between different texts in most documents: the same rows whether its grams are split or not."""
    import random

    from vellum.llm import passages, substrings, suffixes

    rng = random.Random(5)
    some = lambda n: [rng.choice(["ab", "cde", "fghi", "j", "klmno"]) + str(rng.randrange(40)) for _ in range(n)]
    phrase, long = some(24), some(60)
    rows = [(i, " ".join(some(rng.randrange(25)) + phrase + some(rng.randrange(25)) + long * (i % 5 == 0))) for i in range(120)]
    docs = spark.createDataFrame(rows + [(None, rows[3][1]), (7, rows[7][1]), (200, ""), (201, None)], "doc_id long, text string").repartition(6)
    whole = [sorted(map(repr, op.remove_repeats(docs).collect())) for op in (suffixes, substrings)]
    monkeypatch.setattr(passages, "HOT_COVERS", hot)
    monkeypatch.setattr(passages, "BUCKET_COVERS", 100)
    assert [sorted(map(repr, op.remove_repeats(docs).collect())) for op in (suffixes, substrings)] == whole
    # plain Python: words covered by 20 words that start earlier, in order of (id, text's place)
    given, first, want = sorted((i, t.split()) for i, t in rows if i != 7), {}, {}
    for i, w in given:
        gone = set()
        for k in range(len(w) - 19):
            if first.setdefault(tuple(w[k:k + 20]), (i, k)) != (i, k):
                gone |= set(range(k, k + 20))
        want[i] = len(gone)
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs.filter("doc_id < 200 and doc_id <> 7")).collect()}
    assert got == want


def test_shards_of_a_mix(spark):
    from vellum.llm.mixing import mix

    # three sources of 3,000 words, weights 1, 2, 3: targets 1500, 3000, 4500, slots of 10 words
    rows = [(100 * s + i, " ".join(["w"] * 60), "abc"[s]) for s in range(3) for i in range(50)]
    documents, pieces = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=10, shard_slots=64)
    slots = {(r.shard, r.place, r.source_no, r.slot) for r in pieces.collect()}
    assert len(slots) == 900 and {x[1] for x in slots if x[0] == 3} == set(range(64))
    # every shard but the last is full, and each place holds one slot
    assert sorted((x[0], x[1]) for x in slots) == [(k // 64, k % 64) for k in range(900)]
    # counts lie around the target shares, vary between shards, and sum to the quotas
    counts = [[sum(x[0] == k and x[2] == s for x in slots) for s in range(3)] for k in range(15)]
    assert [sum(c[s] for c in counts) for s in range(3)] == [150, 300, 450] and len({tuple(c) for c in counts}) > 5
    assert all(abs(c[s] - 64 * (s + 1) / 6) < 18 for c in counts[:14] for s in range(3))


def test_url_rules_and_model(spark):
    from vellum.llm.urls import judge_urls

    rows = [(i, f"http://good{i % 9}.example.org/fr/{i}") for i in range(200)] + [(1000 + i, f"http://spam{i % 9}.net/win/{i}") for i in range(200)]
    rows += [(2000, None), (2001, "no scheme"), (2002, "HTTP://A.Example.NET/en/x?q"), (2003, "http://spam3.com/win/7"),
             (2004, "http://good3.example.com/fr/9"), (2004, "http://good3.example.com/fr/9"), (None, "http://b.net")]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[2002].host, got[2002].path, got[2002].rule, got[2002].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert [got[i].verdict for i in (0, 1000, 2000, 2001, 2003, 2004)] == ["allow", "block", "allow", "allow", "block", "allow"]
    assert got[None].rule is None and got[2000].host == ""


@pytest.mark.parametrize("bucket", [7, 40, 8192])
def test_crowded_fingerprints(spark, bucket):
    import random

    from vellum.llm.graph import components
    from vellum.llm.simhash import links

    pick = random.Random(bucket)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = pick.getrandbits(64)
    fps = {base ^ pick.getrandbits(14) for _ in range(220)} | {pick.getrandbits(64) for _ in range(40)}  # 50 bits in common
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    want = {}
    for x in fps:
        want.setdefault(find(x), set()).add(signed(x))
    got = {}
    for r in components(links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), bucket=bucket)).collect():
        got.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1)


@pytest.mark.parametrize("size, symbols", [(300, 3), (500, 40), (70_000, 900)])
def test_matching_statistics(size, symbols):
    import numpy as np

    from vellum.llm.substrings import FMIndex, WaveletMatrix

    pick = np.random.default_rng(size)
    text = np.append(pick.integers(1, symbols, size), 0)
    text[200:240] = text[100:140]
    matrix = WaveletMatrix(text, symbols)
    for place in (0, 1, 63, 64, 257, size):
        assert [int(n) for n in matrix.rank(np.arange(symbols, dtype=np.uint64), np.full(symbols, place, np.uint64))] == \
            np.bincount(text[:place], minlength=symbols).tolist()
    plain = text.astype(">u2").tobytes()

    def often(a, b):  # occurrences of text[a:b], 2 at most
        i, n = plain.find(plain[2 * a:2 * b]), 0
        while i >= 0 and n < 2:
            n, i = n + (i % 2 == 0), plain.find(plain[2 * a:2 * b], i + 1)
        return n

    end = np.array([0, 5, 120, 139, 239, 260, size - 1])
    begin = np.maximum(end - 33, 0)
    length, row = FMIndex(text, symbols, 34).statistics(text, begin, end, 4)
    for b, e, n in zip(begin, end, length, strict=True):
        assert n == max(k for k in range(e - b + 2) if not k or often(e + 1 - k, e + 1) > 1)
    assert ((row >= 0) == (length >= 4)).all() and row[3] == row[4] and length[3] == length[4] >= 34


def test_url_grams_of_long_and_wide_texts(spark):
    from vellum.llm.urls import _grams

    parts = ["", "a", "a\nb\U0001F600\U0001F601c", "\u00e9/" * 40_000]
    texts = spark.createDataFrame(list(enumerate(parts)), "n long, part string")
    got = {r.n: r.grams for r in _grams(texts, 4).groupBy("n").agg({"gram": "collect_list"}).toDF("n", "grams").collect()}
    for n, p in enumerate(parts):
        padded = "\u0002" * 4 + p + "\u0003"
        assert sorted(got[n]) == sorted(padded[i:i + 5] for i in range(len(padded) - 4))


def test_url_scores_level_by_level(spark):
    import math
    import random

    from vellum.llm.urls import gram_scores

    pick = random.Random(5)
    train = {"".join(pick.choices("abc", k=5)): (pick.randrange(4), pick.randrange(4)) for _ in range(60)}
    wanted = ["".join(pick.choices("abcd", k=5)) for _ in range(80)]

    def p(gram, side):
        value = 1 / 4096
        for k in range(1, 6):
            tail = gram[-k:]
            after = {}
            for g, n in train.items():
                if g[-k:][:-1] == tail[:-1]:
                    after[g[-1]] = after.get(g[-1], 0) + n[side]
            total, kinds = sum(after.values()), sum(n > 0 for n in after.values())
            if total:
                value = (after.get(gram[-1], 0) + kinds * value) / (total + kinds)
        return value

    got = gram_scores(spark.createDataFrame([(g, *n) for g, n in train.items()], "gram string, accepted long, rejected long"),
                      spark.createDataFrame([(g,) for g in wanted], "gram string"), 4).collect()
    assert sorted(r.gram for r in got) == sorted(set(wanted))
    assert all(abs(float(r.score) - math.log(p(r.gram, 1) / p(r.gram, 0))) < 1e-8 for r in got)


def near_by_brute_force(docs, items, window, slack):
    """Proximity matches per document: every window laid at every place of its rarest word."""
    from collections import Counter

    often = Counter(w for _, t in docs for w in t.split())
    out = Counter()
    for text in items:
        words = text.split()
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            win = words[i:i + n]
            rare = min(range(n), key=lambda o: (often[win[o]], o))
            for key, t in docs:
                d = t.split()
                for s in (p - rare for p, w in enumerate(d) if w == win[rare]):
                    if s < 0 or s + n > len(d):
                        continue
                    far = [min((abs(p - s - o) for p, w in enumerate(d) if w == x), default=99) for o, x in enumerate(win)]
                    out[key] += max(far) <= slack and max(far) > 0
    return out


@pytest.mark.parametrize("options", [{}, {"block_words": 12}, {"block_words": 12, "max_terms": 3}])
def test_proximity_matches(spark, options):
    import random

    from vellum.llm.decontaminate import contamination

    pick = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    items = [" ".join(pick.choices(words, k=k)) for k in (1, 2, 4, 6, 9, 12, 15)] + ["", "absent w1 w2"]
    docs = [(i, " ".join(pick.choices(words, k=pick.randrange(40)))) for i in range(60)]
    for i in range(60, 80):  # an item with two neighbours changed over, and one cut off at the end of its document
        it = items[5].split()
        at = pick.randrange(len(it) - 1)
        docs.append((i, " ".join(it[:at] + [it[at + 1], it[at]] + it[at + 2:])))
        docs.append((i + 100, " ".join(it[:at])))
    out = contamination(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2),
                        spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string"),
                        window=5, slack=2, **options).collect()
    near = near_by_brute_force(docs, items, 5, 2)
    assert {r.doc_id: r.n_near for r in out} == {i: near[i] for i, _ in docs} and sum(near.values()) > 20
    for r in out:
        d = f" {dict(docs)[r.doc_id]} "
        own = {str(i) for i, t in enumerate(items) if any(f" {' '.join(t.split()[s:s + 5])} " in d for s in range(max(1, len(t.split()) - 4)) if t)}
        assert r.n_items == len(own) and r.contaminated == bool(own)


def test_licenses(spark):
    from vellum.llm.licenses import license_scan

    rows = [(1, "Released under the MIT License.", "/a/LICENSE"), (2, "words", "/a/b/x"), (3, None, "/c/y"),
            (4, "many words " * 40 + "\nLicensed under the Apache License, Version 2.0.", "/a/b/z"), (None, "t", None)]
    got = {r.doc_id: (r.license, r.origin) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got == {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: (None, None), 4: ("Apache-2.0", "own"), None: (None, None)}


def test_license_words_outside_the_templates(spark):
    import math

    from vellum.llm.licenses import license_scan

    # a header whose other words every second text holds: their weight must not grow with the number of texts
    prose, header = "you may not use this file except in compliance with what others said", "Licensed under the Apache License, you may not use this file"
    template = (("Apache-2.0", "Licensed under the Apache License, Version 2.0."),)
    for n in (60, 2000):
        rows = [(i, prose if i % 2 else "other words", "x") for i in range(n)] + [(n, header, "x")]
        got = {r.doc_id: r.score for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string, path string"), templates=template).collect()}
        split = lambda t: re.findall("[a-z0-9]+", t.lower())
        idf = lambda w: math.log((2 + n) / (1 + sum(w in split(t) for _, t, _ in rows))) + 1
        vectors = [{w: split(t).count(w) * idf(w) for w in split(t)} for t in (header, template[0][1])]
        dot = sum(x * vectors[1].get(w, 0) for w, x in vectors[0].items())
        assert got[n] == pytest.approx(dot / math.prod(math.sqrt(sum(x * x for x in v.values())) for v in vectors))


def test_license_files_and_headers(spark):
    from vellum.llm.licenses import full_texts, license_scan

    full = dict(full_texts())
    code = "\n".join(f"def name{i}(value{i}): return value{i} + other{i}" for i in range(60))
    notice = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
              "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    texts = {f"/{n}/LICENSE": f"Copyright (c) 2020 A. Person\n\n{t}" for n, t in full.items()} | {f"/{n}/src/a.py": code for n in full}
    texts |= {"/h/a.py": "\n".join(f"# {x}" for x in notice) + "\n\n" + code, "/h/a.c": "/*\n * Copyright\n *\n" + "".join(f" * {x}\n" for x in notice) + " */\n" + code,
              "/h/m.c": "/*\n" + "".join(f" * {x}\n" for x in full["MIT"].split("\n")) + " */\n" + code, "/h/b.py": code,
              "/h/one.txt": code.replace("\n", " ") + ". Released under the MIT License. " + code.replace("\n", " ")}
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string").join(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, path string"), "doc_id")
    got = {r.path: (r.license, r.origin) for r in license_scan(docs).collect()}
    want = {f"/{n}/LICENSE": (n, "file") for n in full} | {f"/{n}/src/a.py": (n, "inherited") for n in full}
    want |= {"/h/a.py": ("GPL-3.0", "own"), "/h/a.c": ("GPL-3.0", "own"), "/h/m.c": ("MIT", "own"), "/h/b.py": (None, None), "/h/one.txt": ("MIT", "own")}
    assert got == want


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4])
def test_runs_by_words(spark, min_lines):
    from vellum.llm.lines import drop_repeated_runs

    long = [" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 50), ("b", 49), ("c", 30), ("d", 20))]
    texts = ["\n".join(long), f"new\n{long[0]}\nother", f"{long[1]}\nx y", long[0], f"u\n{long[2]}\n\n{long[3]}\nv", f"{long[2]}\nw\n{long[3]}",
             f"{long[0]}\nq\n{long[0]}", f"{long[1]}\n{long[2]}\ne"]
    split = [[x for x in t.split("\n") if x] for t in texts]
    first, want = {}, {}
    for i, own in enumerate(split):
        gone = set()
        for k in range(len(own)):
            for n in range(1, len(own) - k + 1):
                run = tuple(own[k:k + n])
                again = first.setdefault(run, (i, k)) != (i, k)
                if again and (n == min_lines or n < min_lines and len(" ".join(run).split()) >= 50):
                    gone |= set(range(k, k + n))
        want[i] = (len(own), len(gone), [x for k, x in enumerate(own) if k not in gone])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_removed, [x for x in r.text.split("\n") if x]) for r in drop_repeated_runs(docs, min_lines=min_lines, min_words=50).collect()}
    assert got == want and want[1][1] == 1 and want[3][1] == 1
    if min_lines == 2:  # without min_words lines alone count
        assert {r.doc_id: r.n_removed for r in drop_repeated_runs(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 2, 5: 0, 6: 0, 7: 2}


def test_line_stage_keeps_columns_of_its_own_names(spark):
    from vellum.llm.lines import drop_repeated_runs

    rows = [(1, "a b\nc d\ne", 7, "x"), (2, "a b\nc d\nf", 8, "y"), (3, "a b\nc d", 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_removed string")
    out = corpus_pipeline.line_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a b\nc d\ne", 7, "x"), (2, "f", 8, "y")]
    counted = drop_repeated_runs(docs, counts=("all_lines", "gone"))
    assert {r.doc_id: (r.all_lines, r.gone, r.n_lines) for r in counted.collect()} == {1: (3, 0, 7), 2: (3, 2, 8), 3: (2, 2, 9)}
    with pytest.raises(ValueError):
        drop_repeated_runs(docs)


def test_empty_tables(spark, docs, tmp_path):
    for t, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string"),
                      ("benchmark", "item_id long, text string"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_pipeline_stages(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"c{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, given, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == given.columns
        out.write.parquet(f"{tmp_path}/{k}.parquet")
        given = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        ids[name] = sorted(r.doc_id for r in given.select("doc_id").collect())
    assert ids["quality_rules"] == [5, 5, 6, 7, 15]  # 20 words at least, not mostly repeats
    assert ids["line_dedup"] == [5, 5, 6, 15]  # 7 is one long line that 5 holds as well
    assert ids["simhash"] in ([5, 6, 15], [5, 15])
    assert 15 not in ids["decontaminate"] and 5 in ids["decontaminate"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(ORACLE[name])
    df = QUERIES[name](spark, SF)
    assert sorted(map(repr, df.select(*[F.col(c) for c in rel.columns]).collect())) and sorted(df.columns) == sorted(rel.columns)
    assert sorted(tuple(r) for r in df.select(*rel.columns).collect()) == sorted(rel.fetchall())
