"""The queries without SQL, and the whole pipeline, against plain Python over a small scale's whole tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

import corpus_pipeline
from vellum.llm import licenses, quality, urls
from vellum.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: [r.asDict() for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()]
            for t in ("documents", "labels", "benchmark", "pages")}


def words(text):
    return (text or "").encode().split()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ------------------------------------------------------------- plain versions
def plain_counts(text):
    w = words(text)
    seen = defaultdict(list)
    for k in range(len(w) - 7):
        seen[tuple(w[k:k + 8])].append(k)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return {"n_words": len(w), "word_chars": sum(len(x.decode()) for x in w), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", text or "")),
            "n_repeat_words": len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)})}


def plain_quality(docs, labels, risk=0.02, error=0.05):
    good = {}
    for r in labels:
        good[r["doc_id"]] = min(good.get(r["doc_id"], 1), r["quality"])
    rows = []
    for d in docs:
        c = plain_counts(d["text"])
        failed = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
        part = lambda a, b: c[a] / c[b] if c[b] else 0
        shares = {"symbol_share": part("n_symbols", "n_words"), "upper_share": part("n_upper", "word_chars"),
                  "dup_line_share": part("n_dup_lines", "n_lines"), "repeat_share": part("n_repeat_words", "n_words")}
        rows.append((d, c, failed, shares, d["lang"] or ""))
    cutoffs = {}
    for stratum in {r[4] for r in rows}:
        own = [r for r in rows if r[4] == stratum and not r[2] and good.get(r[0]["doc_id"]) == 1]
        for rule in quality.RULES:
            p = risk / len(quality.RULES)
            for cutoff in quality.GRID:
                k = sum(r[3][rule] > cutoff for r in own)
                if sum(math.comb(len(own), i) * p**i * (1 - p) ** (len(own) - i) for i in range(k + 1)) > error / len(quality.RULES):
                    break
                cutoffs[stratum, rule] = cutoff
    return [(d, c, failed, not failed and not any(x > cutoffs.get((s, r), math.inf) for r, x in shares.items()))
            for d, c, failed, shares, s in rows]


def runs_of(lines):
    """Two lines, or one of 50 words."""
    return [(k, p) for k, p in enumerate(zip(lines, lines[1:]))] + [(k, (x,)) for k, x in enumerate(lines) if len(words(x)) >= 50]


def plain_lines(docs):
    seqs = {d["doc_id"]: [x for x in (d["text"] or "").split("\n") if x.strip(" \t\n\v\f\r")] for d in docs}
    first, out = {}, []
    for i in sorted(seqs):
        for k, pair in runs_of(seqs[i]):
            first.setdefault(pair, (i, k))
    for d in docs:
        own = seqs[d["doc_id"]]
        gone = {k + j for k, run in runs_of(own) if first[run] != (d["doc_id"], k) for j in range(len(run))}
        if own and len(gone) == len(own):
            continue
        at, kept = -1, []
        for x in (d["text"] or "").split("\n"):
            at += bool(x.strip(" \t\n\v\f\r"))
            if not (x.strip(" \t\n\v\f\r") and at in gone):
                kept.append(x)
        text = "\n".join(kept) if gone else d["text"]
        out.append({**d, "text": text, "n_chars": len(text) if gone else d["n_chars"]})
    return out


def plain_simhash(docs):
    def print_of(text):
        w = words(lower(text))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [(d["doc_id"], print_of(d["text"])) for d in docs]
    group = {i: i for i, _ in fps}
    for a, x in fps:
        for b, y in fps:
            if (x ^ y).bit_count() <= 3 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    return {i: (f"{f:016x}", group[i]) for i, f in fps}


def plain_clean(docs, benchmark):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for b in benchmark:
        w = split(b["text"])
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[n].add(tuple(w[k:k + n]))
    held = lambda w: any(tuple(w[k:k + n]) in own for n, own in windows.items() for k in range(len(w) - n + 1))
    return [d for d in docs if not held(split(d["text"]))]


def plain_index(i, size, key):
    """A balanced Feistel network of 6 rounds over the next power of 4, walked until the value is below ``size``."""
    bits, whole = 1, (1 << 64) - 1
    while 1 << 2 * bits < size:
        bits += 1
    low = (1 << bits) - 1
    while True:
        left, right = i >> bits, i & low
        for r in range(6):
            f = (right + key + r + 1) * 0x9E3779B97F4A7C15 & whole
            f = (f ^ f >> 29) * 0xBF58476D1CE4E5B9 & whole
            left, right = right, left ^ ((f ^ f >> 32) & low)
        i = left << bits | right
        if i < size:
            return i


def plain_mix(docs, seed=7):
    size = {d["doc_id"]: len(words(d["text"])) for d in docs}
    sources = sorted({d["source"] for d in docs if d["source"] is not None}) + [None] * any(d["source"] is None for d in docs)
    total = {s: sum(size[d["doc_id"]] for d in docs if d["source"] == s) for s in sources}
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    target, left, free = {}, sum(total.values()), set(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 3 * total[s] < level * weight[s]}
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        target.update({s: 3.0 * total[s] for s in over})
        left, free = left - sum(3 * total[s] for s in over), free - over
    out = {}
    for s in sources:
        stream = [i for i in sorted(d["doc_id"] for d in docs if d["source"] == s) for _ in range(size[i])]
        blocks = -(-len(stream) // 128)
        passes = int(target[s] // total[s]) if total[s] else 0
        due = passes * total[s] + math.floor(target[s] - passes * total[s] + 0.5)
        taken, k = Counter(), -1
        while taken.total() < due:
            k += 1
            key = zlib.crc32(b"\xff" if s is None else s.encode(), seed) + (seed << 32)
            b = plain_index(k % blocks, blocks, key + k // blocks * 1000003)
            block = stream[b * 128:(b + 1) * 128]
            taken.update(block[:due - taken.total()])
        for d in docs:
            if d["source"] == s:
                out[d["doc_id"]] = (size[d["doc_id"]], total[s], round(target[s], 6), taken[d["doc_id"]])
    return out


# ---------------------------------------------------------------------- tests
def test_quality_cutoffs(spark, tables):
    # enough labels that cutoffs are justified: every document that isn't mostly symbols or capitals is called good
    labels = [{"doc_id": d["doc_id"], "quality": int(plain_counts(d["text"])["n_symbols"] < 9)} for d in tables["documents"]]
    docs = [{**d, "lang": "en"} for d in tables["documents"]]
    for risk, error in ((0.02, 0.05), (0.3, 0.3), (0.6, 0.4)):
        got = quality.quality_rules(spark.createDataFrame(docs), spark.createDataFrame(labels), risk=risk, error=error).collect()
        want = {d["doc_id"]: (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"], failed, kept)
                for d, c, failed, kept in plain_quality(docs, labels, risk, error)}
        assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
                for r in got} == want
    assert any(not kept and not failed for *_, failed, kept in want.values())


def test_mixing(spark, tables):
    got = {r.doc_id: (r.size, r.source_size, round(r.target, 6), r.taken) for r in QUERIES["op3_mixing"](spark, SF).collect()}
    assert got == plain_mix(tables["documents"])


def test_licenses(spark, tables):
    docs = [(f"{d['source']}/{d['lang']}/{d['doc_id'] // 100}", d) for d in tables["documents"]]
    split = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    df = Counter(w for _, d in docs if d["text"] is not None for w in set(split(d["text"])))
    n = sum(d["text"] is not None for _, d in docs)
    known = {w for _, t in licenses.TEMPLATES for w in split(t)}
    idf = lambda w: math.log((1 + n) / (1 + (df[w] if w in known else 0))) + 1

    def vector(text):
        v = {w: k * idf(w) for w, k in Counter(split(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    templates = [(name, vector(t)) for name, t in licenses.TEMPLATES]
    own, folders = {}, {}
    for folder, d in docs:
        found = []
        for x in set((d["text"] or "").split("\n")):
            v = vector(x)
            for name, t in templates:
                score = round(sum(v.get(w, 0) * y for w, y in t.items()), 9)
                if score >= 0.6:
                    found.append((-score, name, -len(x) / len(d["text"])))
        if found:
            best = own[d["doc_id"]] = min(found)
            if -best[2] >= 0.3:
                folders[folder] = min(folders.get(folder, best), best)
    want = {}
    for folder, d in docs:
        parts = folder.split("/")
        up = ["/".join(parts[:k]) for k in range(len(parts), -1, -1)]
        near = next((p for p in up if p in folders), None)
        if d["doc_id"] in own:
            score, name, share = own[d["doc_id"]]
            want[d["doc_id"]] = (name, "file" if -share >= 0.3 else "own", round(-score, 6), None)
        else:
            want[d["doc_id"]] = (folders[near][1] if near is not None else None, "inherited" if near is not None else None, None, near)
    got = {r.doc_id: (r.license, r.origin, r.score and round(r.score, 6), r.license_dir)
           for r in QUERIES["op1_license_scan"](spark, SF).collect()}
    assert got == want and {o for _, o, *_ in want.values()} >= {"own"}


def test_url_model(spark, tables):
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    of = {}
    for i, url in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        rule = next((r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), None)
        of[i] = (host, path, rule)
    label = {h + p: (r and r[0]) for h, p, r in of.values()}
    held = {x: xxhash.xxh64_intdigest(x.encode(), 42) for x in label}
    held = {x: (h - (1 << 64) if h >> 63 else h) % 5 == 0 for x, h in held.items()}
    grams = lambda x: [("\2" * 4 + x + "\3")[k:k + 5] for k in range(len(x) + 1)]
    counts = {"allow": Counter(), "block": Counter()}
    for x, verdict in label.items():
        if x and (verdict == "block" or verdict == "allow" and not held[x]):
            counts[verdict].update(g[-k:] for g in grams(x) for k in range(1, 6))
    heads = {v: defaultdict(lambda: [0, 0]) for v in counts}
    for v, c in counts.items():
        for g, k in c.items():
            heads[v][g[:-1]][0] += k
            heads[v][g[:-1]][1] += 1

    def chance(v, g):
        p = 1 / 4096
        for k in range(1, 6):
            n, types = heads[v].get(g[-k:][:-1], (0, 0))
            p = (counts[v][g[-k:]] + types * p) / (n + types) if n else p
        return p

    score = {x: sum(math.log(chance("block", g) / chance("allow", g)) for g in grams(x)) / (len(x) + 1) for x in label if x}
    got = {r.page_id: r for r in QUERIES["op4_url_filter"](spark, "/root/testdata/sf0.01").collect()}
    accepted = sorted((score[x] for x in score if label[x] == "allow" and held[x]), reverse=True)
    trained = any(v == "block" for v in label.values()) and any(v == "allow" and not held[x] for x, v in label.items() if x)
    cutoff = None
    if trained and accepted:
        steps = Counter(math.ceil(round(s, 6) * 100) for s in accepted)
        above = 0
        for step in sorted(steps, reverse=True):
            above += steps[step]
            if above > 0.05 * len(accepted):
                cutoff = max(step / 100, 0.0)
                break
    assert len(got) == len(pages)
    for i, (host, path, rule) in of.items():
        r, x = got[i], host + path
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1] + rule[2])
        if x:
            assert abs(r.score - score[x]) < 1e-5
        if rule:
            assert r.verdict == rule[0]
        elif not x or cutoff is None:
            assert r.verdict == "allow"
        elif abs(score[x] - cutoff) > 1e-5:
            assert r.verdict == ("block" if score[x] > cutoff else "allow")


def test_pipeline(spark, tables):
    docs = [d for d, _, _, kept in plain_quality(tables["documents"], tables["labels"]) if kept]
    docs = plain_lines(docs)
    first = plain_simhash(docs)
    docs = [d for d in docs if first[d["doc_id"]][1] == d["doc_id"]]
    docs = plain_clean(docs, tables["benchmark"])
    want = {i: v for i, v in plain_mix(docs).items() if v[3] > 0}
    texts = {d["doc_id"]: (d["text"], d["n_chars"]) for d in docs}
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len({r.doc_id for r in got})
    assert {r.doc_id: (r.size, r.source_size, round(r.target, 6), r.taken) for r in got} == want
    assert all((r.text, r.n_chars) == texts[r.doc_id] for r in got)


def test_simhash(spark, tables):
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, SF).collect()} == plain_simhash(tables["documents"])
