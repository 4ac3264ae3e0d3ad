"""Operator 12 against a version that walks both token lists with sets of ends."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF001
from vellum.llm.alignment import FOLDER, _ids, _tokenized, align, byte_level_bpe, leaf_groups, overlaps, piece_model
from vellum.llm.queries import op12_alignment

ROWS = [(1, "The quick brown fox", "x"), (2, None, "x"), (3, "", "x"), (4, "  two  spaces\n\nlines <|endoftext|> <s> </s>", "x"),
        (5, "ação über 東京 \U0001f600 <0x41>", "x"), (6, "a▁b", "x"), (6, "The quick brown fox", "x"), (None, "fox", "x"),
        (7, "1234567890 " * 300, "x"), (8, " ", "x"), (9, "café ﬁ", "x")]


def plain(texts):
    """Per text the contract's columns, with the public libraries' own encoders and plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tok = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    letters = byte_letters(ByteLevel)
    docs = []
    for text in texts:
        a, b = (tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        ab = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and not b"".join(ab) == b"".join(bb) == (" " + text).encode():
            a, b, ab, bb = [], [], [], []
        spans = []
        for names in (ab, bb):
            at, own = 0, []
            for x in names:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, own) if low < e <= c) for ids, own in zip((a, b), spans)))
            low = c
        links, j0 = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while j0 < len(spans[1]) and spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        docs.append((a, b, groups, links))
    count = Counter(x for d in docs for x in d[3])
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(len(a), len(b), len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x),
             sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, x in docs]


def byte_letters(byte_level):
    """The byte that each letter of the byte-level alphabet stands for, read off the library's own encoding of single bytes."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in kept}
    out |= {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in kept)}
    assert set(out) == set(byte_level.alphabet())
    return out


def columns(r):
    return tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


def test_small_cases(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, chunk string")
    for size in (1 << 22, 30):
        out = align(df, chunk_bytes=size, digest=True).withColumnRenamed("groups", "groups_sha256").collect()
        want = sorted(zip([r[0] for r in ROWS], plain([r[1] for r in ROWS])), key=str)
        assert sorted(((r.doc_id, columns(r)) for r in out), key=str) == want
    texts = {r.doc_id: r.groups for r in align(df).collect() if r.doc_id == 1}
    assert sha256(texts[1].encode()).hexdigest() == plain(["The quick brown fox"])[0][-1] and "|" in texts[1]
    assert align(df.limit(0)).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    out = {r.doc_id: columns(r) for r in op12_alignment(spark, SF001).collect()}
    assert out == dict(zip([d.doc_id for d in docs], plain([d.text for d in docs])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.data()), min_size=1, max_size=3))
def test_cuts_and_links(texts):
    a, b, a_to, b_to, at = [], [], [], [], 0
    for lengths, data in texts:
        ends = list(np.cumsum(lengths) + at)
        other = sorted(data.draw(st.sets(st.integers(at + 1, int(ends[-1])))) | {int(ends[-1])})
        a, b, at = a + ends, b + other, int(ends[-1])
        a_to.append(len(a))
        b_to.append(len(b))
    a, b = np.array(a), np.array(b)
    ga, gb = leaf_groups(a, b, np.array(a_to), np.array(b_to))
    shared = sorted(set(a.tolist()) & set(b.tolist()))
    assert a[ga - 1].tolist() == b[gb - 1].tolist() == shared
    la, lb = overlaps(a, b)
    start = lambda x: [0, *x[:-1].tolist()]
    sa, sb = start(a), start(b)
    assert list(zip(la.tolist(), lb.tolist())) == [(i, j) for i in range(len(a)) for j in range(len(b)) if sa[i] < b[j] and sb[j] < a[i]]


@pytest.mark.parametrize("text", ["x" * 2000, "<|endoftext|>", "\u0000\u0001", "\r\n\t   　 a", "don't we'll I'm"])
def test_engines_agree(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    assert byte_level_bpe(f"{FOLDER}/byte_bpe_50k.json")[0](text).tolist() == tok.encode(text, add_special_tokens=False).ids


def tokenizers_of():
    return byte_level_bpe(f"{FOLDER}/byte_bpe_50k.json"), piece_model(f"{FOLDER}/piece_bpe_32k.model")


def per_text(texts, tok_a, tok_b):
    """Each text's ids, put together from its entries'."""
    word, to, a, b, ends = _tokenized(texts, tok_a, tok_b)
    own = []
    for ids, names in ((a, tok_a[1]), (b, tok_b[1])):
        at = np.searchsorted(np.cumsum([len(names[i]) for i in ids]), ends, "right")
        own.append([x.tolist() for x in np.split(ids, at)])
    return [tuple([i for w in word[f:t] for i in o[w]] for o in own) for f, t in zip([0, *to[:-1]], to)]


def whole(texts, tok_a, tok_b):
    found = [_ids(b" " + x, tok_a, tok_b) if x else None for x in texts]
    return [tuple(x.tolist() for x in f) if f else ([], []) for f in found]


PARTS = st.sampled_from(["the", " ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x00", "'s", "'", "!", "...", "é", "ção", "東京", "▁", "12", "7",
                         "\u0301", "\U0001f600", "fox", "a", "B", "#", "<s>", "<0x41>", "<|endoftext|>", "\r\n", "ﬁ", "\u2028", "\u200b", "\x7f"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), max_size=6))
def test_words_have_the_tokens_of_whole_texts(texts):
    toks = tokenizers_of()
    raw = [t.encode() for t in texts]
    assert per_text(raw, *toks) == whole(raw, *toks)
    uncut = [(*t[:2], False) for t in toks]
    assert per_text(raw, *uncut) == whole(raw, *toks)


def test_a_word_is_tokenized_once_per_chunk():
    seen = []
    toks = [(lambda text, f=t[0]: seen.append(text) or f(text), *t[1:]) for t in tokenizers_of()]
    texts = [" ".join(f"word{(i * j) % 50}" for j in range(400)).encode() for i in range(40)]
    got = per_text(texts, *toks)
    assert sum(map(len, seen)) < sum(map(len, texts)) / 10
    assert got == whole(texts, *tokenizers_of())
