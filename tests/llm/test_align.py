import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import ODD, TABLES
from trendloom.llm import align, queries
from trendloom.llm.align import align_documents, align_texts, pair_counts
from trendloom.llm.queries import tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    return a, sentencepiece.SentencePieceProcessor(model_file=B), names


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(A, B)


def plain(libraries, text):
    """ids of A and B, groups, links by comparing all byte ranges; None without tokens."""
    a, b, names = libraries
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    tokens_a = [bytes(names[c] for c in a.id_to_token(i)) for i in ids_a]
    tokens_b = []
    for i in ids_b:
        piece = b.id_to_piece(i)
        tokens_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(tokens_a) != whole or b"".join(tokens_b) != whole:
        return None

    def spans(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    a_spans, b_spans = spans(tokens_a), spans(tokens_b)
    cuts = {e for _, e in a_spans} & {e for _, e in b_spans}
    groups = []
    for ids, spans in ((ids_a, a_spans), (ids_b, b_spans)):
        one, group = [], []
        for i, (_, end) in zip(ids, spans):
            group.append(str(i))
            if end in cuts:
                one.append(",".join(group))
                group = []
        groups.append(one)
    groups = ["|".join(g) for g in zip(*groups, strict=True)]
    links, j = [], 0
    for i, (s, e) in zip(ids_a, a_spans):
        while j and b_spans[j - 1][1] > s:
            j -= 1
        while b_spans[j][1] <= s:
            j += 1
        for k in range(j, len(b_spans)):
            if b_spans[k][0] >= e:
                break
            links.append((i, ids_b[k]))
    return ids_a, ids_b, groups, links


def expected(libraries, rows):
    found = [(d, plain(libraries, t)) for d, t in rows]
    total = Counter(p for _, f in found if f for p in f[3])
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((d, len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(total[p] == most[p[1]] for p in f[3]),
                        sum(total[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))
    return out, total


def same(aligner, libraries, text):
    (chunks,), wanted = aligner.align([text]), plain(libraries, text)
    if wanted is None:
        assert chunks is None
        return
    assert ";".join(c.groups for c in chunks) == ";".join(wanted[2]), text
    codes = sorted(code for c in chunks for code in np.frombuffer(c.codes, np.int64).tolist())
    assert codes == sorted(a * aligner.width + b for a, b in wanted[3])
    assert (sum(c.n_a for c in chunks), sum(c.n_b for c in chunks)) == (len(wanted[0]), len(wanted[1]))


@given(st.text(max_size=60))
@settings(max_examples=250, deadline=None)
def test_any_text(aligner, libraries, text):
    same(aligner, libraries, text)


@given(st.text(alphabet="abst'SDé.,!0 \t\n\r\x0b\x1c\x1f\x85\xa0   　▁<>|x日", max_size=40))
@settings(max_examples=500, deadline=None)
def test_borders_at_spaces(aligner, libraries, text):
    same(aligner, libraries, text)


@pytest.mark.parametrize("text", [
    " ", "  ", "   a", "a ", " \n ", "<|endoftext|>", "x <|endoftext|> y", "<s> </s> <unk> <0x41>", "﻿a", "\x00 a",
    "ab" * 4000, "It's  we'll\r\n\r\nTHEY'RE", "🙂‍🙂 ok", "a▁b"])
def test_given_texts(aligner, libraries, text):
    same(aligner, libraries, text)


def test_walk():
    size_a, size_b = [2, 2, 3], [3, 1, 1, 2]
    chunk = align.align_tokens([0, 1, 2], [0, 1, 2, 3], size_a, size_b, 10)
    assert chunk[:4] == (3, 4, 2, "0,1|0,1;2|2,3")
    assert np.frombuffer(chunk.codes, np.int64).tolist() == [0, 10, 11, 22, 23]


@given(st.text(alphabet=[chr(i) for i in [*range(32, 127), *range(0xC0, 0x100)]], max_size=50))
@settings(max_examples=400, deadline=None)
def test_plain_letters(aligner, libraries, text):
    assert aligner.quick
    same(aligner, libraries, text)


def test_forgets(libraries, monkeypatch):
    monkeypatch.setattr(align, "_MEMO_CHUNKS", 3)
    monkeypatch.setattr(align, "_MEMO_LENGTH", 4)
    small = align.Aligner(A, B)
    for text in ("a b c", "longer words", "d e f g a b c", "c b a the of the"):
        same(small, libraries, text)
        assert "longer" not in small.known
    same(small, libraries, "x")
    assert set(small.known) == {"x"}


def test_sample_against_brute_force(spark, sample, libraries):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    wanted, _ = expected(libraries, rows)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = queries.op12_cross_tokenizer(spark, TABLES)
    assert sorted(tuple(r) for r in found.select(*names).collect()) == sorted(wanted)


@pytest.mark.parametrize("broadcast_pairs", [0, 1 << 20])
def test_odd_rows(spark, documents, libraries, broadcast_pairs):
    rows = [*ODD, (5, "one"), (5, "one two"), (None, "one"), (None, None), (20, "a▁b"), (21, " two  spaces ")]
    docs = documents(rows).withColumnRenamed("fp", "a.b").withColumnRenamed("n_words", "code")
    found = [tuple(r) for r in align_documents(docs, A, B, broadcast_pairs=broadcast_pairs).collect()]
    assert sorted(found, key=str) == sorted(expected(libraries, rows)[0], key=str)
    assert align_documents(docs.limit(0), A, B, broadcast_pairs=broadcast_pairs).count() == 0


def test_copies_count(spark, documents, libraries):
    rows = [(i, "the cat sat") for i in range(50)] + [(99, "the dog"), (100, "a  catalogue")]
    texts = align_texts(documents(rows), A, B).persist()
    assert sorted(r.copies for r in texts.collect()) == [1, 1, 50]
    width = align._width(B)
    _, total = expected(libraries, rows)
    pairs = pair_counts(texts, width).collect()
    assert {(r.id_a, r.id_b): r.total for r in pairs} == dict(total)
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    assert all(r.best == (r.total == most[r.id_b]) for r in pairs)
    texts.unpersist()
