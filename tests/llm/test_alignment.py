"""Alignment of two tokenizers against both libraries on whole texts and groups by definition."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from huntframe.llm import alignment, bpe, queries

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
A, B = queries.vocabulary(), queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def groups_by_hand(libraries, text):
    """[(ids of A, ids of B), ...] of a whole text; none if the bytes differ."""
    a, b = libraries
    if not text:
        return []
    alphabet = bpe.byte_alphabet()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    ends_a, ends_b = (set(np.cumsum([len(x) for x in xs]).tolist()) for xs in (bytes_a, bytes_b))
    out, at_a, at_b, i, j = [], 0, 0, 0, 0
    for end in sorted(ends_a & ends_b):
        one, two = [], []
        while at_a < end:
            one.append(ids_a[i])
            at_a += len(bytes_a[i])
            i += 1
        while at_b < end:
            two.append(ids_b[j])
            at_b += len(bytes_b[j])
            j += 1
        out.append((one, two))
    return out


def by_hand(libraries, docs):
    each = [groups_by_hand(libraries, text) for _, text in docs]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in each]
    n = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (x, _), k in n.items():
        most[x] = max(most[x], k)
    out = []
    for (doc, _), groups, c in zip(docs, each, links, strict=True):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best, total = sum(k for p, k in c.items() if n[p] == most[p[0]]), sum(k * n[p] for p, k in c.items())
        numbers = sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(c.values())
        out.append((doc, *numbers, best, total, sha256(written.encode()).hexdigest() if written else ""))
    return out


def fuzzed(n=600):
    rnd = random.Random(11)
    alphabet = "abcdefghijklmnop   etaoin\n\t.,'0123456789ÄÖéñ中文字🙂 ́▁ 　"
    return ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(n)]


EDGE = ["", None, " ", "  ", "a", " a", "a ", "a  b", "  two  spaces  ", "<|endoftext|>", "a <s> b </s> <unk> <0x41>", "a▁b", "▁", "x\x00y", "don't we'll I'VE", "é" * 50, "ab" * 3000, "\U0010ffff", "tab\there new\nline \r\n end", "a ́b", "﻿bom", "word " * 2000]


def test_documents_and_counts_by_hand(spark, libraries):
    texts = [*EDGE, *fuzzed(), "same words here", "same words here", "same words here again"]
    docs = [(None if i % 50 == 7 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_a int").repartition(5)
    want = sorted(by_hand(libraries, docs), key=repr)
    for most in (alignment.MOST_FREQUENT, 100, 1):
        got = alignment.align(df, A, B, most)
        assert sorted(map(tuple, got.collect()), key=repr) == want, most
    assert any(r[1] > r[3] for r in want) and sum(r[-1] == "" for r in want) > 20


def test_what_is_broadcast_has_its_bound(spark):
    texts = [(i, t) for i, t in enumerate(fuzzed(200) + ["the same passage"] * 40)]
    table = alignment.store.written(alignment.aligned(spark.createDataFrame(texts, "doc_id long, text string"), A, B), "aligned")
    counts = alignment.pair_counts(table)
    total = counts.agg(F.sum("n")).first()[0]
    for most in (10, 100, 1000):
        assert counts.where(F.col("n") >= -(-total // most)).count() <= most


def test_forgetting_changes_nothing(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CHARS_KEPT", 300)
    tool = alignment.Aligner(A, B)
    texts = [t for t in fuzzed(200)]
    for i in range(0, len(texts), 7):
        numbers, written, *_ = tool.documents(texts[i : i + 7])
        for t, x, w in zip(texts[i : i + 7], numbers, written, strict=True):
            groups = groups_by_hand(libraries, t)
            assert x.tolist()[2] == len(groups) and w.decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    assert tool.chars <= 900


def test_links_in_parts_are_the_same():
    rnd = np.random.default_rng(3)
    in_a, in_b = rnd.integers(1, 30, 50), rnd.integers(1, 30, 50)
    a, b = rnd.integers(0, 9, in_a.sum()), rnd.integers(0, 9, in_b.sum())
    owner = np.sort(rnd.integers(0, 5, 50))
    whole = alignment.linked(a, b, in_a, in_b, owner)
    for most in (1, 10, 1000):
        assert all((x == y).all() for x, y in zip(whole, alignment.linked(a, b, in_a, in_b, owner, most), strict=True))


def test_a_long_text(spark, libraries):
    docs = [(1, "the quick 12 über-fox  " * 20_000 + "z" * 30_000), (2, "the quick")]
    got = alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), A, B)
    assert sorted(map(tuple, got.collect())) == by_hand(libraries, docs)


def test_no_documents(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_query_over_the_table(spark, sf, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_alignment(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(by_hand(libraries, docs))
