"""BPE against the library, language-model scores and toxicity."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from huntframe.llm import bpe, lm_score, queries, toxicity
from tests import oracle

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def bpe_texts():
    rnd = random.Random(6)
    alphabet = "abcdefghijklmnop  etaoin\n\t.,'0123456789ÄÖéñ中文字🙂 ́'"
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 80))) for _ in range(400)]
    return [*texts, "", "a", " ", "  x", "<|endoftext|>", "a<|endoftext|>b<|endof", "don't we'll I'VE", "x" * 5000, "ab" * 3000, "\x00\x7f", "the " * 3000, "\U0010ffff", "é" * 50]


def test_bpe_is_that_of_the_library(library):
    codec = bpe.Codec(queries.vocabulary())
    texts = bpe_texts()
    ids = codec.encode_batch(texts)
    for t, x in zip(texts, ids, strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(x, "<u4").tolist() == want, t[:60]
        assert codec.decode(x) == library.decode(want, skip_special_tokens=False) == t
    assert 0 < codec.merged < len(codec.known)


def test_exact_merging_alone_gives_the_same():
    codec, texts = bpe.Codec(queries.vocabulary()), bpe_texts()
    for w in {w for t in texts for w in codec.words.findall(t)}:
        codec.learn([w])
        assert np.frombuffer(codec.known[w], "<u4").tolist() == codec.merged_exactly(w.encode())


def test_texts_of_many_megabytes(spark, library):
    text = "the quick 12 über-fox  " * 200_000 + "z" * 300_000
    df = spark.createDataFrame([(1, text), (2, "the quick")], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.digests(df, queries.vocabulary()).collect()}
    assert got[1].n_tokens == len(library.encode(text, add_special_tokens=False).ids) and got[1].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    scores = {r.doc_id: r for r in lm_score.score(df).collect()}
    assert scores[1].n_words == 800_001 and list(scores[2].by_order) == [0, 1, 1, 0]


def test_bpe_tables(spark, library):
    rows = [(1, "hello world", "x"), (2, None, "x"), (2, None, "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((tuple(r) for r in bpe.digests(df, queries.vocabulary()).collect()), key=repr)
    empty = hashlib.sha256(b"").hexdigest()
    assert got.count((2, 0, empty, empty)) == 2 and len(got) == 4
    ids = np.array(library.encode("hello world").ids, "<u4")
    assert (1, 2, hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(b"hello world").hexdigest()) in got
    full = bpe.encode(df, queries.vocabulary()).where("doc_id = 1").first()
    assert (full.n_tokens, full.decoded, bytes(full.ids)) == (2, "hello world", ids.tobytes())
    assert bpe.digests(df.where("false"), queries.vocabulary()).count() == 0


def scores_by_hand(texts, corpus=None, order=3, alpha=0.4):
    words = [(t or "").encode().lower().split() for t in texts]
    other = words if corpus is None else [(t or "").encode().lower().split() for t in corpus]

    def grams(ws):
        return Counter(tuple(ws[i - n + 1 : i + 1]) for n in range(1, order + 1) for i in range(n - 1, len(ws)))

    total = Counter()
    for ws in other:
        total += grams(ws)
    size = sum(map(len, other))
    out = []
    for ws in words:
        own = grams(ws) if corpus is None else Counter()
        left = max(1, size - (len(ws) if corpus is None else 0))
        count = lambda g, own=own: total[g] - own[g]
        logs, by = [], [0] * (order + 1)
        for i in range(len(ws)):
            longest = min(i + 1, order)
            for n in range(longest, -1, -1):
                g = tuple(ws[i - n + 1 : i + 1]) if n else ()
                if n == 0 or count(g) > 0:
                    share = 1 / left if n == 0 else count(g) / (left if n == 1 else count(g[:-1]))
                    logs.append(math.log(share) + (longest - n) * math.log(alpha))
                    by[n] += 1
                    break
        out.append((len(ws), round(sum(logs) / len(ws), 6) if ws else None, by))
    return out


def lm_texts():
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices(["a", "b", "c", "d", "E", "é"], k=rnd.randint(0, 30))) for _ in range(60)]
    return [*texts, None, "", "once", "A a A", texts[0], "x " * 3000]


@pytest.mark.parametrize("block,words", [(lm_score.BLOCK_CHARS, lm_score.RANGE_WORDS), (200, 97)])
def test_lm_scores(spark, monkeypatch, block, words):
    monkeypatch.setattr(lm_score, "RANGE_WORDS", words)
    monkeypatch.setattr(lm_score, "BLOCK_CHARS", block)
    texts = lm_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string").repartition(3)
    got = {r.doc_id: (r.n_words, r.log_score, list(r.by_order)) for r in lm_score.score(df).collect()}
    want = scores_by_hand(texts)
    for i, (n, mean, by) in enumerate(want):
        assert got[i][0] == n and got[i][2] == by and (mean is None) == (got[i][1] is None)
        assert mean is None or got[i][1] == pytest.approx(mean, abs=2e-6)


def test_lm_scores_by_another_corpus(spark):
    texts, corpus = ["a b c d", "z", ""], ["a b c", "b c d", "a b x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    other = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.log_score, list(r.by_order)) for r in lm_score.score(df, other).collect()}
    for i, (n, mean, by) in enumerate(scores_by_hand(texts, corpus)):
        assert got[i] == (n, mean, by)
    assert lm_score.score(df, other.where("false")).where("doc_id = 0").first().by_order == [4, 0, 0, 0]
    assert lm_score.score(df.where("false")).count() == 0


def test_lm_packing():
    rnd = np.random.default_rng(1)
    for n in (1, 5, 1000):
        keys = np.unique(rnd.integers(100, 1 << 54, n).astype(np.uint64))
        assert (lm_score.unpacked(lm_score.packed(keys, 100), 100) == keys).all()
    counts = np.array([1, 254, 255, 256, 1 << 40, 0])
    assert (lm_score.unpacked_counts(lm_score.packed_counts(counts), 6) == counts).all()


def test_lm_sql(spark, sf):
    oracle.check(spark, oracle.connect(sf), "op8", queries.op8_lm_score, queries.OP8_SQL, sf)


def chain_fixture(n=400):
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words += rnd.choice([["idiot", "moron"], ["worthless"], ["grumblefax", "grumblefix", "grumblefoo"]])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_documents(spark):
    rows = chain_fixture()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (900, None, "x")], "doc_id long, text string, p string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(0, None), (None, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    assert chain.names == ["kind_1", "kind_2", "toxic"]
    assert [len(w) for w in chain.weights] == [len(chain.features) + 1 + k for k in range(3)]  # each sees the ones before
    got = toxicity.scored(docs, chain)
    assert got.columns == ["doc_id", "p_kind_1", "p_kind_2", "p_toxic", "rejected"]
    said = {r.doc_id: r.rejected for r in got.collect()}
    held = [(y, said[i]) for i, _, y in rows if i % 2 == 0]
    assert sum(s for y, s in held if y) >= 0.9 * sum(y for y, _ in held)
    assert sum(s for y, s in held if not y) <= 0.02 * len(held)
    assert got.count() == len(rows) + 3 and not said[900] and not said[901]
    kept = toxicity.clean(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not s for i, s in said.items()) + 1


def test_kinds_are_found_in_the_data():
    rng = np.random.default_rng(5)
    kind = rng.integers(0, 3, 300) // 2  # twice as many of the first
    x = np.hstack([(rng.random((300, 8)) < np.where(kind == k, 0.5, 0.02)[:, None]) for k in range(2)] + [rng.random((300, 10)) < 0.3]).astype(np.float32)
    got = toxicity.kinds_of(x)
    assert (got == 1 - kind).mean() > 0.95 and (got == toxicity.kinds_of(x)).all()
    assert toxicity.kinds_of(x[:1]).tolist() == [0] and toxicity.kinds_of(x[:0]).tolist() == []


def test_toxicity_with_named_categories(spark):
    rows = chain_fixture()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, int("idiot" in t) if i % 3 else None) for i, t, y in rows], "doc_id long, toxic int, insult int")
    got = toxicity.scored(docs, toxicity.train(docs, labels, ["insult"]))
    assert got.columns == ["doc_id", "p_insult", "p_toxic", "rejected"]
    said = {r.doc_id: r for r in got.collect()}
    assert all((said[i].p_insult > 0.5) == ("idiot" in t) and said[i].rejected == bool(y) for i, t, y in rows if i % 3)


def test_the_labelled_sample_has_its_bound(spark, monkeypatch):
    """Repeated rows and ids don't make it larger, nor its chain another."""
    seen = []
    keep = toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    rows = [(i, f"word{i % 7} " + ("idiot scum " * 3 if i % 5 == 0 else "kind fine"), int(i % 5 == 0)) for i in range(200)]
    schema = "doc_id long, text string"
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = [(i, t) for i, t, _ in rows]
    once = toxicity.train(spark.createDataFrame(docs, schema), labels)
    again = toxicity.train(spark.createDataFrame(docs + docs[:1] * 3000 + docs[1:50] * 3, schema).repartition(7), labels)
    few = toxicity.train(spark.createDataFrame([(i, t) for i, t in docs] + docs[:1] * 3000, schema), labels, max_labelled=10)
    assert [s.count() for s in seen] == [200, 200, 10] and once.features == again.features and few.names == once.names
    assert all(np.allclose(a, b) for a, b in zip(once.weights, again.weights, strict=True))
    two = spark.createDataFrame([(1, "b"), (1, "a"), (1, None)], schema)
    toxicity.train(two, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert seen[-1].count() == 1


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    chain = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(docs, chain).where("rejected").count() == 0
    one_class = toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.clean(docs, one_class).count() == 2
    assert toxicity.scored(docs.where("false"), chain).count() == 0


def test_out_of_fold_probabilities_reach_the_next_model():
    rng = np.random.default_rng(0)
    x = (rng.random((300, 6)) < 0.5).astype(np.float32)
    first = (x[:, 0] > 0).astype(int)
    second = (first & (x[:, 1] > 0)).astype(int)
    chain = toxicity.fit_chain(x, list("abcdef"), {"one": first, "two": second})
    p = chain.predict(x)
    assert ((p[:, 0] > 0.5) == first).mean() > 0.99 and ((p[:, 1] > 0.5) == second).mean() > 0.95
    assert chain.weights[1][6] > 0  # the earlier category's probability counts


def test_registered_query_on_the_tables(spark, sf):
    got = queries.op1_toxicity(spark, sf)
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").join(got, "doc_id")
    right = truth.where((F.col("toxic") == 1) == F.col("rejected")).count()
    assert right >= 0.9 * truth.count()
