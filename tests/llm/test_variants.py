"""Spelling variants against all pairs of words, and against SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from huntframe.llm import queries, variants
from tests import oracle


def one_apart(a, b):
    """Whether one code point inserted, deleted or replaced turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def words_by_hand(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def by_hand(n):
    form, out = {}, []
    for w in n:
        found = sorted((-n[x], x) for x in n if one_apart(w, x))
        form[w] = (found[0][1] if found and -found[0][0] >= 5 * n[w] else None, len(found))
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, form[w][0], root, n[w], form[w][1], n.get(form[w][0])))
    return sorted(out)


def random_docs(seed, n=300):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choices("abcé", k=rnd.randint(6, 9))) for _ in range(12)]

    def word():
        w = list(rnd.choice(stems))
        for _ in range(rnd.choice([0, 0, 0, 0, 1, 1, 2])):
            i = rnd.randrange(len(w))
            w[i : i + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "é", "ÿ", "A"])
        return "".join(w)

    return [(None if i % 30 == 3 else i // 2, " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_words_and_forms_by_hand(spark, seed):
    docs = [*random_docs(seed), (5, None), (6, ""), (7, "Übergröße×÷ Übergröße×÷ über_größer Ⅷnaïveté " * 7), (8, "ĀabcdefĀ " * 5)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n int").repartition(5)
    want = by_hand(words_by_hand(docs))
    assert sorted(map(tuple, variants.variants(df).collect())) == want
    assert sum(r[1] is not None for r in want) > 3 and sum(r[4] > 3 for r in want) > 3


def test_a_chain_leads_to_its_end(spark):
    chain = ["abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    docs = [(None, " ".join(w for i, w in enumerate(chain) for _ in range(5 ** (i + 1))))]
    got = {r.word: r for r in variants.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[w].form for w in chain] == [*chain[1:], None] and {r.root for r in got.values()} == {chain[-1]}


def test_anagrams_of_one_key_and_long_words(spark):
    rnd = random.Random(4)
    words = {"".join(rnd.sample("abcdefgh", 8)) for _ in range(400)} | {"x" * 3000, "x" * 2999 + "y", "x" * 2999, "x" * 3001}
    docs = [(None, " ".join(w for w in words for _ in range(6)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, variants.variants(df).collect())) == by_hand(words_by_hand(docs))


def test_typos_delete_the_letter_that_the_hash_names():
    doc = next(d for d in range(10_000) if zlib.crc32(f"{d}:grüßend".encode()) % 199 == 0)
    at = zlib.crc32(f"{doc}:grüßend".encode()) % 7
    assert variants.words_of(doc, "GRüßend grüßend") == {("grüßend"[:at] + "grüßend"[at + 1 :]).encode("latin-1"): 2}


def test_rows_of_a_word_without_each_letter():
    rows = variants.places([b"hello", b"helo"])
    keys = list(zip(rows["key"].tolist(), rows["h1"].tolist(), rows["h2"].tolist(), strict=True))
    assert keys[2] == keys[3] == keys[-1] and len(set(keys[:5])) == 4 and rows["first"].tolist()[:5] == [True, True, True, False, True]


def test_pruning_leaves_few_rows_and_groups_are_small(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert variants.variants(docs.limit(0)).count() == 0
    words = variants.ranked(variants.vocabulary(docs).withColumn("minus_n", -F.col("n")), ["minus_n", "word"], "rank")
    most = variants.placed(words).where("place >= 0").groupBy("key", "h1", "h2", "place").count().agg(F.max("count")).first()[0]
    assert most <= len(variants.LETTERS)


def test_query_gives_the_rows_of_its_sql(spark, sf):
    assert oracle.check(spark, oracle.connect(sf), "op12_spelling_variants", queries.op12_spelling_variants, queries.OP12_SQL, sf) > 100


def test_no_table_of_words_goes_through_the_driver(spark, monkeypatch):
    """However small their files look: all of them grow with the vocabulary."""
    plans = {}
    written = variants.store.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(variants.store, "written", noted)
    docs = spark.createDataFrame(random_docs(7), "doc_id long, text string")
    plans["out"] = variants.variants(docs)._jdf.queryExecution().executedPlan().toString()
    assert {"words", "near", "roots", "out"} <= set(plans)
    # the numbers of the sorted ranges are all that is broadcast
    assert [n for n, p in plans.items() if "BroadcastHashJoin" in p] in ([], ["words"])
    assert all("SortMergeJoin" in plans[n] for n in ("near", "roots", "out"))
