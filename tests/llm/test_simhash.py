"""SimHash groups against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from huntframe.llm import components, queries, simhash


def by_hand(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def groups_by_hand(prints):
    """{position: smallest id of its component}."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[find(a)] = find(b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", ["", None, "one", "One two", "a b c", "a b c a b c", "x\ty\nz  Ü é", "word " * 100_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == by_hand(text)


def test_golay_keys_lose_no_link():
    rnd = random.Random(2)
    a = [rnd.getrandbits(64) for _ in range(3000)]
    b = [x ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(0, 2))}) for x in a]
    keys = []
    for x in (a, b):
        at, k = simhash.keys_of(np.array(x, np.uint64).view(np.int64))
        sets = [set() for _ in x]
        for i, key in zip(at.tolist(), k.tolist(), strict=True):
            sets[i].add(key)
        keys.append(sets)
    assert all(p & q for p, q in zip(*keys, strict=True))


def frame(spark, prints):
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    return spark.createDataFrame([(x,) for x in set(signed)], "fp long")


@pytest.mark.parametrize("kind", ["pairs", "crowd", "chain"])
def test_links_give_the_components_of_all_pairs(spark, kind):
    rnd = random.Random(7)
    if kind == "pairs":
        base = [rnd.getrandbits(64) for _ in range(150)]
        prints = base + [x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for x in base[:80]] + [x ^ 0b10101 for x in base[80:120]]
    elif kind == "crowd":  # many fingerprints with one key: more than are compared pair by pair
        base = rnd.getrandbits(46) << 18
        prints = [base ^ sum(1 << b for b in rnd.sample(range(18), rnd.randint(0, 6))) for _ in range(300)]
    else:  # each is two bits from the next only
        prints = [sum(3 << (2 * i) for i in range(n)) for n in range(30)] + [0xFFFF << 46]
    prints = sorted(set(prints))
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    labels = {r.u: r.label for r in components.components(simhash.links(frame(spark, prints))).collect()}
    roots = groups_by_hand(prints)
    mine = [labels.get(signed[p], signed[p]) for p in prints]
    assert len(set(zip(mine, roots, strict=True))) == len(set(mine)) == len(set(roots))


def test_near_groups(spark):
    rnd = random.Random(9)
    long = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(800)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(long)]
    rows += [(100 + i, t + " tail") for i, t in enumerate(long)]  # near copies
    rows += [(200 + i, long[0]) for i in range(60)] + [(300, None), (301, ""), (302, " \n"), (None, long[1]), (5, long[5]), (400, "a"), (401, "a")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string").repartition(3)
    got = simhash.near_groups(df)
    assert got.columns == ["doc_id", "fp", "component_id"]
    prints = [by_hand(t) for _, t in rows]
    roots = groups_by_hand(prints)
    smallest = {r: min((i for (i, _), q in zip(rows, roots, strict=True) if q == r and i is not None), default=None) for r in set(roots)}
    want = sorted(((i, p - (1 << 64) if p >> 63 else p, smallest[r]) for (i, _), p, r in zip(rows, prints, roots, strict=True)), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    near = {i: c for i, _, c in want}
    assert sum(near[100 + i] == i for i in range(20)) >= 18  # of 20 near copies of 800 words


def test_query_and_empty(spark, sf):
    got = queries.op10_simhash(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.where(~F.col("fingerprint").rlike("^[0-9a-f]{16}$") | (F.col("component_id") > F.col("doc_id"))).count() == 0
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
