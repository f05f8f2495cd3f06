"""Exact dedup, mixing and licence scans against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from huntframe.llm import exact_dedup, licenses, mixing, queries
from tests import oracle

WS = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, norm string, sha string, row int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash", 7) for i, t, s in rows], DOCS).repartition(3)


def groups_by_hand(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[WS.sub(" ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        digest = sha256(text.encode()).hexdigest()
        kept = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), i == keep and not kept, digest))
            kept = kept or i == keep
    return Counter(out)


def tuples(df):
    return Counter(tuple(r) for r in df.collect())


def dedup_cases():
    rnd = random.Random(1)
    mixed = [(i, rnd.choice(["a b", "a  b", "a\n\tb", "a b ", None, "", " ", "x" * 200_000, "ü", "U", "a b"]), "s") for i in range(300)]
    hot = [(i, "same text" if i % 3 else f"t{i % 50}", "s") for i in range(2000)]
    return {
        "mixed": mixed,
        "hot": hot,
        "repeated rows": [(5, "a", "s"), (5, "a", "s"), (5, "b", "s"), (3, "a", "s")],
        "null ids": [(None, "a", "s"), (2, "a", "s"), (None, "b", "s"), (None, "b", "s")],
        "empty": [],
    }


@pytest.mark.parametrize("name", dedup_cases())
def test_exact_groups(spark, name):
    rows = dedup_cases()[name]
    got = exact_dedup.exact_groups(docs(spark, rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert tuples(got) == groups_by_hand(rows)


def test_exact_groups_need_no_python(spark):
    plan = exact_dedup.exact_groups(docs(spark, dedup_cases()["mixed"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op6_source_mixing"])
def test_sql(spark, sf, name):
    oracle.check(spark, oracle.connect(sf), name, queries.queries()[name], queries.oracle_sql()[name], sf)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_many_rows_of_one_id_and_text_are_split(spark, monkeypatch, doc_id):
    """Every part of the hot text has a share of the rows, and one row stays."""
    n = 20_000
    hot = spark.range(n).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("same  text").alias("text"), F.lit("s").alias("source"))
    few = spark.createDataFrame([(3, "a", "s"), (None, "a", "s"), (9, "same text", "t")], "doc_id long, text string, source string")
    df = hot.unionByName(few).repartition(6)
    seen = {}
    keep = exact_dedup.written
    monkeypatch.setattr(exact_dedup, "written", lambda x, name: seen.setdefault(name, keep(x, name)))
    got = exact_dedup.exact_groups(df)
    want = groups_by_hand([(doc_id, "same text", "")] * n + [(3, "a", ""), (None, "a", ""), (9, "same text", "")])
    assert tuples(got) == want
    parts = [r["count"] for r in seen["dedup-members"].where("hot").groupBy("salt").count().collect()]
    assert len(parts) > 3 and max(parts) < 2 * n / len(parts)
    assert sorted(map(tuple, exact_dedup.distinct(df).select("doc_id", F.trim("source").alias("s")).collect()), key=repr) == sorted([(3, "s"), (doc_id or 9, "s" if doc_id else "t")], key=repr)


def test_crowded_cells_are_cut_finer(spark, monkeypatch):
    """10^5 rows of one id and text: the same multiset as systematic sampling in order, in many chunks."""
    n = 100_000
    df = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    df = df.unionByName(spark.createDataFrame([(i, "x " * (i % 40), "t" if i % 3 else "s") for i in range(3000)], "doc_id long, text string, source string")).repartition(7)
    seen = {}
    keep = mixing.written
    monkeypatch.setattr(mixing, "written", lambda x, name: seen.update({name: keep(x, name)}) or seen[name])
    got = mixing.mix_sizes(df).collect()
    parts = [r["count"] for r in seen["mix-crowded"].groupBy("cell", "size", "doc_id", "chunk").count().collect()]
    assert max(parts) <= 1 << mixing.CHUNK_BITS and sum(parts) >= n
    assert len(got) == n + 3000
    monkeypatch.setattr(mixing, "CROWDED", 10**9)
    seen.clear()
    plain = mixing.mix_sizes(df).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, plain))


def targets_by_hand(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            free.discard(s)
    return target


@pytest.fixture(scope="module")
def mix_rows():
    rnd = random.Random(3)
    rows = [(i, " ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(0, 60))), rnd.choice(["big"] * 6 + ["b", "c", None])) for i in range(3000)]
    return rows + [(5000, None, "b"), (5001, "", "nothing"), (5002, "x", "tiny"), (7, "a b", "b"), (7, "a b", "b")]


def test_mix(spark, mix_rows):
    got = mixing.mix_sizes(docs(spark, mix_rows)).collect()
    assert len(got) == len(mix_rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    by_id = {i: s for i, _, s in mix_rows}
    for r in got:
        s = by_id[r.doc_id]
        sizes[s] += r["size"]
        taken[s] += r.copies * r["size"]
        largest[s] = max(largest[s], r["size"])
        assert 0 <= r.copies <= 3
    want = targets_by_hand(dict(sizes))
    for r in got:
        assert r.source_size == sizes[by_id[r.doc_id]] and r.target == pytest.approx(want[by_id[r.doc_id]])
    for s in sizes:
        # One document more or less in each size-ordered cell.
        assert abs(taken[s] - want[s]) <= max(4 * largest[s], 0.03 * want[s]), s


def test_targets_of_many_sources(spark):
    rnd = random.Random(9)
    sizes = {f"s{k:05d}": rnd.choice([0, 1, 5, 40, 900, 100_000]) for k in range(3000)} | {None: 77}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long").repartition(4)
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = targets_by_hand(sizes)
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s]) for s in want)
    assert mixing.source_targets(df.where("false")).count() == 0


def test_mix_is_repeatable_and_keeps_columns(spark, mix_rows):
    a = mixing.mixed(docs(spark, mix_rows)).withColumn("n", F.col("mix_copies"))
    b = mixing.mixed(docs(spark, mix_rows).repartition(9)).withColumn("n", F.col("mix_copies"))
    assert a.columns[:6] == DOCS.replace(",", "").split()[::2]
    assert tuples(a.select("doc_id", "n")) == tuples(b.select("doc_id", "n"))
    assert mixing.mixed(docs(spark, [])).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_by_hand(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for label, phrase in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def license_texts():
    rnd = random.Random(4)
    vocabulary = ["mit", "MIT", "license", "License,", "apache", "general", "public", "gnu", "x1", "é", "K", "İ", "the", "\n", "_", "--", "2.0"]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 40))) for _ in range(300)]
    return [*texts, None, "", "MIT-License", "mit license" * 3, "word " * 50_000 + "mit license", "MITlicense mit license"]


def test_license_base(spark):
    texts = license_texts()
    got = {r.doc_id: r for r in licenses.scan(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_templates(spark):
    rows = []
    for k, (_, text, phrases) in enumerate(licenses.TEMPLATES):
        moved = f"Some words first. {text.upper()} and more"
        rows += [(2 * k, moved, "s"), (2 * k + 1, " ".join(w for w in moved.split() if w.lower() not in phrases[0].split()), "s")]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(docs(spark, [*rows, (999, "plain", "s")])).collect()}
    for k, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[2 * k] and label not in got[2 * k + 1]
    assert got[999] == [""]


def labels_by_hand(texts):
    """Labels and score of each text: every template tried at every place."""
    words = [WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    templates = [(label, t.split(), None) for label, t in licenses.BASE] + [(label, t.split(), phrases) for label, t, phrases in licenses.TEMPLATES]
    out = []
    for mine in words:
        labels, best = set(), 0.0
        for label, want, phrases in templates:
            if phrases is None:
                rare, need = sorted(set(want)), len(set(want))
                keys = [(0, want)]
            else:
                rare = sorted(set(want), key=lambda w: (sum(w in d for d in words), w))[: licenses.POSTINGS]
                need = licenses.AGREE * len(rare)
                keys = [(next(i for i in range(len(want)) if want[i : i + len(k.split())] == k.split()), k.split()) for k in phrases]
            for s in range(len(mine)):
                agree = sum(s + want.index(w) < len(mine) and mine[s + want.index(w)] == w for w in rare)
                if agree and agree >= need - 1e-9 and all(mine[s + o : s + o + len(k)] == k for o, k in keys):
                    labels.add(label)
                    best = max(best, agree / len(rare))
        out.append((",".join(sorted(labels)), best))
    return out


def test_license_labels_and_score(spark):
    rnd = random.Random(6)
    texts = license_texts()[:60] + [None, ""]
    for _ in range(150):  # templates with words lost, added and exchanged, between other words
        _, text, _ = rnd.choice(licenses.TEMPLATES)
        words = [rnd.choice(["the", "x", w, w + " a"]) if rnd.random() < 0.08 else w for w in text.split()]
        texts.append(" ".join(["z"] * rnd.randint(0, 4) + words + ["license"] * rnd.randint(0, 3)))
    got = {r.doc_id: r for r in licenses.scan(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    want = labels_by_hand(texts)
    assert [(got[i].labels, round(got[i].score, 9)) for i in range(len(texts))] == [(a, round(b, 9)) for a, b in want]
    assert len({a for a, _ in want}) > 12 and any(0 < b < 1 for _, b in want)


def test_license_words_that_repeat(spark):
    n = 80_000
    got = licenses.scan(docs(spark, [(1, "mit license " * n, "s")])).collect()[0]
    assert (got.n_words, got.n_base, got.first_word, got.last_word, got.labels) == (2 * n, n, 0, 2 * n - 2, "mit")


def test_license_empty(spark):
    assert licenses.scan(docs(spark, [])).count() == 0
