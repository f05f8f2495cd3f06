"""The pipeline, stage by stage, against the operators by hand."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from huntframe.llm import exact_dedup
from tests.llm.test_native import WS
from tests.llm.test_simhash import by_hand, groups_by_hand

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(21)
    texts = [" ".join(f"w{rnd.randrange(4000)}" for _ in range(rnd.randint(30, 300))) for _ in range(150)]
    rows = [(i, t, "en", rnd.choice(["a", "a", "b", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(200 + i, texts[i].replace(" ", "  "), "en", "b", 0) for i in range(30)]  # exact copies
    rows += [(300 + i, texts[40 + i] + " tail", "en", "a", 0) for i in range(10)]  # near copies
    rows += [(400 + i, texts[60 + i] + " idiot moron scum", "en", "a", 0) for i in range(40)]
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), (None, "no id", "en", "a", 5), (3, texts[3], "en", "a", 1)]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i >= 400)) for i in [*range(0, 150, 2), *range(400, 440, 2)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


@pytest.fixture(scope="module")
def kept(spark, tables):
    folder, _ = tables
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mixing", "bpe"]


def test_toxic_documents_go(kept, tables):
    ids = {r.doc_id for r in kept[0].collect()}
    assert not any(i in ids for i in range(400, 440))
    assert {i for i, *_ in tables[1] if i is None or i < 400} <= ids


def test_columns_stay(kept):
    for docs in kept[:-1]:
        assert docs.columns == DOCS.replace(",", "").split()[::2]


def test_one_of_equal_texts_stays(kept):
    before, after = kept[0].collect(), kept[1].collect()
    norm = lambda r: WS.sub(" ", r.text or "")
    smallest = {}
    for r in before:
        if r.doc_id is not None:
            smallest[norm(r)] = min(r.doc_id, smallest.get(norm(r), r.doc_id))
    assert Counter(r.doc_id for r in after if r.doc_id is not None) == Counter(smallest.values())
    assert sum(r.doc_id is None for r in after) == 1


def test_one_of_near_texts_stays(kept):
    before, after = kept[1].collect(), kept[2].collect()
    roots = groups_by_hand([by_hand(r.text) for r in before])
    smallest = {}
    for r, g in zip(before, roots, strict=True):
        if r.doc_id is not None:
            smallest[g] = min(r.doc_id, smallest.get(g, r.doc_id))
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(smallest.values())
    assert len(after) < len(before)


def test_mix_takes_whole_rows(kept):
    before = {(r.doc_id, r.text): r for r in kept[2].collect()}
    taken = Counter((r.doc_id, r.text) for r in kept[3].collect())
    assert set(taken) <= set(before) and max(taken.values()) <= 3


def test_tokens_of_what_is_left(kept):
    texts = Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept[3].collect())
    assert Counter(r.decoded_sha256 for r in kept[4].collect()) == texts


def test_run_is_the_stages(spark, kept, tables):
    got = corpus_pipeline.run(spark, tables[0])
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, kept[-1].collect()))
    assert got.where(F.col("n_tokens").isNull()).count() == 0


def test_repeated_and_null_ids(spark):
    rnd = random.Random(22)
    a, b, c, d, e = (" ".join(f"v{rnd.randrange(4000)}" for _ in range(60)) for _ in range(5))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, c), (4, b.replace(" ", "  ")), (None, a), (None, e), (None, e), (None, "  ".join(e.split(" "))), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS).repartition(3)
    exact = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert Counter((r.doc_id, WS.sub(" ", r.text or "")) for r in exact) == Counter([(1, a), (2, b), (3, c), (3, d), (None, e), (None, "")])
    near = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert Counter((r.doc_id, WS.sub(" ", r.text or "")) for r in near) == Counter([(1, a), (2, b), (3, c), (3, d), (None, e), (None, "")])


def test_hot_texts_keep_one_row(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 5)
    rows = [(i, "hot  text" if i % 2 else "hot text") for i in range(200, 20, -1)] + [(None, "hot text")] * 30 + [(None, "no ids")] * 40 + [(7, "one id")] * 40
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)], DOCS).repartition(3)
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, WS.sub(" ", r.text)) for r in kept.collect()), key=repr) == [(21, "hot text"), (7, "one id"), (None, "no ids")]
    assert set(kept.collect()) <= set(docs.collect())


def test_three_rows_of_two_ids(spark):
    docs = spark.createDataFrame([(1, "A a", "en", "a", 3), (1, "B b", "en", "a", 3), (0, "B b", "en", "a", 3)], DOCS)
    got = [[(r.doc_id, r.text) for r in stage(spark, docs, "").collect()] for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies)]
    assert sorted(got[0]) == sorted(got[1]) == [(0, "B b"), (1, "A a")]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns[:2] == ["doc_id", "n_tokens"]


def test_near_texts_of_one_id(spark):
    rnd = random.Random(23)
    base = [f"v{rnd.randrange(4000)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base) + " tail", " ".join(base) + " end"]
    groups = groups_by_hand([by_hand(t) for t in texts])
    for ids in ((7, 7, 7), (None, None, None), (7, 7, 9), (None, 7, 7)):
        docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
        got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
        assert len(got) == len(set(groups))
        assert {r.text for r in got} <= set(texts)
