"""Window operators against plain state machines, on random rows with ties and hot keys."""

from __future__ import annotations

import random
import time
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from huntframe.operators import grading
from huntframe.operators import windows as W
from huntframe.rules.traffic import beacons

W_US = 300


def made(seed, n=400, keys="abc", span=4000):
    rnd = random.Random(seed)
    rows, us = [], 0
    for i in range(n):
        us += rnd.choice([0, 0, 1, 3, 20, W_US, W_US + 1]) if span else 0
        # One key has most of the rows.
        rows.append((rnd.choice("a" * 8 + keys), us, i, rnd.choice(["x", "y", "z", None])))
    return rows


@pytest.fixture(params=[1, 2, 3])
def rows(request):
    return made(request.param)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, us long, i long, v string").repartition(3)


def test_trailing_is_the_length_of_a_trimmed_queue(spark, rows):
    want, queues = {}, defaultdict(deque)
    for k, us, i, _ in rows:
        queue = queues[k]
        queue.append(us)
        while us - queue[0] > W_US:
            queue.popleft()
        want[i] = len(queue)
    got = W.trailing(frame(spark, rows), ["k"], "us", ["i"], W_US, {"n": F.lit(1).cast("bigint")})
    assert {r.i: r.n for r in got.collect()} == want


def test_burst_is_reported_once_a_key(spark, rows):
    got = W.burst(frame(spark, rows), ["k"], "us", ["i"], W_US, 5)
    want, queues = {}, defaultdict(deque)
    for k, us, i, _ in rows:
        queue = queues[k]
        queue.append(us)
        while us - queue[0] > W_US:
            queue.popleft()
        if len(queue) >= 5 and k not in want:
            want[k] = (i, len(queue))
    assert {r.k: (r.i, r.n) for r in got.collect()} == want


@pytest.mark.parametrize("at_least,found", [(5, True), (6, False)])
def test_burst_borders(spark, at_least, found):
    exact = [("a", i * W_US // 4, i, None) for i in range(5)]  # the first and the last are exactly the window apart
    assert bool(W.burst(frame(spark, exact), ["k"], "us", ["i"], W_US, at_least).collect()) == found
    late = exact[:4] + [("a", W_US + 1, 4, None)]
    assert not W.burst(frame(spark, late), ["k"], "us", ["i"], W_US, 5).collect()


def test_running_and_numbered(spark, rows):
    sums, counts, want = defaultdict(int), defaultdict(int), {}
    for k, us, i, _ in rows:
        sums[k] += i
        counts[k] += 1
        want[i] = (sums[k], counts[k])
    df = frame(spark, rows)
    a = W.running(df, ["k"], "us", ["i"], {"s": F.col("i")}, slab_us=500)
    b = W.numbered(df, ["k"], "us", ["i"], slab_us=500)
    assert {r.i: r.s for r in a.collect()} == {i: s for i, (s, _) in want.items()}
    assert {r.i: r.nth for r in b.collect()} == {i: n for i, (_, n) in want.items()}
    whole = W.numbered(df, [], "us", ["i"], slab_us=500)
    assert {r.i: r.nth for r in whole.collect()} == {i: n for n, (_, _, i, _) in enumerate(rows, 1)}


@pytest.mark.parametrize("chunk", [5, 7, 1000])
def test_looking_back_needs_only_the_rows_before(spark, rows, chunk):
    last, want = defaultdict(list), {}
    for k, us, i, _ in rows:
        want[i] = tuple(last[k][-3:])
        last[k].append(i)
    got = W.looking_back(frame(spark, rows), ["k"], "us", ["i"], 3, lambda w: {"back": F.collect_list("i").over(w.rowsBetween(-3, -1))}, chunk=chunk, slab_us=400)
    assert {r.i: tuple(r.back) for r in got.collect()} == want


def test_running_distinct(spark, rows):
    seen, want = defaultdict(list), {}
    for k, _, i, v in rows:
        if v is not None and v not in seen[k]:
            seen[k].append(v)
            if len(seen[k]) == 3:
                want[k] = i
    got = W.distinct_over(frame(spark, rows), ["k"], "v", "us", ["i"], 2)
    assert {r.k: r.i for r in got.collect()} == want


def test_distinct_in_window(spark, rows):
    want = {}
    for n, (k, us, i, _) in enumerate(rows):
        want[i] = len({v for kk, u, _, v in rows[: n + 1] if kk == k and us - u <= W_US and v is not None})
    got = grading.distinct_trailing(frame(spark, rows), ["k"], "v", "us", ["i"], W_US)
    assert {r.i: r.kinds for r in got.collect()} == want


def test_after_first_is_strictly_later(spark):
    df = frame(spark, [("a", 10, 1, None), ("a", 10, 2, None), ("a", 310, 3, None), ("a", 311, 4, None)])
    marks = spark.createDataFrame([("a", 10, 1)], "k string, at long, i long")
    got = W.after_first(df, marks, ["k"], "us", ["i"], "at", 300)
    assert sorted(r.i for r in got.collect()) == [2, 3]


def test_beacons(spark):
    steady = [("s", n * 10_000_000, n) for n in range(30)]
    uneven = [("u", n * n * 1_000_000, n) for n in range(30)]
    df = spark.createDataFrame(steady + uneven, "src string, us long, line_no long").withColumn("src_file", F.lit("f"))
    got = beacons(df, ["src"]).collect()
    assert [(r.src, r.line_no) for r in got] == [("s", 15)]
    assert got[0].mean_s == 10 and got[0].cv == 0


def test_results_don_t_depend_on_partitioning(spark, rows):
    a = W.trailing(frame(spark, rows).coalesce(1), ["k"], "us", ["i"], W_US, {"n": F.lit(1).cast("bigint")})
    b = W.trailing(frame(spark, rows).repartition(7), ["k"], "us", ["i"], W_US, {"n": F.lit(1).cast("bigint")})
    assert sorted(a.select("i", "n").collect()) == sorted(b.select("i", "n").collect())


def test_empty(spark):
    df = frame(spark, made(1, 1)).where("false")
    assert not W.burst(df, ["k"], "us", ["i"], W_US, 1).collect()
    assert not W.looking_back(df, ["k"], "us", ["i"], 1, lambda w: {"x": F.lag("i").over(w)}).collect()


def splitting(spark):
    """A session that splits what is only somewhat skewed and broadcasts nothing."""
    own = spark.newSession()
    for k, v in {
        "autoBroadcastJoinThreshold": "-1",
        "adaptive.autoBroadcastJoinThreshold": "-1",
        "adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "adaptive.advisoryPartitionSizeInBytes": "4k",
        "adaptive.coalescePartitions.enabled": "false",
        "shuffle.partitions": "8",
        "session.timeZone": "UTC",
    }.items():
        own.conf.set(f"spark.sql.{k}", v)
    return own


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_busy_key_is_split(spark):
    own = splitting(spark)
    rows = own.range(30_000).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 'busy' ELSE concat('k', id) END AS src_ip", "id * 1000 AS us", "'f' AS src_file", "id AS line_no", "'u' AS user", "'t' AS ts",
        "CASE WHEN id % 30 < 20 AND id % 3 < 2 AND id < 3000 THEN 'ssh-fail' ELSE 'ssh-success' END AS msg",
    )
    from huntframe.rules import auth

    found = auth.success_after_failures(rows.repartition(6), few=1 << 40)
    assert {r.src_ip for r in found.collect()} == {"busy"}
    assert "skew=true" in final_plan(found)


def test_ranks_of_a_whole_table(spark):
    from huntframe.operators.windows import ranked

    rows = [(k % 7 if k % 5 else None, f"n{k:04d}") for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    got = {(r.a, r.b): r.nth for r in ranked(df, ["a", "b"]).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {r: i + 1 for i, r in enumerate(order)}
    assert ranked(df.where("false"), ["a", "b"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_long_windows_are_the_same(spark, monkeypatch, seed):
    df = spark.createDataFrame(made(seed), "k string, us long, i long, v string").repartition(3)
    sums = {"n": F.lit(1).cast("bigint"), "x": (F.col("v") == "x").cast("bigint")}
    want = sorted(map(tuple, W.trailing(df, ["k"], "us", ["i"], W_US, sums).collect()), key=repr)
    monkeypatch.setattr(W, "LONG", 1)
    got = W.trailing(df, ["k"], "us", ["i"], W_US, sums)
    assert got.columns == ["k", "us", "i", "v", "n", "x"]
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_words_that_a_pattern_needs():
    from huntframe.functions.text import required_words

    assert required_words(r"(?i)Foo\s+(bar|Bazz)?x*quux") == ("quux",)
    assert required_words(r"\b(cmd|powershell)\.exe") == (".exe",)
    assert required_words(r"abc|de") == ("abc", "de") and required_words(r"abc|.") == () and required_words(r"a?b*") == ()
    assert required_words(r"(?:abcd){2,}\d") == ("abcd",) and required_words(r"\p{L}abc") == ()


def test_rewriting_texts_that_have_the_mark(spark):
    from huntframe.functions.text import rewritten

    texts = ["a1b22c", "\x01a1\x01b22", "none", "", None, "1", "12 3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(rewritten(F.col("t"), "[0-9]+", lambda m: F.when(m != "3", F.concat(F.lit("<"), m, F.lit(">"))))).collect()]
    assert got == ["a<1>b<22>c", "\x01a<1>\x01b<22>", "none", "", None, "<1>", "<12> "]


def as_of_by_hand(left, right, within, forward):
    out = []
    for k, us, i in left:
        ahead = [(abs(t - us), v, t) for kk, t, v in right if kk == k and k is not None and None not in (us, t) and 0 < (t - us if forward else us - t) <= within]
        near = min(ahead, default=(0, None, None))
        out.append((k, us, i, near[1], near[2]))
    return out


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("within", [1, 7, 40, 10_000])
def test_as_of_against_all_pairs(spark, forward, within):
    rnd = random.Random(within)
    rows = lambda n: [(rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice([None, *range(-60, 60)]), rnd.randrange(1000)) for _ in range(n)]
    left, right = rows(150), rows(40)
    df = spark.createDataFrame([(*r, "x") for r in left], "k string, us long, i long, value string").repartition(3)
    marks = spark.createDataFrame([(*r, 1) for r in right], "k string, us long, v long, i int").repartition(3)
    want = as_of_by_hand(left, right, within, forward)
    for slab in (3, W.HOUR):
        got = W.as_of(df, marks, ["k"], within, "v", "near", forward, True, slab_us=slab)
        assert got.columns == ["k", "us", "i", "value", "near", "near_us"]
        assert sorted(map(tuple, got.drop("value").collect()), key=repr) == sorted(want, key=repr)
        inner = W.as_of(df, marks, ["k"], within, "v", "near", forward, slab_us=slab)
        assert sorted(map(tuple, inner.drop("value").collect()), key=repr) == sorted((w for w in want if w[3] is not None), key=repr)
    assert W.as_of(df.limit(0), marks, ["k"], within, "v", "near").count() == 0


def test_as_of_takes_time_in_proportion(spark):
    """A million rows a side of one key in half an hour: all pairs would be 10^12."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("a").alias("k"), (F.col("id") * 1800).alias("us"), F.col("id").alias("line_no"))
    began = time.monotonic()
    got = W.as_of(rows, rows.select("k", (F.col("us") + 5).alias("us"), "line_no"), ["k"], W.HOUR, "line_no", "next")
    assert tuple(got.agg(F.count("*"), F.sum((F.col("next") == F.col("line_no")).cast("int"))).first()) == (n, n)
    assert time.monotonic() - began < 90
