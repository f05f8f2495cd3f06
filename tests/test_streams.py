"""Streams over several triggers against the batch operators."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from huntframe.operators import windows as W
from huntframe.streaming import detect, state

START = datetime(2026, 7, 1)
SCHEMA = "i long, k string, ts timestamp"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Rows in order of time, and a folder with a file for each part of them; one trigger a file."""
    rnd = random.Random(4)
    folder = str(tmp_path_factory.mktemp("stream"))
    rows, t = [], START
    for i in range(240):
        t += timedelta(seconds=rnd.choice([1, 5, 30, 200]))
        rows.append((i, rnd.choice("aaab"), t))
    rows.append((999, "end", t + timedelta(days=3)))
    for n in range(0, len(rows), 61):
        spark.createDataFrame(rows[n : n + 61], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)
    return folder, spark.createDataFrame(rows, SCHEMA)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(spark, made, folder, name):
    detect.run_to_end(made, f"{folder}/{name}-state", f"{folder}/{name}")
    return spark.read.schema(made.schema).parquet(f"{folder}/{name}")


def test_buckets(spark, parts):
    folder, rows = parts
    got = run(spark, detect.bucket_counts(stream(spark, folder), "10 minutes", "1 minute", ("k",)), folder, "buckets")
    want = rows.where("k <> 'end'").groupBy(F.window("ts", "10 minutes").start.alias("bucket"), "k").count()
    assert sorted(map(tuple, got.where("k <> 'end'").collect())) == sorted(map(tuple, want.collect()))


def test_bursts(spark, parts):
    folder, rows = parts
    window = 120_000_000
    got = run(spark, detect.bursts(stream(spark, folder), "k", window, 5, "1 minute"), folder, "bursts")
    timed = rows.withColumn("us", F.unix_micros("ts"))
    want = W.burst(timed, ["k"], "us", ["i"], window, 5).select("k", "ts", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() >= 1


def test_first_sights_and_indicators(spark, parts):
    folder, rows = parts
    firsts = run(spark, detect.first_sights(stream(spark, folder), ("k",), "10 days"), folder, "firsts")
    assert sorted((r.k, r.i) for r in firsts.collect()) == sorted((r.k, r.i) for r in rows.groupBy("k").agg(F.min("i").alias("i")).collect())
    known = spark.createDataFrame([("b",)], "value string")
    found = run(spark, detect.with_indicators(stream(spark, folder), known, "k"), folder, "known")
    assert found.count() == rows.where("k = 'b'").count()


def test_sessions(spark, parts):
    folder, rows = parts
    got = run(spark, detect.sessions(stream(spark, folder), "2 minutes", "1 minute", ("k",)), folder, "sessions")
    assert got.where("k <> 'end'").agg(F.sum("n")).first()[0] == rows.count() - 1


def by_hand(rows, rules):
    """The rules of one key on its records in order, from the whole history each time."""
    out, times, fails, seen = [], [], [], set()
    beaconed = valued = dead = False
    armed = None
    for us, nth, kind, value in sorted(rows):
        times.append(us)
        gaps = [(b - a) / 1e6 for a, b in zip(times, times[1:])][-rules.last :]
        mean = sum(gaps) / len(gaps) if gaps else 0
        if not beaconed and len(gaps) >= rules.at_least and mean > rules.mean_over and (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean < rules.cv_under:
            beaconed = True
            out.append(("beacon", us, nth))
        seen.add(value)
        if not valued and len(seen) > rules.more_values_than:
            valued = True
            out.append(("values", us, nth))
        if kind == "fail":
            fails.append(us)
            if armed is None and sum(us - t <= rules.fails_us for t in fails) >= rules.fails and not dead:
                armed = us
                out.append(("armed", us, nth))
        elif kind == "success" and armed is not None and not dead:
            if us - armed <= rules.grace_us:
                out.append(("won", us, nth))
                armed = None
            else:
                dead = True
    return out


def test_key_rules_over_triggers_and_a_restart(spark, tmp_path):
    """Rows out of order within the lateness, several keys, the query stopped and started again half-way."""
    rnd = random.Random(8)
    rules = state.Rules(last=8, at_least=5, cv_under=0.3, mean_over=5.0, more_values_than=6, fails=4, fails_us=40_000_000, grace_us=60_000_000)
    rows, t = [], START
    for i in range(400):
        t += timedelta(seconds=rnd.choice([1, 10, 10, 10, 11]))
        rows.append((i, rnd.choice("aabc"), t, rnd.choice(["fail", "fail", "fail", "success", None]), str(rnd.randrange(12))))
    rows += [(2000 + i, "d", START + timedelta(seconds=60 * i + rnd.randrange(3)), None, "x") for i in range(30)]
    rows += [(900, None, t, "fail", "x"), (999, "end", t + timedelta(days=1), None, None)]
    schema = "nth long, k string, ts timestamp, kind string, value string"
    dealt = sorted(rows[:-1], key=lambda r: (r[2].timestamp() + rnd.uniform(0, 50)))
    dealt = [dealt[:130], dealt[130:260], dealt[260:], rows[-1:]]
    own = state.with_timers(spark.newSession())
    own.conf.set("spark.sql.shuffle.partitions", "2")

    def run():
        made = state.key_rules(own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), F.col("k"), F.col("kind"), F.col("value"), F.col("nth"), "1 minute", rules)
        detect.run_to_end(made, f"{tmp_path}/state", f"{tmp_path}/out")
        return made.schema

    for n, part in enumerate(dealt):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
        if n == 1:
            run()
    got = spark.read.schema(run()).parquet(f"{tmp_path}/out").collect()
    want = [(k, *x) for k in "abcd" for x in by_hand([(int(r[2].timestamp() * 1e6), r[0], r[3], r[4]) for r in rows if r[1] == k], rules)]
    assert sorted((r.key, r.rule, r.us, r.nth) for r in got) == sorted(want)
    assert {r.rule for r in got} == {"beacon", "values", "armed", "won"}


def test_follow_ups_of_two_streams(spark, parts, tmp_path):
    """Pairs as in a batch, rows that nothing follows once their time has passed."""
    folder, rows = parts
    made = state.within(stream(spark, folder).where("i % 3 = 0"), stream(spark, folder).where("i % 3 > 0 OR k = 'end'"), "k", "2 MINUTES", "1 minute")
    got = run(spark, made, str(tmp_path), "follow")
    a, b = rows.where("i % 3 = 0").alias("a"), rows.where("i % 3 > 0").alias("b")
    want = a.join(b, F.expr("a.k = b.k AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 MINUTES"), "left").where("a.k <> 'end'").selectExpr("a.i", "b.i AS other")
    assert sorted(map(repr, got.where("k <> 'end'").selectExpr("i", "other_i AS other").collect())) == sorted(map(repr, want.collect()))
    assert got.where("other_i IS NULL").count() > 0


def test_calls_to_the_store_do_not_grow_with_a_keys_records():
    """Each call is a round trip and each entry is encoded on its own: as many for 500 records of a key as for one."""
    from unittest.mock import MagicMock

    from pyspark.sql import Row

    def calls(n):
        made = state.KeyRules(state.Rules(more_values_than=1000))
        made.init(MagicMock())
        entries = []
        made.buffer.appendValue.side_effect = entries.append
        made.buffer.get.side_effect = lambda: iter(entries)
        made.kept.get.return_value = None
        timers = MagicMock()
        timers.getCurrentWatermarkInMs.return_value = 10**9
        list(made.handleInputRows(("a",), iter([Row(key="a", us=i * 10**6, nth=i, kind=None, value=str(i)) for i in range(n)]), timers))
        list(made.handleExpiredTimer(("a",), timers, MagicMock()))
        assert made.kept.update.call_args[0][0][-3] == n and len(entries) == 1  # that many different values
        return sum(len(store.method_calls) for store in (made.handle, made.buffer, made.kept))

    assert calls(500) == calls(1)


def test_streams_use_all_cores(spark):
    from huntframe.plans import streams

    own, _ = streams._own(spark)
    assert int(own.conf.get("spark.sql.shuffle.partitions")) >= spark.sparkContext.defaultParallelism
    assert streams._own(MagicSession(spark, 12))[0].conf.get("spark.sql.shuffle.partitions") == "12"


class MagicSession:
    """A session on a cluster of so many cores."""

    def __init__(self, spark, cores):
        self.spark, self.sparkContext = spark, type("Context", (), {"defaultParallelism": cores})

    def __getattr__(self, name):
        return getattr(self.spark, name)
