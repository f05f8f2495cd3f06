"""Ranges of addresses against each address tried on its own."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from huntframe.operators import ranges as R

name = lambda n: ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def test_blocks_make_up_their_range(spark):
    rnd = random.Random(1)
    rows = [(a, a + rnd.choice([0, 1, 5, 255, 1000, 1 << 20])) for a in (rnd.randrange(1 << 31) for _ in range(200))] + [(0, (1 << 32) - 1), (0, 0), ((1 << 32) - 1, (1 << 32) - 1), (7, 8), (9, 3)]
    for a, b, found in spark.createDataFrame(rows, "a long, b long").select("a", "b", R.blocks(F.col("a"), F.col("b"))).collect():
        parts = sorted((x["block"] << x["bits"], (x["block"] + 1) << x["bits"]) for x in found)
        if a > b:
            assert not parts
            continue
        assert parts[0][0] == a and parts[-1][1] == b + 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:])) and len(parts) <= 62


def test_smallest_range_of_each_address(spark):
    rnd = random.Random(2)
    spans = [(a, a + rnd.choice([0, 3, 100, 5000, 1 << 24]), i) for i, a in enumerate(rnd.randrange(1 << 28) for _ in range(150))]
    table = spark.createDataFrame([(name(a), name(b), i) for a, b, i in spans] + [("x", "1.1.1.1", -1), ("9.9.9.9", "9.9.9.0", -2), (None, None, -3)], "first_ip string, last_ip string, place long")
    asked = [rnd.choice([a, b, a - 1, b + 1, rnd.randrange(1 << 29)]) for a, b, _ in spans for _ in range(3)]
    rows = [(k, name(n % (1 << 32))) for k, n in enumerate(asked)] + [(9000, None), (9001, "no address"), (9002, "::1")]
    got = {r.k: r.place for r in R.in_ranges(spark.createDataFrame(rows, "k long, src_ip string"), "src_ip", table, ["place"]).collect()}
    best = lambda n: min(((b - a, a, i) for a, b, i in spans if a <= n <= b), default=(0, 0, None))[2]
    assert got == {k: best(n) for k, n in enumerate(asked)} | {9000: None, 9001: None, 9002: None}
    assert R.in_ranges(spark.createDataFrame(rows[:3], "k long, src_ip string"), "src_ip", table.limit(0), ["place"]).where("place IS NOT NULL").count() == 0


def test_planted_travel(spark):
    places = spark.createDataFrame([("10.0.0.0", "10.0.0.99", 52.5, 13.4), ("10.0.1.7", "10.0.2.3", 40.7, -74.0), ("10.0.3.0", "10.0.3.255", 52.4, 13.1)], "first_ip string, last_ip string, lat double, lon double")
    hour = 3_600_000_000
    rows = [("a", 0, "10.0.0.5"), ("a", hour, "10.0.1.9"), ("a", 20 * hour, "10.0.0.5"), ("a", 21 * hour, "10.0.3.1"), ("b", 0, "10.0.0.5"), ("b", 5, "9.9.9.9"), ("b", 10 * hour, "10.0.2.3"), ("c", 0, "10.0.2.0"), ("c", 0, "10.0.0.1"), (None, 0, "10.0.0.1")]
    df = spark.createDataFrame([(u, us, ip, "f", i) for i, (u, us, ip) in enumerate(rows)], "user string, us long, src_ip string, src_file string, line_no long")
    got = {r.line_no: r for r in R.impossible_travel(df, places).collect()}
    assert set(got) == {1, 8} and got[1].km == pytest.approx(6385, rel=0.01) and got[1].kmh == pytest.approx(got[1].km) and math.isfinite(got[8].kmh)


def test_leaked_accounts(spark):
    rows = [("a", f"1.1.1.{i % 6}") for i in range(20)] + [("b", f"1.1.1.{i}") for i in range(9)] + [("c", "1.1.1.1")] * 50
    got = R.leaked_accounts(spark.createDataFrame(rows, "user string, src_ip string"), spark.createDataFrame([("a",), ("c",), ("a",)], "user string"))
    assert [tuple(r) for r in got.collect()] == [("a", 6, 20)]
