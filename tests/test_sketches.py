"""Sketches merged over windows against exact counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntframe.operators import sketches as S
from huntframe.operators.windows import HOUR


def rows(spark, n=200_000):
    busy = F.when(F.col("id") % 3 > 0, F.lit("busy")).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    value = F.when(F.col("id") % 5 == 0, F.lit("often")).otherwise(F.concat(F.lit("v"), F.xxhash64("id") % 60_000))
    return spark.range(n).select(busy.alias("k"), (F.col("id") * 1_000_000).alias("us"), value.alias("v"))


def test_errors_of_any_window(spark):
    df = rows(spark)
    table = S.per_slab(df, ["k"], F.col("v")).cache()
    for first, last in ((None, None), (3, 20), (10, 10)):
        low, high = (F.lit(x) if x is not None else None for x in (first, last))
        got = {r.k: r for r in S.estimates(S.merged(table, ["k"], low, high), ["k"]).collect()}
        part = df if first is None else df.where(F.floor(F.col("us") / HOUR).between(first, last))
        want = {r.k: r for r in part.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("v").alias("d"), F.count_if(F.col("v") == "often").alias("often")).collect()}
        assert set(got) == set(want)
        for k, r in got.items():
            assert r.n == want[k].n and abs(r.distinct - want[k].d) <= max(1, 0.05 * want[k].d), (k, r.distinct, want[k].d)
            if want[k].often > 10:
                assert r.top[0]["item"] == "often" and abs(r.top[0]["count"] - want[k].often) <= 0.01 * r.n
    assert {r.k for r in S.over_values(S.merged(table, ["k"]), ["k"], 5000).collect()} == {"busy"}
    everything = S.estimates(S.merged(table, []), []).first()
    assert everything.n == df.count()


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", None, "x"), ("b", 2, "x"), ("b", 2, "x"), ("b", HOUR, "y")], "k string, us long, v string")
    table = S.per_slab(df, ["k"], F.col("v"))
    got = {r.k: (r.n, r.distinct, [(t["item"], t["count"]) for t in r.top]) for r in S.estimates(S.merged(table, ["k"]), ["k"]).collect()}
    assert got == {"a": (1, 0, []), "b": (3, 2, [("x", 2), ("y", 1)])}
    assert S.per_slab(df.limit(0), ["k"], F.col("v")).count() == 0
