"""Indicators from a table, by a Bloom filter and a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from huntframe.operators import indicator_table as T
from huntframe.operators.bloom import Bloom
from tests.test_windows import final_plan, splitting

TABLE = [("ip", "1.1.1.1"), ("IP", " 1.1.1.1 "), ("domain", "Evil.example"), ("domain", "*.evil.example"), ("hash:md5", "ABC"), ("ip", "10.0.0.0/8"), ("path", "/x"), ("domain", ""), ("ip", None), (None, "x")]
RECORDS = [(1, "1.1.1.1", "evil.example", None), (2, "2.2.2.2", "a.B.evil.example", "abc"), (3, None, None, None), (4, "", "notevil.example", "abcd"), (5, "10.0.0.1", "example", ""), (6, " 1.1.1.1", "evil.example.org", None)]
WANT = [(1, "domain", "evil.example"), (1, "ip", "1.1.1.1"), (2, "domain", "*.evil.example"), (2, "hash:md5", "abc"), (6, "ip", "1.1.1.1")]


def test_hits_with_and_without_the_filter(spark):
    records = spark.createDataFrame([(*r, "mine") for r in RECORDS], "id int, src_ip string, host string, md5 string, ioc string").drop("ioc")
    table = spark.createDataFrame([(k, v, "high", "t") for k, v in TABLE], "type string, value string, confidence string, tag string")
    values = {"ip": F.col("src_ip"), "domain": F.col("host"), "hash:md5": F.col("md5")}
    for most in (1 << 20, 0):
        got = T.hits(records, values, table, most).select("id", F.lower("ioc.type"), F.lower(F.trim("ioc.value"))).collect()
        assert sorted(map(tuple, got)) == WANT
    assert T.hits(records.limit(0), values, table).count() == T.hits(records, values, table.limit(0)).count() == 0


def test_a_million_indicators(spark):
    table = spark.range(1_000_000).select(F.lit("ip").alias("type"), F.concat(F.lit("bad-"), "id").alias("value"), F.lit("high").alias("confidence"), F.lit("t").alias("tag"))
    records = spark.range(200_000).select("id", F.concat(F.when(F.col("id") % 1000 == 0, F.lit("bad-")).otherwise(F.lit("good-")), "id").alias("src_ip"))
    known = T.keyed(table)
    bloom = Bloom.of(known, "__key")
    h = records.select(F.xxhash64(F.concat(F.lit("ip:"), "src_ip")).alias("h"), (F.col("id") % 1000 == 0).alias("bad")).toArrow()
    said = bloom.passes(h["h"].to_numpy())
    assert said[h["bad"].to_numpy(zero_copy_only=False)].all() and said.sum() < 200 + 0.02 * 200_000 and bloom.words.nbytes == 1_250_000
    assert T.hits(records, {"ip": F.col("src_ip")}, table).count() == 200
    assert not Bloom(np.zeros(1, np.uint64)).passes(np.arange(5)).any()


def test_a_busy_address_is_split(spark):
    own = splitting(spark)
    records = own.range(60_000).repartition(6).select("id", F.when(F.col("id") % 3 > 0, F.lit("bad-7")).otherwise(F.concat(F.lit("bad-"), F.col("id") % 5000)).alias("src_ip"), F.sha2(F.col("id").cast("string"), 256).alias("raw_line"))
    table = own.range(5000).select(F.lit("ip").alias("type"), F.concat(F.lit("bad-"), "id").alias("value"), F.lit("high").alias("confidence"), F.lit("t").alias("tag"))
    found = T.hits(records, {"ip": F.col("src_ip")}, table)
    assert len(found.collect()) == 60_000
    assert "skew=true" in final_plan(found)
