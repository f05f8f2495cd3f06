"""Queries on rows that the given tables don't have, and what happens where a table grows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from huntframe.plans.registry import oracle_sql, queries
from tests import oracle


@pytest.fixture
def changed(spark, sf, tmp_path):
    """The driver's smallest tables, of which some are replaced: ``changed(events=df)`` is their folder."""

    def of(**tables):
        for name in oracle.TABLES:
            at = tmp_path / f"{name}.parquet"
            if name in tables:
                tables[name].write.parquet(str(at))
            else:
                os.symlink(f"{sf}/{name}.parquet", at)
        return str(tmp_path)

    return of


def as_sql(spark, sf, name):
    return oracle.check(spark, oracle.connect(sf), name, queries()[name], oracle_sql()[name], sf)


def test_rejected_calls_of_one_time(spark, sf, changed):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert as_sql(spark, changed(events=events.unionByName(events.withColumn("event_id", F.col("event_id") + 1_000_000))), "audit_rejected") > 0


def test_new_networks_of_users_beyond_the_addresses(spark, sf, changed):
    events = spark.read.parquet(f"{sf}/events.parquet")
    more = events.withColumns({"event_id": F.col("event_id") + 1_000_000, "user_id": F.col("user_id") + 9000})
    assert as_sql(spark, changed(events=events.unionByName(more)), "auth_new_root_subnet") > 0


def test_roots_from_outside_of_users_beyond_the_addresses(spark, sf, changed):
    events = spark.read.parquet(f"{sf}/events.parquet")
    more = events.withColumns({"event_id": F.col("event_id") + 1_000_000, "user_id": F.col("user_id") + 9000})
    assert as_sql(spark, changed(events=events.unionByName(more)), "auth_outside_roots") > 0


@pytest.mark.parametrize("name", ["desensitize_keep_public", "desensitize_relaxed", "desensitize_strict"])
def test_lines_behind_documents_that_end_in_a_phrase(spark, sf, changed, name):
    """What the text's last words begin ends with the text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    ends = ["made by", "user:", "User =", "username: ", "for", "for invalid user", "by  ", "see /home/", "mail a@b.co", "", None]
    more = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(ends)], "doc_id long, text string")
    assert as_sql(spark, changed(documents=docs.unionByName(more, allowMissingColumns=True)), name) == 20 + len(ends)


def test_rule_files_of_one_small_table_are_read_by_all_tasks(spark):
    from huntframe.rules import compile as rule_compile

    files = spark.range(200).coalesce(1).select(F.concat(F.lit("/r/"), "id").alias("path"), F.concat(F.lit("title: t"), "id", F.lit("\nlogsource: {category: dns_query}")).alias("value"))
    parts = rule_compile.from_sigma(files).rdd.getNumPartitions()
    assert parts >= spark.sparkContext.defaultParallelism


def test_lines_are_parsed_once_and_by_all_tasks(spark, sf):
    from huntframe.plans import base
    from huntframe.sources import logs

    assert base.web(spark, sf, deal=True).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    lines = spark.range(3).select(F.lit("a").alias("src_file"), F.col("id").alias("line_no"), F.concat(F.lit('{"status": "'), "id", F.lit('"}')).alias("value"), F.lit("nginx-access").alias("log_type"))
    plan = logs.parse_lines(lines, 2024)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_rules_of_a_record_run_once_and_are_compiled(spark, sf):
    """Neither as a lambda's argument, which is interpreted, nor once more in a filter on the array's size."""
    from huntframe.plans import traffic

    plan = traffic.hits(traffic.flows(traffic.HTTP.spark(spark, sf), "http"), traffic.rules.http_branches())._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "size(array(" not in plan and "filter(array(" not in plan


def test_correlated_sources_and_ids_read_hits_that_are_written(spark, sf):
    from huntframe.plans import traffic

    plan = traffic.rules.findings(traffic._all(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan
    correlate = traffic.correlate_multi_rule(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert correlate.count("Repartition ") == 3


def test_internal_addresses_by_their_beginning(spark):
    """The same as by their number, of which none is made."""
    from huntframe.functions import net

    ips = ["0.1.2.3", "10.0.0.0", "10.255.255.255", "100.0.0.1", "11.0.0.1", "127.0.0.1", "169.254.1.1", "169.253.1.1", "172.15.0.1", "172.16.0.0", "172.31.255.255", "172.32.0.0", "172.160.0.1"]
    ips += ["192.168.0.1", "192.169.0.1", "1.10.0.1", "10.1", "10.0.0.256", "010.0.0.1", "10.0.0.1x", "10.0.0.1.2", "", "::1", None]
    rows = spark.createDataFrame([(ip,) for ip in ips], "ip string")
    by_number = F.coalesce(net.in_blocks(net.ip_number(F.col("ip")), net.INTERNAL), F.lit(False))
    made = rows.select("ip", net.is_internal(F.col("ip")).alias("got"), by_number.alias("want"))
    assert [r for r in made.collect() if r.got != r.want] == [] and made.where("got").count() == 8
    assert "split(" not in rows.select(net.is_internal(F.col("ip")))._jdf.queryExecution().optimizedPlan().toString()


def test_marks_are_carried_to_slabs_that_have_rows_only(spark):
    """A mark a day ahead makes one row of a slab with rows, not one of each slab between."""
    from huntframe.operators.windows import DAY, HOUR, as_of

    rows = spark.createDataFrame([("a", 0), ("a", 3 * HOUR), ("a", 30 * HOUR), ("b", 5), (None, 1)], "k string, us long")
    marks = spark.createDataFrame([("a", 24 * HOUR, 1), ("a", 24 * HOUR, 2), ("a", 40 * HOUR, 3), ("b", 5 + DAY, 4)], "k string, us long, v int")
    found = as_of(rows, marks, ["k"], DAY, "v", "near")
    assert sorted((r.k, r.us, r.near) for r in found.collect()) == [("a", 0, 1), ("a", 3 * HOUR, 1), ("a", 30 * HOUR, 3), ("b", 5, 4)]
    before = as_of(rows, marks, ["k"], DAY, "v", "near", forward=False)
    assert [(r.k, r.us, r.near) for r in before.collect()] == [("a", 30 * HOUR, 1)]
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()
