"""Every query against its SQL."""

from __future__ import annotations

import pytest

from huntframe.plans import registry
from tests import oracle

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, sf, name):
    oracle.check(spark, con, name, QUERIES[name], SQL[name], sf)


def test_all_but_the_sum_have_sql():
    assert set(QUERIES) - set(SQL) == {"traf_findings_by_rule"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["rule_id", "severity", "hits"]
    assert set(QUERIES) <= set(entry.queries())


def test_summed_traffic_findings_match_the_single_rules(spark, sf):
    from pyspark.sql import functions as F

    from huntframe.plans import traffic

    flows = traffic._all(spark, sf)
    total = {r.rule_id: r.hits for r in traffic.traf_findings_by_rule(spark, sf).groupBy("rule_id").agg(F.sum("hits").alias("hits")).collect()}
    single = {r.rule_id: r["count"] for r in traffic.rules.detect(flows).groupBy("rule_id").count().collect()}
    assert {k: v for k, v in total.items() if k != "R-TRAF-999"} == single
    assert total["R-TRAF-999"] > 0
