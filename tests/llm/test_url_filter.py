"""URL rules: the cascade against rules tried one by one, and against the join."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from huntframe.llm import queries, url_filter
from tests import oracle


def by_hand(url, rules, default="allow"):
    url = url or ""
    if "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


def random_rules(rnd, n):
    hosts = ["a", "b.a", "c.b.a", "org", "x.org", "y.x.org", "é.org", "", "a..b"]
    paths = ["", "/", "/p", "/p/", "/p/q", "/é", "/p/q/r?"]
    return [(rnd.choice(hosts), rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(n)]


def random_urls(rnd, n):
    hosts = ["a", "b.a", "z.c.b.a", "C.B.A", "org", "X.org", "w.y.x.org", "é.org", "É.org", "", ".org", "a..b", "q.a..b", "nothing", "org:80"]
    paths = ["", "/", "/p", "/p/", "/p/q", "/é", "/péq", "/p/q/r", "?x=/p", "#/p", "//p", "/p?://a/"]
    urls = [f"{rnd.choice(['http', 'HTTPS', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}" for _ in range(n)]
    return [*urls, None, "", "no scheme/p", "a://", "://org/p", "http://a\n/p", "http:/org/p", "http://" + "a." * 3000 + "org/" + "p/" * 5000]


@pytest.mark.parametrize("most_bytes", [url_filter.MOST_BYTES, 0])
def test_rules_as_tried_one_by_one(spark, most_bytes):
    rnd = random.Random(13)
    for n in (0, 1, 5, 40):
        rules, urls = random_rules(rnd, n), random_urls(rnd, 400)
        df = spark.createDataFrame([(i if i % 7 else None, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, host string").repartition(3)
        got = url_filter.judge(df, url_filter.rule_table(spark, rules), "block", most_bytes)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"] and got.schema["page_id"].dataType.simpleString() == "int"
        want = [(i if i % 7 else None, *by_hand(u, rules, "block")) for i, u in enumerate(urls)]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, url_filter.rule_table(spark, queries.URL_RULES)).count() == 0


def test_a_cascade_is_exact_on_its_universe_and_small(spark):
    keys = spark.range(2000).select(F.concat(F.lit("listed-"), "id").alias("key"))
    others = spark.range(60_000).select(F.concat(F.lit("other-"), "id").alias("key"))
    universe = keys.where("key < 'listed-7'").unionByName(others).unionByName(others.limit(100))
    cascade = url_filter.build(keys, universe, 2000, 62_000)
    assert len(cascade.levels) > 3 and cascade.n_bytes * 8 < 1.5 * 2000 * (np.log2(62_000 / 2000) + 3) + 64 * len(cascade.levels)
    rows = universe.distinct().select("key", *(h.alias(f"h{i}") for i, h in enumerate(url_filter.hashes(F.col("key"))))).toArrow()
    said = cascade.has(rows["h0"].to_numpy(), rows["h1"].to_numpy())
    assert said.tolist() == [k.startswith("listed") for k in rows["key"].to_pylist()]


def test_without_its_later_levels_it_would_err(spark):
    keys = spark.range(500).select(F.concat(F.lit("listed-"), "id").alias("key"))
    others = spark.range(20_000).select(F.concat(F.lit("other-"), "id").alias("key"))
    cascade = url_filter.build(keys, keys.unionByName(others), 500, 20_500)
    rows = others.select(*(h.alias(f"h{i}") for i, h in enumerate(url_filter.hashes(F.col("key"))))).toArrow()
    first = url_filter.Cascade(cascade.levels[:1])
    assert first.has(rows["h0"].to_numpy(), rows["h1"].to_numpy()).sum() > 50
    assert not cascade.has(rows["h0"].to_numpy(), rows["h1"].to_numpy()).any()


def test_query_gives_the_rows_of_its_sql(spark, sf):
    con = oracle.connect(sf)
    assert oracle.check(spark, con, "op13_url_filter", queries.op13_url_filter, queries.OP13_SQL, sf) > 0
    assert con.sql(f"SELECT count(DISTINCT rule) FROM ({queries.OP13_SQL})").fetchall()[0][0] == 5


def test_judging_joins_nothing(spark, sf):
    plan = queries.op13_url_filter(spark, sf)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan
