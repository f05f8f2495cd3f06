"""Signature automata against patterns tried one by one."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from huntframe.operators import signatures as S
from huntframe.rules import libraries, traffic


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"(?i)SqlMap", {"sqlmap"}), (r"union\s+select", {"select"}), (r"(?:alpha|beta)+x", {"alpha", "beta"}), (r"(?:alpha|b)", None), (r"a.*longer", {"longer"}), (r"x?need(?=ahead!)", {"ahead!"}),
        (r"[aA][bB][cC]d", {"abcd"}), (r"\d+", None), (r"(abc)?de", None), (r"(?!never)there", {"there"}), (r"^$", None), (r"éclair-abc", {"clair-abc"}), (r"(?P<n>quote)(?P=n)", {"quote"}), (r"abc{2,}", None),
        (r"a(?:b|c(?:dee|eff))zzz", {"zzz"}), (r"(?i)\bxray\b", {"xray"}),
    ],
)
def test_literals(pattern, want):
    assert S.literals(pattern) == (want and frozenset(want))


def test_every_match_has_a_literal():
    rnd = random.Random(3)
    atoms = ["abc", "de", "[xy]", "(?:foo|barr)", "(qux)+", "z?", r"\d", ".", "K", "(?i:Mix)", "(?=foo)", "s{3}", "[kK]"]
    for _ in range(3000):
        pattern = ("(?i)" if rnd.random() < 0.5 else "") + "".join(rnd.choices(atoms, k=rnd.randint(1, 4)))
        texts = S.literals(pattern)
        value = "".join(rnd.choices(["abc", "de", "x", "foo", "barr", "qux", "z", "1", "K", "k", "MIX", "Mix", "sss", "ABC", "É"], k=8))
        if re.compile(pattern, re.ASCII).search(value) and texts:
            assert any(t in value.lower() for t in texts), (pattern, value)


def planted(n, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    shapes = [lambda: f"(?i){word()}/[0-9]+", lambda: rf"\b{word()}\b", lambda: f"^/{word()}\\.(?:php|jsp)$", lambda: f"(?:{word()}|{word()})x?", lambda: rf"{word()}.*{word()}"]
    return [(f"S-{i}", "ua" if i % 3 else "uri", rnd.choice(shapes)()) for i in range(n)]


def values(signatures, n, seed=2):
    rnd = random.Random(seed)
    parts = [w for _, _, p in signatures for w in re.findall("[a-j]{6}", p)] or ["abcdef"]
    return [rnd.choice(["", "/", "x "]) + rnd.choice(parts).upper() * rnd.randint(0, 1) + rnd.choice(parts) + rnd.choice(["", ".php", "/77", " " + rnd.choice(parts), "x"]) for _ in range(n)]


def test_hits_as_one_by_one(spark):
    signatures = [*planted(300), ("dup", "ua", "abc"), ("dup", "ua", "abc"), ("short", "uri", "^/.$"), ("any", "ua", r"\d{2}$"), ("other", "nowhere", ".")]
    rnd = random.Random(5)
    texts = [None, "", *values(signatures, 300)]
    rows = [(i, rnd.choice(texts), rnd.choice(texts), "x") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, ua string, uri string, field2 string").repartition(3)
    table = spark.createDataFrame([*signatures, ("null", "ua", None), ("broken", "ua", "("), ("empty", "ua", "")], "sig_id string, field string, pattern string")
    got = S.hits(df, {"ua": F.col("ua"), "uri": F.col("uri")}, table).select("id", "sig_id", "pattern").collect()
    want = [(i, s, p) for i, ua, uri, _ in rows for s, f, p in signatures if f in ("ua", "uri") and (v := ua if f == "ua" else uri) and re.search(p, v, re.ASCII)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 200
    assert S.hits(df.limit(0), {"ua": F.col("ua")}, table).count() == 0
    assert S.hits(df, {"ua": F.col("ua")}, table.limit(0)).count() == 0


def test_1800_signatures_cost_little_more_than_60():
    texts = values(planted(1800), 30_000, 4)

    def took(n):
        match = S.Matcher([(i, p, S.literals(p)) for i, (_, _, p) in enumerate(planted(1800)[:n])])
        began = time.process_time()
        for t in texts:
            match(t)
        return time.process_time() - began, match.tried

    few, many = min(took(60)[0] for _ in range(3)), min(took(1800)[0] for _ in range(3))
    assert many < 2 * few + 0.35 and took(1800)[1] < 8 * len(texts)


def test_traffic_by_automaton_gives_the_rows_of_its_branches(spark):
    from tests.test_rules import flow_rows, traffic_fixture

    own = [(f"X-{i}", c, v, f, p, t, "high") for i, (c, v, f, p, t) in enumerate([
        ("scanner", "http", "ua", "(?i)whatweb", "w"), ("webshell", "http", "uri", r"(?i)/index\.jsp$", "i"), ("c2", "dns", "qname", r"tunnel\.example", "dga"),
        ("tunnel", "tls", "sni", "(?i)VIPER", "frp"), ("none", "http", "uri", "/", "z"), ("c2", "flow", "dst_port", "^44", "t"),
    ])]
    flows = flow_rows(spark, [*traffic_fixture(), {"view": "flow", "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "dst_port": 4444, "raw": {"duration_s": 301.0, "payload_first_bytes": "PSEXESVC"}}])
    signatures = [*traffic.SIGNATURES, *own]
    columns = ("line_no", "ordinal", "rule_id", "severity", "extra")
    branches = traffic.detect(flows, signatures).select(*columns).collect()
    automaton = traffic.detect(flows, signatures, few=0).select(*columns).collect()
    assert sorted(map(tuple, automaton), key=repr) == sorted(map(tuple, branches), key=repr)
    assert {"R-TRAF-005", "R-TRAF-201"} <= {r.rule_id for r in automaton if r.extra and "sig_id" in r.extra}


def test_indicator_patterns_by_automaton(spark):
    from huntframe.operators import iocs

    rows = [("1.1.1.1", "/cm?x", "sqlmap/1"), ("1.1.1.1", "/a/.env", "Nuclei"), (None, None, None), ("2.2.2.2", "", ""), ("3.3.3.3", "/evil.php?q", "tool-x/9"), ("3.3.3.3", "/news.php", "curl/7")]
    log = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "src_ip string, uri string, ua string, line_no int")
    mine = iocs.indicators([
        *[dict(zip(iocs.FIELDS, r, strict=True)) for r in libraries.IOCS], {"type": "url", "value": r"evil\.php\?q", "confidence": "high", "tag": "u"},
        {"type": "tool", "value": "tool-x", "ua_pattern": r"tool-x/\d", "uri_pattern": "(?i)EVIL", "confidence": "high", "tag": "tool"}, {"type": "tool", "value": "t2", "uri_pattern": "news", "confidence": "low", "tag": "tool"},
    ])
    by_branch, by_automaton = (sorted(map(repr, iocs.matched(log, mine, few=few).select("line_no", "iocs").collect())) for few in (1000, 0))
    assert by_branch == by_automaton and "t2" in str(by_branch)


def test_joined_signatures_as_held_ones(spark, monkeypatch):
    """Of tables that no worker holds: literals longer than their key, none, several; patterns that only compiling refuses."""
    monkeypatch.setattr(S, "KEY_CHARS", 5)
    signatures = [
        *planted(300), ("dup", "ua", "abc"), ("dup", "ua", "abc"), ("twin", "ua", "abc"), ("short", "uri", "^/.$"), ("any", "ua", r"\d{2}$"), ("other", "nowhere", "."), ("behind", "ua", "(?<=a+)bcdef"),
        ("null", "ua", None), ("broken", "ua", "("), ("empty", "ua", ""),
    ]
    rnd = random.Random(5)
    texts = [None, "", "/z", "abc", "abcab", "x10", *values(planted(300), 300)]
    df = spark.createDataFrame([(i, rnd.choice(texts), rnd.choice(texts)) for i in range(500)], "id int, ua string, uri string")
    table = spark.createDataFrame(signatures, "sig_id string, field string, pattern string")
    fields = {"ua": F.col("ua"), "uri": F.col("uri")}
    held = sorted(map(tuple, S.hits(df, fields, table).collect()), key=repr)
    assert len(held) > 200 and {"short", "any", "dup", "twin"} <= {r[3] for r in held}
    for always in (S.MOST_ALWAYS, 0):
        monkeypatch.setattr(S, "MOST_ALWAYS", always)
        got = S.hits(df, fields, table, most_held=10)
        assert got.columns == S.hits(df, fields, table).columns
        assert sorted(map(tuple, got.collect()), key=repr) == held
    assert S.hits(df, fields, table.where("field = 'nowhere'"), most_held=0).count() == 0


def test_more_signatures_than_are_collected(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_SIGNATURES", 50)
    monkeypatch.setattr(S, "MOST_HELD", 50)
    table = spark.range(60).select(F.col("id").cast("string").alias("sig_id"), F.lit("ua").alias("field"), F.concat(F.lit("tool"), F.col("id") + 100, F.lit("$")).alias("pattern"))
    df = spark.createDataFrame([("x tool123",), ("tool1234",)], "ua string")
    assert [r.sig_id for r in S.hits(df, {"ua": F.col("ua")}, table, S.MOST_HELD).collect()] == ["23"]
