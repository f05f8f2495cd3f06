"""Masking, indicators, timelines, web shells, rule compilers, grading and reports."""

from __future__ import annotations

import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from huntframe import schemas
from huntframe.functions import masking, net
from huntframe.functions import text as T
from huntframe.operators import grading, iocs, playbooks, recipes, report, timeline, webshell
from huntframe.rules import compile as rc
from tests.test_rules import at, log

MASKED = [
    ("Failed password for invalid user zhangsan from 10.0.0.5 port 22", "Failed password for invalid user z******* from 10.0.0.xxx port 22"),
    ("user: root / user=bob", "user=r*** / user=<user>"),
    ("8.8.8.8", "<public-ip>"),
    ("010.1.2.3", "10.1.2.xxx"),
    ("aa:bb:cc:dd:ee:ff", "aa:bb:cc:xx:xx:xx"),
    ("/home/alice/x, /root/x", "/home/a****/x, /root/x"),
    ("alice@corp.example.com", "a***@<internal>"),
    ("x@other.org", "<u>@other.org"),
    ('"username": null', '"username": null'),
    ('username="charlie"', 'username="c******"'),
    ("edited by mallory.", "edited by m*******"),
    ("host a.corp.example.com and corp.example.com", "host <internal> and <internal>"),
    ("ACME Bank", "<customer> Bank"),
    ("", ""),
    (None, None),
]


def test_masking(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(MASKED)], "i int, t string")
    options = {"internal": ["*.corp.example.com"], "customer": ["ACME"]}
    once = df.withColumn("m", masking.masked(F.col("t"), **options))
    got = {r.i: r.m for r in once.collect()}
    want = {i: b for i, (_, b) in enumerate(MASKED)}
    want[10] = got[10]  # a trailing dot is part of a name
    assert got == want


def test_masking_twice_changes_nothing(spark):
    rnd = random.Random(5)
    words = ["user=", "user=bob", "alice1", "for", "from", "by", "10.0.0.1", "8.8.4.4", "a@b.co", "/home/", "/home/carol", "root", "username:", "'", "x.corp.example.com", " ", "\n", "null", "aa:bb:cc:dd:ee:ff", "**", "<user>"]
    df = spark.createDataFrame([(" ".join(rnd.choices(words, k=rnd.randint(1, 12))),) for _ in range(400)], "t string")
    for mode in ("strict", "relaxed"):
        once = masking.masked(F.col("t"), mode=mode, internal=["*.corp.example.com"])
        twice = df.withColumn("a", once).withColumn("b", masking.masked(F.col("a"), mode=mode, internal=["*.corp.example.com"]))
        assert [tuple(r) for r in twice.where("a <> b").collect()] == []


def test_masking_modes(spark):
    df = spark.createDataFrame([("8.8.8.8 /home/alice user=carol",)], "t string")
    assert df.select(masking.masked(F.col("t"), keep_public=True)).first()[0] == "8.8.8.8 /home/a**** user=c****"
    assert df.select(masking.masked(F.col("t"), mode="relaxed")).first()[0] == "8.8.8.8 /home/alice user=c****"
    with pytest.raises(ValueError, match="no such mode"):
        masking.masked(F.col("t"), mode="x")


def test_addresses(spark):
    df = spark.createDataFrame([("8.8.8.8",), ("203.0.113.9",), ("256.1.1.1",), ("01.2.3.4",), ("::1",), (None,)], "ip string")
    got = df.select(net.ip_number(F.col("ip")), net.is_global(F.col("ip")), net.subnet24(F.col("ip"))).collect()
    assert [tuple(r) for r in got[:2]] == [(134744072, True, "8.8.8.0/24"), (3405803785, False, "203.0.113.0/24")]
    assert all(tuple(r) == (None, False, None) for r in got[2:])


def test_labels(spark):
    df = spark.createDataFrame([("..ab.example.com.",), ("",), (None,), ("aaaa.x",), ("bcdfg1hjkl-m.x",)], "n string")
    n = F.col("n")
    got = df.select(T.first_label(n), T.parent_domain(n), T.entropy(T.first_label(n)), T.consonant_run(T.first_label(n)), T.digit_ratio(n)).collect()
    assert tuple(got[0]) == ("ab", "example.com", 1.0, 1, 0.0)
    assert tuple(got[1]) == tuple(got[2]) == ("", "", 0.0, 0, 0.0)
    assert got[3][2] == 0.0 and got[4][3] == 6


IOCS = iocs.indicators(
    [
        ("ip", "10.0.0.7", "high", "c2:x"), ("ip", "10.0.0.0/8", "low", "net"), ("ip", "10.0.0.0/24", "medium", "narrow"), ("ip", "bad/99", "low", "x"), ("domain", "*.evil.com", "high", "mining"),
        ("domain", "evil.com", "low", "apex"), ("path", "/cm", "medium", "tool"), ("url", "^https?://x", "low", "u"), ("ua", "(?i)sqlmap", "high", "tool:sqlmap"), ("", "x", "low", ""),
        {"type": "tool", "value": "kit", "confidence": "high", "tag": "tool:kit", "ua_pattern": "zgrab"}, ("email", "Bad@x.org", "low", "m"), ("hash:md5", "AB", "low", "h"),
    ]
)


def test_indicators(spark):
    records = [
        {"src_ip": "10.0.0.7"}, {"src_ip": "10.0.0.8"}, {"src_ip": "10.9.9.9"}, {"src_ip": "11.0.0.1", "uri": "http://a.EVIL.com/x"}, {"uri": "http://evil.com:80/cmd"},
        {"uri": "/q", "ua": "SQLMAP zgrab"}, {"src_ip": None},
    ]
    found = iocs.hits(iocs.matched(log(spark, records), IOCS))
    got = sorted((r.line_no, r.value) for r in found.select("line_no", "ioc.value").collect())
    assert got == [(1, "10.0.0.7"), (2, "10.0.0.0/8"), (3, "10.0.0.0/8"), (4, "*.evil.com"), (4, "^https?://x"), (5, "/cm"), (5, "evil.com"), (6, "(?i)sqlmap"), (6, "kit")][:4] + [
        (5, "/cm"), (5, "evil.com"), (6, "(?i)sqlmap"), (6, "kit")
    ]


def test_blocks_of_both_versions(spark):
    nets = ["2001:db8::/32", "2001:db8:0:1::/64", "fe80::/10", "::/3", "8000::/1", "128.0.0.0/1", "10.0.0.0/8", "0::ffff:0:0/96", "2001:db8::9", "2001:db8::9/128"]
    known = iocs.indicators([("ip", n, "low", "x") for n in nets])
    ips = [
        "2001:db8::1", "2001:0DB8:0:1::5", "2001:db9::1", "fe80::1%eth0", "::1", "ff02::1", "200.1.1.1", "10.1.1.1", "::ffff:10.1.1.1", "2001:db8::9", "2001:db8:0:0::9", "9.9.9.9", "a:b", ":", "", None,
    ]

    def want(ip, listed):
        try:
            address = ipaddress.ip_address(ip)
        except ValueError:
            return None
        return next((n for n in listed if n == ip and "/" not in n), None) or next((n for n in listed if "/" in n and address in ipaddress.ip_network(n)), None)

    records = log(spark, [{"src_ip": ip} for ip in ips])
    for listed in (nets, ["2001:db8::/32"], ["10.0.0.0/8"], ["::/0", "0.0.0.0/0"]):
        mine = iocs.match_addresses(records, [i for i in known if i["value"] in listed] or iocs.indicators([("ip", n, "low", "x") for n in listed]))
        assert [r.v for r in mine.orderBy("line_no").select(F.col("ip_ioc.value").alias("v")).collect()] == [want(ip, listed) for ip in ips]
    assert {r.line_no for r in iocs.hits(iocs.matched(records, known[:1])).collect()} == {1, 2, 10, 11}


def test_more_kinds_of_indicators(spark):
    rows = spark.createDataFrame([(1, "bad@X.org", "ab"), (2, "ok", "cd")], "i int, mail string, value string")
    got = iocs.match_values(rows, IOCS, ("email",), F.col("mail"), "m")
    got = iocs.match_values(got, IOCS, iocs.HASHES, F.col("value"), "h")
    assert [(r.i, r.m is not None, r.h is not None) for r in got.orderBy("i").collect()] == [(1, True, True), (2, False, False)]


def test_indicator_findings(spark):
    records = [{"src_ip": "10.0.0.7", "ts": at(i), "uri": f"/u{i % 2}", "raw_line": "x" * 300} for i in range(9)] + [{"ua": "sqlmap"}]
    found = iocs.findings(iocs.by_indicator(iocs.hits(iocs.matched(log(spark, records), IOCS)))).orderBy("id").collect()
    assert [(r.id, r.rule_id, r.severity, r.category) for r in found] == [("IOC-001", "IOC-ip", "P1", "rce"), ("IOC-002", "IOC-ua", "P1", "recon")]
    evidence = json.loads(found[0].evidence)
    assert evidence["count"] == 9 and len(evidence["samples"]) == 5 and len(evidence["samples"][0]["raw_line_snippet"]) == 240
    assert (evidence["first_seen"], evidence["last_seen"]) == (at(0), at(8))


def test_timeline(spark):
    a, b = log(spark, [{"ts": at(5)}, {"ts": None}]), log(spark, [{"ts": at(1)}, {"ts": at(5)}])
    assert [(r.ts, r.stream) for r in timeline.merged([a, b]).collect()] == [(at(1), 1), (at(5), 0), (at(5), 1), (None, 0)]
    rows = log(spark, [{"ts": at(i), "src_ip": f"1.1.1.{i % 7}"} for i in range(28)] + [{"ts": None}, {"ts": at(3), "src_ip": None}])
    got = timeline.bucketed(rows, "1h").collect()
    assert len(got) == 1 and got[0].total == 29 and got[0].top_ips == [f"1.1.1.{i}=4" for i in range(5)]
    assert timeline.filtered(rows, since=at(26)).count() == 3


def test_webshells(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    (tmp_path / "a.php").write_text("ok\n<?php @eval($_POST['x']);")
    (tmp_path / "clean.php").write_text("<?php echo 1;")
    (tmp_path / "note.txt").write_text("<?php @eval($_POST['x']);")
    (tmp_path / "vendor/b.php").write_text("<?php @eval($_POST['x']);")
    files = webshell.read_files(spark, str(tmp_path))
    scanned = webshell.scan(files)
    row = scanned.collect()
    assert [r.path.rsplit("/", 1)[-1] for r in row] == ["a.php"]
    assert [(h.id, h.line_no) for h in row[0].hits] == [("SIG-WS-001", 2)]
    assert (row[0].score, row[0].severity, row[0].fp) == (7, "P0", 0.05)
    assert webshell.scan(files, tiny_bonus=True).first().score == 11
    found = webshell.findings(scanned).first()
    assert (found.id, found.rule_id, found.iocs[0].confidence) == ("WS-001", "SIG-WS-001", "high")
    empty = spark.createDataFrame([("/x.php", 0, None)], "path string, size long, text string")
    assert webshell.scan(empty).count() == 0


def sources(spark, path, text):
    return spark.createDataFrame([(path, text)], "path string, value string")


def test_sigma(spark):
    rule = """
title: Cert tool
logsource: {category: process_creation, product: windows}
level: critical
tags: [attack.t1105]
detection:
  selection:
    CommandLine|contains: [urlcache, decode]
    Image|endswith: certutil.exe
    Unknown: x
  condition: selection and not filter_main
---
title: low
level: low
logsource: {category: process_creation}
detection: {selection: {Image: x}, condition: selection}
"""
    got = rc.from_sigma(sources(spark, "a.yml", rule)).collect()
    assert [(r.event_id, r.field, r.severity) for r in got] == [(1, "CommandLine", "high"), (1, "Image", "high")]
    assert got[0].pattern == "(?:urlcache|decode)" and got[1].pattern == r"certutil\.exe$"
    assert rc.from_sigma(sources(spark, "a.yml", rule), strict=True).count() == 0
    assert rc.from_sigma(sources(spark, "a.yml", ": : bad")).count() == 0
    assert rc.value_pattern(["a", "b"], "contains|all") == "(?=.*a)(?=.*b)"
    assert rc.value_pattern("a.b", "") == r"^a\.b$" and rc.value_pattern("(", "re") is None and rc.value_pattern(5, "") is None


@pytest.mark.parametrize(
    ("text", "plain"),
    [("selection", True), ("selection and not filter_a", True), ("selection  and not filter_a filter_b", True), ("selection and not 1 of filter_b", True), ("selection and not filter_a 1 of filter_b", True),
     ("selection and not", False), ("selection and not 1 of filter_*", False), ("selection or x", False), ("selection and filter_a", False), ("1 of selection", False), ("selection and not filter_", False), ("selections", False)],
)
def test_plain_conditions(text, plain):
    assert rc.plain_condition(text) is plain


def test_event_categories(spark):
    rule = lambda c: f"title: t\nlogsource: {{category: {c}}}\nlevel: high\nfalsepositives: [one, two, three]\ndetection: {{selection: {{Image: x}}, condition: selection}}\n"
    got = {c: [tuple(r) for r in rc.from_sigma(sources(spark, "a.yml", rule(c))).select("event_id", "severity", "false_positive").collect()] for c in ("registry_add", "registry_set", "dns_query")}
    assert got == {"registry_add": [(12, "medium", "one, two")], "registry_set": [(13, "medium", "one, two")], "dns_query": []}
    assert [r.event_id for r in rc.from_sigma(sources(spark, "a.yml", rule("dns_query")), events={"dns_query": 22}).collect()] == [22]


def test_suricata(spark):
    text = "\n".join(
        [
            '# alert http any any -> any any (msg:"off"; http.uri; content:"/x.php"; sid:1;)',
            'alert http any any -> any any (msg:"uri"; http.uri; content:"/x.php"; sid:2;)',
            'alert http any any -> any any (msg:"re"; pcre:"/ab+c/i"; sid:3;)',
            'alert http any any -> any any (msg:"hex"; content:"|00 01|abc"; sid:4;)',
            'alert http any any -> any any (msg:"plain"; content:"marker"; sid:5;)',
            'alert tcp any any -> any any (msg:"tcp"; content:"marker"; sid:6;)',
        ]
    )
    got = rc.from_suricata(sources(spark, "/r/emerging-coinminer.rules", text)).collect()
    assert [(r.field, r.pattern, r.category) for r in got] == [("uri", r"/x\.php", "c2"), ("request_line_excerpt", "(?i)ab+c", "c2"), ("request_line_excerpt", "marker", "c2")]
    assert {(r.tool, r.severity) for r in got} == {("et-open-coinminer", "high")}
    for left_out in ("emerging-malware.rules", "emerging-web_specific_apps.rules", "other.rules"):
        assert rc.from_suricata(sources(spark, f"/r/{left_out}", text)).count() == 0
    own = rc.from_suricata(sources(spark, "/r/own.rules", text), {"own.rules": "webshell"}).collect()
    assert {(r.category, r.tool, r.severity) for r in own} == {("webshell", "et-open-own", "medium")}


def test_options_of_network_rules():
    options = lambda body: rc.net_rule(f"alert http any any -> any any ({body})")[1]
    assert options('msg:"a; b"; nocase; content:"x\\;y"; sid:7;') == [("msg", '"a; b"'), ("nocase", ""), ("content", '"x\\;y"'), ("sid", "7")]
    features = lambda body: rc.network_features(options(body))
    assert features('http.method; content:"POST"; http.uri; content:"/x.php"; nocase; http.user_agent; content:"evil\\;x";') == [("uri", r"/x\.php"), ("ua", "evil;x")]
    assert features('content:"/old"; http_uri; content:"User-Agent: bad"; http_header;') == [("uri", "/old"), ("ua", "bad")]
    assert features('http.uri; content:!"/not"; pcre:"/a(?:;|b)c/i";') == [("request_line_excerpt", "(?i)a(?:;|b)c")]
    assert rc.net_rule("# alert http (x)") is None and rc.net_rule("") is None


def test_words_of_directives_and_content_rules():
    text = "# a \"comment\nSecRule ARGS \"@rx a\\\"b\" \\\n  'id:1'\n\nInclude x\n"
    assert list(rc.directives(text)) == [["SecRule", "ARGS", '@rx a"b', "id:1"], ["Include", "x"]]
    (rule,) = rc.content_rules('private rule c : tag { // rule z\n meta: author = "rule q" strings: $a = /x\\/y+/i wide /* $b = "n" */ condition: $a }')
    assert rule == {"meta": [["author", '"rule q"']], "strings": [["$a", "/x\\/y+/i", "wide"]]}


def test_crs_and_yara(spark):
    conf = 'SecRule ARGS "@rx union\\s+\\"x\\" \\\n   select" \\\n "id:1"\nSecRule ARGS "@rx ab" "id:2"\nSecRule ARGS "@rx (bad" "id:3"'
    got = rc.from_crs(sources(spark, "/c/REQUEST-942-APPLICATION-ATTACK-SQLI.conf", conf)).collect()
    assert [(r.pattern, r.category, r.field) for r in got] == [('union\\s+"x"  select', "sqli", "request_line_excerpt")]
    kinds = {n: rc.from_crs(sources(spark, f"/c/{n}", conf)).select("category", "severity", "tool").distinct().collect() for n in [*rc.CRS_FILES, "REQUEST-913-SCANNER-DETECTION.conf", "REQUEST-944-APPLICATION-ATTACK-JAVA.conf"]}
    assert [tuple(x[0]) if x else None for x in kinds.values()] == [
        ("lfi", "high", "owasp-crs-930"), ("rfi", "high", "owasp-crs-931"), ("rce", "high", "owasp-crs-932"), ("rce", "high", "owasp-crs-933"), ("xss", "medium", "owasp-crs-941"), ("sqli", "high", "owasp-crs-942"), None, None,
    ]
    yar = 'rule a { meta: description = "PHP webshell" strings: $a = /eval\\(/ nocase\n $b = "text" condition: any of them }\nrule b { meta: author = "x" strings: $a = /y+/ condition: $a }'
    got = rc.from_yara(sources(spark, "x.yar", yar)).collect()
    assert [(r.pattern, r.description) for r in got] == [("(?i)eval\\(", "PHP webshell")]


def test_rule_merge(spark):
    known = spark.createDataFrame([("K-1", "a")], "id string, pattern string")
    new = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "pattern string")
    assert sorted(tuple(r) for r in rc.merged(new, known, prefix="N").collect()) == [("K-1", "a"), ("N-001", "b"), ("N-002", "c")]


def test_grades(spark):
    df = spark.createDataFrame([(9, 0, 0), (9, 4, 4), (6, 1, 0), (4, 1, 0), (4, 0, 0)], "b int, u int, p int")
    assert [r[0] for r in df.select(grading.graded(F.col("b"), F.col("u"), F.col("p"))).collect()] == ["P0", "P3", "P1", "P2", "P3"]


def test_followed_by(spark):
    left = spark.createDataFrame([("a", 10, 1), ("a", 200, 2), ("b", 10, 3)], "k string, us long, line_no long")
    right = spark.createDataFrame([("a", 10, 7), ("a", 11, 8), ("a", 110, 9), ("b", 111, 10)], "k string, us long, line_no long")
    got = playbooks.followed_by(left, right, ["k"], 100, "line_no").collect()
    assert [(r.line_no, r.next) for r in got] == [(1, 8)]


def test_call_verdicts(spark):
    calls = [("T", "o@h", "a", "ok", False), ("", "o@h", "a", "ok", False), ("T", "o@h", "m", "ok", False), ("T", "o@h", "m", "ok", True), ("T", "o@h", "z", "ok", True), ("T", "o@h", "a", "x;y", False), ("T", "bad", "a", "ok", False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(calls)], "i int, authorized_by string, target string, cmd_id string, arg string, allow_mutating boolean")
    table = spark.createDataFrame([("a", 1, "^[a-z]+$"), ("m", 3, None)], "cmd_id string, tier int, pattern string")
    assert [r.verdict for r in recipes.call_verdict(df, table).orderBy("i").collect()] == [0, 2, 3, 0, 3, 2, 2]


def test_reports(spark):
    found = spark.createDataFrame([("F-1", "P0", "r", "a", "1.1.1.1"), ("F-2", "P2", "r", "b", "1.1.1.1")], "id string, severity string, rule_id string, category string, src_ip string")
    assert tuple(report.severity_summary(found).first()) == (1, 0, 1, 0, 2)
    body = json.loads(report.document(found, 1).first().report)
    assert body["total"] == 2 and body["p2"] == 1 and [f["id"] for f in body["findings"]] == ["F-1"]
    check = report.completeness(found).first()
    assert (check.findings, check.without_key_fields, check.one_source) == (2, 0, True)
    assert report.completeness(found.where("false")).first().findings == 0
    nodes = spark.createDataFrame([("p", 1, "F-1"), ("p", 2, "F-9")], "path string, at long, finding_ref string")
    assert [r.finding_ref for r in report.dangling(nodes, found).collect()] == ["F-9"]
    assert tuple(report.paths_in_order(spark.createDataFrame([("p", 1, 5), ("p", 2, 3), ("p", 3, 4)], "p string, n long, t long"), "p", "n", "t").first()) == ("p", 3, 1)


def test_audit_schema(spark):
    row = spark.createDataFrame([(None, 3)], "tier int, cmd_tier int").select(recipes.tier().alias("t")).first()
    assert row.t == 3 and "cmd_tier int" in schemas.AUDIT
