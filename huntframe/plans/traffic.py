"""Queries on packet views, rendered from events, pages and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe import schemas
from huntframe.operators.findings import hits
from huntframe.operators.windows import DAY
from huntframe.plans.base import Rendered, any_of, matches, q, query, queue_sql, table
from huntframe.rules import traffic as rules

WINDOW = DAY
_RAW_KINDS = dict(f.split(" ") for f in schemas.RAW.split(", "))
_ENVELOPE = ("ts", "view", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "stream_id", "src_file", "line_no", "us")


def flows(df: DataFrame, view: str) -> DataFrame:
    """Rendered columns as FLOWREC: those that are fields of a view go into ``raw`` (named r_... where they clash)."""
    have = {c.removeprefix("r_"): c for c in df.columns if c.removeprefix("r_") in _RAW_KINDS and c not in _ENVELOPE}
    raw = F.struct(*[(F.col(have[n]) if n in have else F.lit(None)).cast(k).alias(n) for n, k in _RAW_KINDS.items()])
    base = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in _ENVELOPE}
    base |= {"view": F.lit(view), "dst_port": base["dst_port"].cast("int"), "src_port": base["src_port"].cast("int")}
    base["ts"] = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if dict(df.dtypes).get("ts", "").startswith("timestamp") else base["ts"].cast("string")
    return df.select(*[c.alias(n) for n, c in base.items()], raw.alias("raw"))


_SOURCE = {"us": "{us}", "line_no": "event_id", "src_file": "'events'", "src_ip": "concat('10.0.', user_id % 30, '.5')", "dst_ip": "CASE event_id % 3 WHEN 0 THEN '192.168.7.7' ELSE '8.8.4.4' END"}
#: Tool marks by remainder; the others carry nothing.
_MARKS = {
    0: "POST /x Pass: QWxhZGRpbjpvcGVuc2VzYW1l", 1: "GET / Cookie: id=QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaA==", 2: "antSword/v2.1", 3: "GET /linx-agent", 4: "GET /msf/download",
    5: "GET /webalizer/webalizer.current", 6: "GET /goby-webapp", 7: "X-Xray-Reproduce-Id: 1", 8: "X-Nuclei-Id: 2", 9: "X-Yakit-Id", 10: "GET /suo5", 11: "X-CMD: CONNECT",
    12: "POST /login HTTP/1.1 Content-Length: 42", 13: "GET /shell.php", 14: "() { :; }; /bin/bash",
}
HTTP = Rendered(
    "events",
    _SOURCE
    | {
        "host": "concat('h', event_id % 5, '.example.com')",
        "method": "CASE event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END",
        "uri": """concat('/', event_type, CASE event_id % 11 WHEN 0 THEN '/.git/config' WHEN 1 THEN '?q=union select 1' WHEN 2 THEN concat('?x=', chr(36), '{jndi:x}') WHEN 3 THEN '/user/login'
            WHEN 4 THEN '?q=<script>' ELSE '' END)""",
        "ua": "CASE user_id % 5 WHEN 0 THEN 'sqlmap/1.7' WHEN 1 THEN 'WhatWeb/0.5' ELSE 'Mozilla/5.0' END",
        "request_line_excerpt": "CASE event_id % 40 " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in _MARKS.items()) + " ELSE 'GET /' END",
        "content_length": "CAST(event_id % 300 AS INT)",
        "dst_port": "CAST(event_id % 61 AS INT)",
    },
)
TLS = Rendered(
    "events",
    _SOURCE
    | {
        "sni": "CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '10.1.2.3' WHEN 2 THEN 'db.corp' WHEN 3 THEN concat('s', event_id % 90, '.example.com') WHEN 4 THEN 'viper.example' ELSE 'cdn.example.com' END",
        "host": "CASE event_id % 4 WHEN 0 THEN 'other.example.com' ELSE 'cdn.example.com' END",
        "cert_cn": "CASE event_id % 7 WHEN 0 THEN 'Major Cobalt Strike' WHEN 1 THEN 'Sliver' ELSE 'cdn.example.com' END",
        "cert_issuer": "CASE event_id % 14 WHEN 0 THEN 'major cobalt strike' ELSE 'CA' END",
        "ja3": "CASE event_id % 9 WHEN 0 THEN '72a589da586844d7f0818ce684948eea' WHEN 1 THEN '3fed133de60c35724739b913924b6c24' WHEN 2 THEN '' ELSE 'ffffffffffffffffffffffffffffffff' END",
        "ja3s": "CASE event_id % 8 WHEN 0 THEN 'ec74a5c51106f0419184d0dd08fb05bc' ELSE '' END",
        "cipher": "CASE event_id % 5 WHEN 0 THEN 'ECDHE-SM2-SM4' WHEN 1 THEN '0x1301,0x1302' WHEN 2 THEN '' ELSE '0x1301' END",
        "alpn": "CASE event_id % 3 WHEN 0 THEN 'h2' ELSE '' END",
        "http_version": "CASE event_id % 2 WHEN 0 THEN '1.1' ELSE '2' END",
        "tls_extensions": "CASE event_id % 5 WHEN 0 THEN '0000,000a' WHEN 1 THEN '0a0a,0000,0010,0017' WHEN 2 THEN '0000,0010,0017,ech' ELSE '' END",
        "cert_not_before": "'2026-01-01T00:00:00'",
        "cert_not_after": "CASE event_id % 2 WHEN 0 THEN '2026-01-01T12:00:00' ELSE '2027-01-01T00:00:00' END",
        "session_id_empty": "event_id % 10 = 0",
        "session_ticket_empty": "event_id % 20 = 0",
        "alert_level": "CASE event_type WHEN 'error' THEN 'fatal' ELSE '' END",
        "ua_hint": "CASE event_id % 12 WHEN 0 THEN 'Chrome/120' ELSE '' END",
        "dst_port": "443",
    },
)
DNS = Rendered(
    "events",
    _SOURCE
    | {
        "qname": """concat(CASE event_id % 12 WHEN 0 THEN concat('abcdef1234567890abcdef1234567890', event_id) WHEN 1 THEN 'qwxzcvbnmkjhgfdt' WHEN 2 THEN 'api.deadbeef01' WHEN 3 THEN concat('k', event_id % 400)
            WHEN 4 THEN concat(repeat('x', 70), event_id % 3) WHEN 5 THEN 'a1b2c3d4e5f6g7h8i9j0klmnop' ELSE 'www' END, '.t', user_id % 3, '.example.com')""",
        "qtype": "CASE event_type WHEN 'click' THEN 'TXT' WHEN 'view' THEN CASE event_id % 9 WHEN 0 THEN '10' ELSE '16' END ELSE 'A' END",
        "rcode": "CASE event_type WHEN 'error' THEN 3 ELSE 0 END",
        "payload_len": "event_id % 900",
        "answer_len": "event_id % 700",
        "ttl": "CASE event_id % 50 WHEN 0 THEN 0 WHEN 1 THEN 700000 ELSE 300 END",
        "sni": "CASE event_id % 15 WHEN 0 THEN 'doh.evil.example' WHEN 1 THEN 'dns.google' ELSE '' END",
        "dst_port": "CASE event_id % 2 WHEN 0 THEN 443 ELSE 53 END",
    },
)
FLOW = Rendered(
    "lineitem",
    {
        "line_no": "l_orderkey * 8 + l_linenumber",
        "src_file": "'lineitem'",
        "us": "l_orderkey * 8000000 + l_linenumber * 1000000",
        "ts": "CAST(l_shipdate AS VARCHAR(20))",
        "src_ip": "concat('10.1.', l_suppkey % 200, '.5')",
        "dst_ip": "concat('10.2.', l_partkey % 50, '.', l_partkey % 7)",
        "dst_port": "CAST(CASE l_partkey % 13 WHEN 0 THEN 4444 WHEN 1 THEN 445 WHEN 2 THEN 3389 WHEN 3 THEN 7000 WHEN 4 THEN 8024 WHEN 5 THEN 50050 ELSE 1000 + l_partkey % 97 END AS INT)",
        "duration_s": "CAST(l_quantity * 60 AS DOUBLE)",
        "packets_total": "CAST(floor(l_quantity * 5) AS BIGINT)",
        "bytes_total": "CAST(floor(l_extendedprice * CASE WHEN l_linenumber = 1 THEN 0.1 ELSE 1.0 END) AS BIGINT)",
        "bytes_a2b": "CAST(floor(l_extendedprice * 1000) AS BIGINT)",
    },
)


def _markers(view: str, columns: str) -> dict[str, str]:
    out = {}
    for rule, _, pattern in rules.MARKERS:
        extra = " OR contains(lower(sni), 'viper')" if rule == "R-TRAF-089" and view == "tls" else ""
        if rule != "R-TRAF-087" or view == "http":
            out[rule] = f"{matches(columns, pattern)}{extra}"
    return out


def _signature(view: str, fields: dict[str, str]) -> list[tuple[str, str]]:
    out = []
    for _, category, its_view, field, pattern, tool, _ in rules.SIGNATURES:
        if its_view == view and field in fields:
            out.append((rules.signature_rule(view, category, tool), f"{fields[field]} <> '' AND {matches(fields[field], pattern)}"))
    return out


def _union(name: str, conditions: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT line_no, {q(r)} AS rule_id FROM {name} WHERE {c}" for r, c in conditions)


_TEXT = "concat_ws(' ', uri, ua, request_line_excerpt, host)"
_HTTP = [
    ("R-TRAF-001", matches("ua", rules.SCANNER_AGENT)),
    ("R-TRAF-002", matches("uri", rules.SENSITIVE_PATH)),
    ("R-TRAF-003", matches("uri", rules.SQL_INJECTION)),
    ("R-TRAF-004", matches("concat(uri, ' ', request_line_excerpt)", rules.CODE_EXECUTION)),
    ("R-TRAF-012", matches("request_line_excerpt", rules.WEBSHELL_KEY)),
    *_markers("http", _TEXT).items(),
    *_signature("http", {"ua": "ua", "uri": "uri", "host": "host", "request_line_excerpt": "request_line_excerpt"}),
]


def _found(spark, sf, rendered: Rendered, view: str, branches) -> DataFrame:
    return hits(flows(rendered.spark(spark, sf), view), branches).select("line_no", "rule_id")


@query("traf_http_rules", f"WITH {HTTP.sql('h')} {_union('h', _HTTP)}")
def traf_http_rules(spark, sf):
    return _found(spark, sf, HTTP, "http", rules.http_branches())


_PAGES = {r: p for r, _, p in rules.MARKERS}


#: What each tool leaves, put behind some of the pages.
_LEFT = (
    "rebeyond", "3c6e0b8a9c15224a", "antSword/v2", "GET /linx-agent", "Viper-Sn: 1", "GET /webalizer/webalizer.current", "X-Goby-Id: 1", "X-Xray-Reproduce-Id: 1", "GET /nuclei-1", "GET /yakit-web", "Suo5-1",
    "GET /tunnel.jsp", "User-Agent: hydra", "pass=assert", "User-Agent: Linx 2 linx-3", "X-CMD: FORWARD", "POST /login Content-Length: 42",
)
_TRACE = "CASE page_id % 23 " + " ".join(f"WHEN {i} THEN {q(s)}" for i, s in enumerate(_LEFT)) + " ELSE '' END"
_PAGE_TEXT = f"concat_ws(' ', url, html, {_TRACE})"


@query("tool_markers", " UNION ALL ".join(f"SELECT page_id, {q(r)} AS rule_id FROM pages WHERE {matches(_PAGE_TEXT, p)}" for r, p in _PAGES.items()))
def tool_markers(spark, sf):
    from huntframe.operators.playbooks import patterns_hit

    pages = table(spark, sf, "pages")
    text = F.expr(_PAGE_TEXT)
    return patterns_hit(pages, {"text": text}, [(r, "text", f"(?d){p}") for r, p in _PAGES.items()]).select("page_id", "rule_id")


_NUMERIC = "regexp_matches({0}, '^[0-9a-fA-F:.]+$')"
_SOME = "(ja3 <> '' OR cipher <> '')"
_CLIENT = "CASE ja3 " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in rules.CLIENT_FINGERPRINTS) + " END"
_TLS = [
    *_signature("tls", {"sni": "sni", "cert_cn": "cert_cn", "cert_issuer": "cert_issuer"}),
    ("R-TRAF-050", f"starts_with({_CLIENT}, 'cobalt')"),
    ("R-TRAF-051", f"NOT starts_with({_CLIENT}, 'cobalt')"),
    ("R-TRAF-052", f"ja3s IN {any_of(*[k for k, _ in rules.SERVER_FINGERPRINTS])}"),
    ("R-TRAF-053", "contains(sni, '.') AND contains(host, '.') AND lower(sni) <> lower(host)"),
    ("R-TRAF-054", matches("cert_cn", rules.DEFAULT_CERTIFICATE)),
    ("R-TRAF-055", f"(sni = '' OR {_NUMERIC.format('sni')}) AND ({_SOME} OR cert_cn <> '')"),
    ("R-TRAF-056", matches("cipher", rules.NATIONAL_CIPHER)),
    ("R-TRAF-057", "event_id % 2 = 0 AND cert_cn <> '' AND lower(cert_issuer) = lower(cert_cn)"),
    ("R-TRAF-058", "alpn = 'h2' AND http_version = '1.1'"),
    ("R-TRAF-059", f"{matches('sni', rules.PRIVATE_SUFFIX)} AND NOT {matches('dst_ip', rules.PRIVATE_PREFIX)}"),
    ("R-TRAF-060", "tls_extensions <> '' AND ja3 <> '' AND NOT contains(tls_extensions, '0a0a')"),
    ("R-TRAF-061", "contains(tls_extensions, 'ech')"),
    ("R-TRAF-062", "tls_extensions = '0000,000a'"),
    ("R-TRAF-063", f"{_NUMERIC.format('sni')} AND contains(sni, '.')"),
    ("R-TRAF-064", "NOT contains(cipher, ',') AND length(cipher) > 4"),
    ("R-TRAF-065", "session_id_empty AND session_ticket_empty"),
    ("R-TRAF-068", "ua_hint <> '' AND alpn = ''"),
    ("R-TRAF-069", f"sni = '' AND alpn = '' AND {_SOME}"),
    *_markers("tls", "concat_ws(' ', '', '', '', host)").items(),
]


@query("traf_tls_rules", f"WITH {TLS.sql('t')} {_union('t', _TLS)}")
def traf_tls_rules(spark, sf):
    return _found(spark, sf, TLS, "tls", rules.tls_branches())


@query("ja3_lookup", f"WITH {TLS.sql('t')} SELECT line_no, {_CLIENT} AS tool FROM t WHERE {_CLIENT} IS NOT NULL")
def ja3_lookup(spark, sf):
    rows = flows(TLS.spark(spark, sf), "tls").withColumn("tool", rules._lookup(rules.CLIENT_FINGERPRINTS, rules.raw("ja3")))
    return rows.where("tool IS NOT NULL").select("line_no", "tool")


_KIND = "CASE qtype WHEN '16' THEN 'TXT' WHEN '10' THEN 'NULL' ELSE qtype END"
_LABEL = "split_part(qname, '.', 1)"
_KEPT = "length(regexp_replace({0}, '[^{1}]', '', 'g'))"
#: Entropy by counting the characters of the distinct names.
_ENTROPY = f"""e AS (SELECT qname, -sum(n / t * log2(n / t)) AS bits FROM (SELECT qname, c, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY qname)::DOUBLE AS t
  FROM (SELECT qname, unnest(string_split({_LABEL}, '')) AS c FROM (SELECT DISTINCT qname FROM d)) GROUP BY qname, c) GROUP BY qname)"""
_RUN = f"list_max([length(x) FOR x IN regexp_split_to_array(lower({_LABEL}), '[aeiou0-9]')])"
_DNS = [
    *_signature("dns", {"qname": "qname"}),
    ("R-TRAF-071", f"length({_LABEL}) >= 16 AND (SELECT bits FROM e WHERE e.qname = d.qname) > 4.0"),
    ("R-TRAF-075", f"payload_len > 400 AND {_KIND} = 'A'"),
    ("R-TRAF-076", f"length({_LABEL}) >= 20 AND greatest({_KEPT.format(_LABEL, 'A-Za-z2-7')}, {_KEPT.format(_LABEL, 'A-Za-z0-9_-')}) >= 0.85 * length({_LABEL})"),
    ("R-TRAF-078", matches("qname", rules.BEACON_NAME)),
    ("R-TRAF-079", f"dst_port IN (443, 853) AND sni NOT IN {any_of(*rules.RESOLVERS)} AND regexp_matches(lower(sni), 'doh|dns-over|dnstls|dot')"),
    ("R-TRAF-080", f"length({_LABEL}) >= 12 AND {_RUN} >= 7"),
    ("R-TRAF-082", "answer_len > length(qname) * 4 AND answer_len > 200"),
    ("R-TRAF-083", "ttl = 0 OR ttl > 604800"),
]


@query("traf_dns_rules", f"WITH {DNS.sql('d')}, {_ENTROPY} {_union('d', _DNS)}")
def traf_dns_rules(spark, sf):
    return _found(spark, sf, DNS, "dns", rules.dns_branches())


_MEAN = "bytes_total / greatest(packets_total, 1)::DOUBLE"
_FLOW = [
    ("R-TRAF-008", f"dst_port IN ({', '.join(map(str, rules.LISTENER_PORTS))}) AND duration_s > 300"),
    ("R-TRAF-010", f"bytes_a2b > {50 * rules.MB} AND duration_s > 60"),
    ("R-TRAF-011", f"packets_total > 100 AND duration_s > 1800 AND {_MEAN} < 200"),
    ("R-TRAF-101", "dst_port IN (445, 139)"),
    ("R-TRAF-201", "dst_port IN (7000, 7500, 7001)"),
    ("R-TRAF-202", "dst_port IN (8024, 8082)"),
    ("R-TRAF-008", "dst_port = 50050"),
    ("R-TRAF-098", "packets_total >= 30 AND duration_s > 600 AND bytes_total < 20480"),
]


@query("traf_flow_rules", f"WITH {FLOW.sql('f')} SELECT line_no, rule_id FROM ({_union('f', _FLOW)})")
def traf_flow_rules(spark, sf):
    return _found(spark, sf, FLOW, "flow", rules.flow_branches())


def _dns(spark, sf):
    return flows(DNS.spark(spark, sf), "dns")


_D = DNS.sql("d")


@query(
    "dns_generated_names",
    f"""WITH {_D}, c AS (SELECT *, {queue_sql('src_ip', WINDOW)} AS n, {_LABEL} AS label, length(regexp_replace({_LABEL}, '[^0-9]', '', 'g')) AS digits FROM d)
    SELECT line_no, n FROM c WHERE length(qname) > 30 AND n > 5 AND digits::DOUBLE / greatest(length(regexp_replace(label, '[^a-zA-Z0-9]', '', 'g')), 1) > 0.25
    AND length(label) >= 7""",
)
def dns_generated_names(spark, sf):
    return rules.generated_names(_dns(spark, sf), WINDOW, 5).select("line_no", "n")


@query(
    "dns_tunnel_names",
    f"""WITH {_D}, t AS (SELECT line_no, qname, {queue_sql('src_ip', WINDOW)} AS n FROM d WHERE {_KIND} = 'TXT')
    SELECT line_no, CAST(NULL AS BIGINT) AS n FROM d WHERE length(qname) > 60 UNION ALL SELECT line_no, n FROM t WHERE length(qname) <= 60 AND n > 3""",
)
def dns_tunnel_names(spark, sf):
    return rules.tunnel_names(_dns(spark, sf), WINDOW, 3).select("line_no", "n")


@query(
    "dns_avg_len",
    f"""WITH {_D}, c AS (SELECT a.src_ip, a.us, a.line_no, count(*) AS n, sum(length(b.qname)) AS chars FROM d a JOIN d b ON a.src_ip = b.src_ip AND b.us BETWEEN a.us - {WINDOW} AND a.us AND b.line_no <= a.line_no
      GROUP BY a.src_ip, a.us, a.line_no)
    SELECT src_ip, line_no, n, CAST(chars AS BIGINT) AS chars FROM c WHERE n >= 5 AND chars > 40 * n QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY us, line_no) = 1""",
)
def dns_avg_len(spark, sf):
    return rules.long_names(_dns(spark, sf), WINDOW, 5).select("src_ip", "line_no", "n", "chars")


@query(
    "dns_parent_explosion",
    f"""WITH {_D}, f AS (SELECT 'example.com' AS parent, {_LABEL} AS label, min(line_no) AS line_no FROM d GROUP BY label)
    SELECT parent, line_no FROM f QUALIFY row_number() OVER (ORDER BY line_no) = 101""",
)
def dns_parent_explosion(spark, sf):
    return rules.many_subdomains(_dns(spark, sf)).select("parent", "line_no")


def _share_sql(kind: str, over: float) -> str:
    return f"""WITH {_D}, c AS (SELECT src_ip, us, line_no, count(*) OVER w AS n, CAST(sum(CASE WHEN {_KIND} = {q(kind)} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS kinds FROM d
      WINDOW w AS (PARTITION BY src_ip ORDER BY us, line_no ROWS UNBOUNDED PRECEDING))
    SELECT src_ip, line_no, n, kinds FROM c WHERE n >= 30 AND kinds > {over} * n QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY us, line_no) = 1"""


@query("dns_txt_ratio", _share_sql("TXT", 0.3))
def dns_txt_ratio(spark, sf):
    return rules.type_share(_dns(spark, sf), "TXT", 0.3).select("src_ip", "line_no", "n", "kinds")


@query("dns_null_ratio", _share_sql("NULL", 0.04))
def dns_null_ratio(spark, sf):
    return rules.type_share(_dns(spark, sf), "NULL", 0.04).select("src_ip", "line_no", "n", "kinds")


@query(
    "dns_nxdomain",
    f"""WITH {_D} SELECT src_ip, line_no, n FROM (SELECT *, {queue_sql('src_ip', WINDOW)} AS n FROM d WHERE rcode = 3) WHERE n >= 6
    QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY us, line_no) = 1""",
)
def dns_nxdomain(spark, sf):
    return rules.missing_names(_dns(spark, sf), WINDOW, 5).select("src_ip", "line_no", "n")


@query("dns_repeat_qname", f"WITH {_D} SELECT src_ip, qname, line_no FROM d QUALIFY row_number() OVER (PARTITION BY src_ip, qname ORDER BY us, line_no) = 31")
def dns_repeat_qname(spark, sf):
    return rules.repeated_names(_dns(spark, sf)).select("src_ip", "qname", "line_no")


@query(
    "beacon_cv",
    f"""WITH {_D}, g AS (SELECT *, (us - lag(us) OVER (PARTITION BY src_ip ORDER BY us, line_no)) / 1e6 AS delta FROM d),
    c AS (SELECT *, count(delta) OVER w AS k, avg(delta) OVER w AS mean_s, stddev_pop(delta) OVER w / avg(delta) OVER w AS cv FROM g
      WINDOW w AS (PARTITION BY src_ip ORDER BY us, line_no ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT src_ip, line_no, round(mean_s, 3) AS mean_s, round(cv, 6) AS cv FROM c WHERE k >= 15 AND cv < 0.7 AND mean_s > 5 QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY us, line_no) = 1""",
)
def beacon_cv(spark, sf):
    found = rules.beacons(_dns(spark, sf), ["src_ip"], cv_under=0.7)
    return found.select("src_ip", "line_no", F.round("mean_s", 3).alias("mean_s"), F.round("cv", 6).alias("cv"))


def _distinct_sql(source: str, key: str, value: str, more_than: int, where: str = "true") -> str:
    return f"""WITH {source}, f AS (SELECT {key} AS k, {value} AS v, min(line_no) AS line_no FROM x WHERE {where} GROUP BY k, v)
    SELECT k, line_no FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY line_no) = {more_than + 1}"""


@query("sni_flood", _distinct_sql(TLS.sql("x"), "src_ip", "sni", 12, "sni <> ''"))
def sni_flood(spark, sf):
    return rules.many_server_names(flows(TLS.spark(spark, sf), "tls"), 12).select(F.col("src").alias("k"), "line_no")


@query("running_distinct_ports", _distinct_sql(HTTP.sql("x"), "src_ip", "dst_port", 25, f"dst_port <> 0 AND NOT {matches(_TEXT, _PAGES['R-TRAF-090'])}"))
def running_distinct_ports(spark, sf):
    return rules.many_ports(flows(HTTP.spark(spark, sf), "http")).select(F.col("src").alias("k"), "line_no")


@query("rdp_fanin", _distinct_sql(FLOW.sql("x"), "dst_ip", "src_ip", 4, "dst_port = 3389"))
def rdp_fanin(spark, sf):
    return rules.desktop_fan_in(flows(FLOW.spark(spark, sf), "flow")).select(F.col("dst_ip").alias("k"), "line_no")


@query("traf_fatal_alerts", f"WITH {TLS.sql('t')} SELECT line_no, nth FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY us, line_no) AS nth FROM t WHERE alert_level = 'fatal') WHERE nth > 20")
def traf_fatal_alerts(spark, sf):
    return rules.fatal_alerts(flows(TLS.spark(spark, sf), "tls")).select("line_no", "nth")


@query(
    "traf_login_posts",
    f"""WITH {HTTP.sql('h')} SELECT src_ip, line_no FROM h WHERE method = 'POST' AND contains(uri, 'login') AND content_length BETWEEN 1 AND 199 AND NOT {matches(_TEXT, _PAGES['R-TRAF-097'])}
    QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY us, line_no) = 4""",
)
def traf_login_posts(spark, sf):
    return rules.many_logins(flows(HTTP.spark(spark, sf), "http"), 3).select("src_ip", "line_no")


def _all(spark, sf):
    """HTTP, TLS and DNS records of the same events, as three files."""
    out = None
    for view, rendered in (("http", HTTP), ("tls", TLS), ("dns", DNS)):
        part = flows(rendered.spark(spark, sf), view).withColumn("src_file", F.lit(view))
        out = part if out is None else out.unionByName(part)
    return out


_RULE_ROWS = f"""WITH {HTTP.sql('h')}, {TLS.sql('t')}, {DNS.sql('d')}, {_ENTROPY},
r AS (SELECT h.src_ip, x.rule_id FROM ({_union('h', _HTTP)}) x JOIN h USING (line_no) UNION SELECT t.src_ip, x.rule_id FROM ({_union('t', _TLS)}) x JOIN t USING (line_no)
  UNION SELECT d.src_ip, x.rule_id FROM ({_union('d', _DNS)}) x JOIN d USING (line_no))"""


@query(
    "correlate_multi_rule",
    f"""{_RULE_ROWS}, s AS (SELECT src_ip, count(DISTINCT rule_id) AS n, bool_or(rule_id BETWEEN 'R-TRAF-050' AND 'R-TRAF-069')::INT AS a, bool_or(rule_id BETWEEN 'R-TRAF-070' AND 'R-TRAF-084')::INT AS b,
      bool_or(rule_id BETWEEN 'R-TRAF-085' AND 'R-TRAF-098')::INT AS c FROM r GROUP BY src_ip)
    SELECT src_ip, n, a + b + c >= 2 AS apt_suspect FROM s WHERE n >= 3""",
)
def correlate_multi_rule(spark, sf):
    parts = None
    for view, rendered, branches in (("http", HTTP, rules.http_branches()), ("tls", TLS, rules.tls_branches()), ("dns", DNS, rules.dns_branches())):
        p = hits(flows(rendered.spark(spark, sf, deal=True), view), branches)
        parts = p if parts is None else parts.unionByName(p)
    return rules.correlated(parts).select("src_ip", F.size("rules").cast("bigint").alias("n"), "apt_suspect")


@query("traf_findings_by_rule")
def traf_findings_by_rule(spark, sf):
    """All rules together, numbered: tested against the sum of the single queries."""
    return rules.findings(_all(spark, sf)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("hits"), F.min("id").alias("first_id"))


