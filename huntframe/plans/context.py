"""Queries on indicators, timelines, masking, labels, vendors' alerts, web shells, rule merges and remote commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntframe.functions import masking
from huntframe.functions import text as T
from huntframe.functions.net import host_of_uri
from huntframe.functions.time import in_window
from huntframe.operators import iocs, recipes, timeline, webshell
from huntframe.plans.base import AUTH, WEB, auth, matches, q, query, table, web
from huntframe.rules import compile as rule_compile
from huntframe.rules.libraries import IOCS, WEBSHELL_PATTERNS
from huntframe.rules.vendors import VENDORS
from huntframe.sources import vendor

_W = WEB.sql("w")

# Indicators -------------------------------------------------------------------------------

#: Addresses that the rendered records have, besides the library's.
ADDRESSES = (
    ("ip", "10.0.0.7", "high", "c2:known"), ("ip", "10.0.3.0/24", "medium", "scanner:net"), ("ip", "10.0.0.0/21", "low", "office"), ("ip", "10.0.77.7", "high", "tool:x"),
    ("ip", "10.0.128.0/20", "medium", "mining:pool"),
)
TOOLS = (
    {"type": "tool", "value": "scanner-kit", "confidence": "high", "tag": "tool:kit", "ua_pattern": "sqlmap|Nuclei", "uri_pattern": "jndi"},
    {"type": "tool", "value": "env-grabber", "confidence": "medium", "tag": "tool:env", "uri_pattern": r"/\.env$"},
)
_MINE = iocs.indicators([*ADDRESSES, *IOCS, *TOOLS])


def _net(ioc: dict) -> str:
    from huntframe.functions.net import bounds

    low, high = bounds(ioc["value"])
    return f"ip BETWEEN {low} AND {high}"


_IP = "list_reduce([x::BIGINT FOR x IN string_split(src_ip, '.')], lambda a, b: a * 256 + b)"
_ADDRESS = "CASE " + " ".join(f"WHEN src_ip = {q(i['value'])} THEN {i['ordinal']}" for i in _MINE if i["type"] == "ip" and "/" not in i["value"])
_ADDRESS += " " + " ".join(f"WHEN {_net(i)} THEN {i['ordinal']}" for i in _MINE if i["type"] == "ip" and "/" in i["value"]) + " END"
_URI = "CASE " + " ".join(f"WHEN {matches('uri', iocs._pattern(i))} THEN {i['ordinal']}" for i in _MINE if i["type"] == "path") + " END"
_UA = "CASE " + " ".join(f"WHEN {matches('ua', i['value'])} THEN {i['ordinal']}" for i in _MINE if i["type"] == "ua") + " END"
_TOOL = [
    f"CASE WHEN {' OR '.join(matches(c, i[p]) for c, p in (('ua', 'ua_pattern'), ('uri', 'uri_pattern')) if i.get(p))} THEN {i['ordinal']} END" for i in _MINE if i["type"] == "tool"
]
_IOC_ROWS = f"""WITH {_W}, a AS (SELECT *, {_IP} AS ip FROM w),
m AS (SELECT line_no, src_ip, uri, ua, ts, unnest([{_ADDRESS}, CASE WHEN uri <> '' THEN {_URI} END, CASE WHEN ua <> '' THEN {_UA} END, {', '.join(_TOOL)}]) AS ordinal FROM a)"""


def _matched(spark, sf):
    return iocs.matched(web(spark, sf).drop("event_id", "user_id", "event_type", "value", "props"), _MINE)


@query("ioc_addresses", f"WITH {_W}, a AS (SELECT *, {_IP} AS ip FROM w) SELECT line_no, CAST({_ADDRESS} AS INTEGER) AS ordinal FROM a WHERE {_ADDRESS} IS NOT NULL")
def ioc_addresses(spark, sf):
    return iocs.match_addresses(web(spark, sf), _MINE).where("ip_ioc IS NOT NULL").select("line_no", F.col("ip_ioc.ordinal").alias("ordinal"))


@query("ioc_ua_path_regex", f"{_IOC_ROWS} SELECT line_no, CAST(ordinal AS INTEGER) AS ordinal FROM m WHERE ordinal IS NOT NULL")
def ioc_ua_path_regex(spark, sf):
    return iocs.hits(_matched(spark, sf)).select("line_no", F.col("ioc.ordinal").alias("ordinal"))


@query(
    "ioc_aggregate",
    f"""{_IOC_ROWS} SELECT CAST(ordinal AS INTEGER) AS ordinal, src_ip, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT substr(uri, 1, 200)) AS n_uris,
    count(DISTINCT nullif(ua, '')) AS n_uas, min(line_no) AS first_line FROM m WHERE ordinal IS NOT NULL GROUP BY ordinal, src_ip""",
)
def ioc_aggregate(spark, sf):
    groups = iocs.by_indicator(iocs.hits(_matched(spark, sf)))
    return groups.select(
        "ordinal", "src_ip", "count", "first_seen", "last_seen", "n_uris", "n_uas",
        F.get("samples", F.lit(0))["line_no"].alias("first_line"),
    )


_LEVEL = {i["ordinal"]: iocs.LEVELS.get(i["confidence"], "P3") for i in _MINE}


@query(
    "ioc_findings",
    f"""{_IOC_ROWS}, i(ordinal, kind, value, severity) AS (VALUES {', '.join(f"({i['ordinal']}, {q(i['type'])}, {q(i['value'])}, {q(_LEVEL[i['ordinal']])})" for i in _MINE)}),
    g AS (SELECT i.kind, i.value, i.severity, src_ip, m.ordinal FROM m JOIN i ON m.ordinal = i.ordinal GROUP BY ALL)
    SELECT format('IOC-{{:03d}}', row_number() OVER (ORDER BY kind, value, src_ip, ordinal)) AS id, 'IOC-' || kind AS rule_id, severity FROM g""",
)
def ioc_findings(spark, sf):
    return iocs.findings(iocs.by_indicator(iocs.hits(_matched(spark, sf)))).select("id", "rule_id", "severity")


#: Hosts of the pages and suffixes of them.
_DOMAINS = iocs.indicators([("domain", "*.example.com", "medium", "suffix"), ("domain", "*.example", "low", "wide"), ("domain", "example.com", "high", "apex"), ("domain", "*.test", "low", "test")])
_HOST = r"lower(regexp_extract(url, '://([^/:]+)', 1))"
_DOMAIN = "CASE " + " ".join(
    f"WHEN {f'ends_with({_HOST}, {q(i["value"][1:])})' if i['value'].startswith('*.') else f'{_HOST} = {q(i["value"])}'} THEN {i['ordinal']}"
    for i in sorted(_DOMAINS, key=lambda i: (i["value"].startswith("*."), i["ordinal"]))
) + " END"


@query("ioc_domain_wild", f"SELECT page_id, CAST({_DOMAIN} AS INTEGER) AS ordinal FROM pages WHERE {_DOMAIN} IS NOT NULL")
def ioc_domain_wild(spark, sf):
    found = iocs.match_domains(table(spark, sf, "pages"), _DOMAINS, host_of_uri(F.col("url")))
    return found.where("domain_ioc IS NOT NULL").select("page_id", F.col("domain_ioc.ordinal").alias("ordinal"))


# Timelines --------------------------------------------------------------------------------

_L = AUTH.sql("l")


@query(
    "timeline_merge",
    f"""WITH {_W}, {_L}, u AS (SELECT ts, 0 AS stream, line_no FROM w UNION ALL SELECT ts, 1, line_no FROM l)
    SELECT ts, CAST(stream AS INTEGER) AS stream, line_no FROM u ORDER BY ts, stream, line_no""",
)
def timeline_merge(spark, sf):
    fields = ["ts", "src_file", "line_no", "src_ip", "user", "msg"]
    return timeline.merged([web(spark, sf).select(*fields), auth(spark, sf).select(*fields)]).select("ts", "stream", "line_no")


@query(
    "timeline_bucket_top5",
    f"""WITH {_W}, s AS (SELECT us // 1000000 // 3600 * 3600 AS slot, src_ip, count(*) AS n FROM w GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY n DESC, src_ip) AS k FROM s)
    SELECT strftime(make_timestamp(slot * 1000000), '%Y-%m-%dT%H:%M:%S') AS bucket, CAST(sum(n) AS BIGINT) AS total, string_agg(src_ip || '=' || n, ',' ORDER BY k) FILTER (k <= 5) AS top FROM r GROUP BY slot""",
)
def timeline_bucket_top5(spark, sf):
    return timeline.bucketed(web(spark, sf), "1h").select("bucket", "total", F.array_join("top_ips", ",").alias("top"))


@query("timeline_filter", f"""WITH {_W} SELECT line_no FROM w WHERE ts >= '2024-01-05' AND ts <= '2024-01-20T12' AND "user" = 'u7' AND contains(src_file, 'event')""")
def timeline_filter(spark, sf):
    return timeline.filtered(web(spark, sf), since="2024-01-05", until="2024-01-20T12", user="u7", file="event").select("line_no")


_ISO = "CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN '' ELSE CAST(ts AS VARCHAR(30)) END"


@query("iso_window_filter", f"SELECT event_id FROM events WHERE coalesce({_ISO}, '') = '' OR ({_ISO} >= '2024-01-10' AND {_ISO} <= '2024-01-20')")
def iso_window_filter(spark, sf):
    rows = table(spark, sf, "events").withColumn("t", F.expr(_ISO))
    return rows.where(in_window(F.col("t"), "2024-01-10", "2024-01-20")).select("event_id")


# Masking ----------------------------------------------------------------------------------

_CUSTOMER, _INTERNAL = "ACME", "*.example.com"
# The mark ends what the document's last words begin: "by" and "user:" name no user across it.
_SOURCE_TEXT = "concat(coalesce(text, ''), ' # Failed password for user', doc_id, ' from 10.0.', doc_id % 250, '.9 port 22, user=alice', doc_id, ' /home/bob', doc_id, '/x aa:bb:cc:dd:ee:0', doc_id % 10, ' mail eve', doc_id, '@h.example.com ACME')"


def _documents(spark, sf):
    """Documents with a rendered log line; what the SQL below can't mask (names of other lengths) isn't in them."""
    return table(spark, sf, "documents").select("doc_id", F.expr(_SOURCE_TEXT).alias("text"))


_STARS = "repeat('*', length(doc_id::VARCHAR) + {0})"


def _known(text: str, keep: bool = False, addresses: bool = True) -> str:
    """The rendered line after masking, which is known by construction."""
    ip = "concat('10.0.', doc_id % 250, '.xxx')" if addresses else "concat('10.0.', doc_id % 250, '.9')"
    home = f"concat('/home/b', {_STARS.format(2)})" if addresses else "concat('/home/bob', doc_id)"
    mac = "'aa:bb:cc:xx:xx:xx'" if addresses else "concat('aa:bb:cc:dd:ee:0', doc_id % 10)"
    return (
        f"concat(' Failed password for u', {_STARS.format(3)}, ' from ', {ip}, ' port 22, user=a', {_STARS.format(4)}, ' ', {home}, '/x ', {mac}, ' mail e***@<internal> <customer>')"
    )


def _masked_sql(addresses: bool, keep: bool) -> str:
    return f"""SELECT doc_id, {_known('text', keep, addresses)} AS line FROM documents"""


def _masked(spark, sf, **options):
    docs = _documents(spark, sf)
    text = masking.masked(F.col("text"), internal=[_INTERNAL], customer=[_CUSTOMER], **options)
    # The rendered line is what follows the document's own text.
    return docs.select("doc_id", F.regexp_extract(text, "(?s).*( Failed password for u.*)$", 1).alias("line"))


@query("desensitize_strict", _masked_sql(True, False))
def desensitize_strict(spark, sf):
    return _masked(spark, sf)


@query("desensitize_keep_public", _masked_sql(True, True))
def desensitize_keep_public(spark, sf):
    return _masked(spark, sf, keep_public=True)


@query("desensitize_relaxed", _masked_sql(False, False))
def desensitize_relaxed(spark, sf):
    return _masked(spark, sf, mode="relaxed")


_QUAD = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


@query(
    "desensitize_addresses",
    rf"""WITH n AS (SELECT doc_id, regexp_replace(text, '\b0*(\d{{1,3}})\.0*(\d{{1,3}})\.0*(\d{{1,3}})\.0*(\d{{1,3}})\b', '\1.\2.\3.\4', 'g') AS t FROM documents),
    p AS (SELECT doc_id, regexp_replace(t, '\b((?:10|127|0)\.\d{{1,3}}\.\d{{1,3}}|192\.168\.\d{{1,3}}|169\.254\.\d{{1,3}}|172\.(?:1[6-9]|2\d|3[01])\.\d{{1,3}})\.\d{{1,3}}\b', '\1.xxx', 'g') AS t FROM n)
    SELECT doc_id, md5(regexp_replace(t, {q(_QUAD)}, '<public-ip>', 'g')) AS digest FROM p""",
)
def desensitize_addresses(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(masking.mask_addresses(F.col("text"))).alias("digest"))


@query("desensitize_emails", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b', '<u>@\1', 'g'), '\b([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b', '\1***@\2', 'g')) AS digest FROM documents""")
def desensitize_emails(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(masking.mask_emails(F.col("text"))).alias("digest"))


# Labels of domain names -------------------------------------------------------------------

_LONGEST = "list_reduce(string_split(h, '.'), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)"
_FIRST = "split_part(h, '.', 1)"
_BITS = f"""e AS (SELECT h, -sum(n / t * log2(n / t)) AS bits FROM (SELECT h, c, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY h)::DOUBLE AS t FROM (SELECT h, unnest(string_split({_FIRST}, '')) AS c FROM (SELECT DISTINCT h FROM p))
  GROUP BY h, c) GROUP BY h)"""


@query(
    "label_measures",
    f"""WITH p AS (SELECT page_id, {_HOST} AS h FROM pages), {_BITS},
    m AS (SELECT *, {_LONGEST} AS longest, {_FIRST} AS label FROM p)
    SELECT page_id, longest, label, array_to_string(string_split(h, '.')[-2:], '.') AS parent, abs(round(bits, 6)) AS bits,
      round(CASE WHEN length(regexp_replace(longest, '[^a-z]', '', 'g')) = 0 THEN 1.0 ELSE length(regexp_replace(longest, '[^0-9]', '', 'g'))::DOUBLE / length(regexp_replace(longest, '[^a-z0-9]', '', 'g')) END, 6) AS digit_ratio,
      round(length(regexp_replace(label, '[^A-Za-z2-7]', '', 'g'))::DOUBLE / length(label), 6) AS base32,
      CAST(list_max([length(x) FOR x IN regexp_split_to_array(label, '[aeiou0-9]')]) AS INTEGER) AS consonants
    FROM m JOIN e USING (h)""",
)
def label_measures(spark, sf):
    rows = table(spark, sf, "pages").withColumn("h", F.lower(host_of_uri(F.col("url"))))
    h, label = F.col("h"), T.first_label(F.col("h"))
    return rows.select(
        "page_id", T.longest_label(h).alias("longest"), label.alias("label"), T.parent_domain(h).alias("parent"), F.round(T.entropy(label), 6).alias("bits"),
        F.round(T.digit_ratio(h), 6).alias("digit_ratio"), F.round(T.base32_ratio(label), 6).alias("base32"), T.consonant_run(label).alias("consonants"),
    )


# Vendors ----------------------------------------------------------------------------------

_ALIAS = {n: (v["fields"]["ts"][0], v["fields"]["src_ip"][-1], v["fields"]["severity"][1], v["fields"]["rule_name"][0]) for n, v in VENDORS.items()}


def _vendor(name: str) -> None:
    config = VENDORS[name]
    ts, ip, level, rule = _ALIAS[name]
    levels, kinds = list(config["severities"].items()), list(config["categories"].items())
    level_sql = "CASE event_id % 7 " + " ".join(f"WHEN {k} THEN {q(levels[k % len(levels)][0])}" for k in range(6)) + " ELSE 'unheard of' END"
    kind_sql = "CASE event_id % 6 " + " ".join(f"WHEN {k} THEN {q('x ' + kinds[4 * k][0])}" for k in range(5)) + " ELSE 'nothing' END"
    category = "CASE " + " ".join(f"WHEN contains(kind, {q(k)}) THEN {q(v)}" for k, v in kinds) + " ELSE '其他' END"
    severity = "CASE event_id % 7 " + " ".join(f"WHEN {k} THEN {q(levels[k % len(levels)][1])}" for k in range(6)) + " ELSE 'P2' END"

    @query(
        f"vendor_normalize_{name.replace('-', '_')}",
        f"""WITH e AS (SELECT event_id, user_id, {kind_sql} AS kind FROM events WHERE event_id % 50 <> 0)
        SELECT concat('t', event_id) AS ts, concat('203.0.113.', user_id % 250) AS src_ip, {severity} AS severity, {category} AS category, kind AS rule_name, {q(name)} AS vendor, CAST(4 AS INTEGER) AS n_keys FROM e""",
    )
    def normalised(spark, sf):
        rows = table(spark, sf, "events").withColumns({"kind": F.expr(kind_sql), "level": F.expr(level_sql)})
        obj = F.create_map(
            F.lit(ts.upper()), F.when(F.col("event_id") % 50 != 0, F.concat(F.lit("t"), F.col("event_id").cast("string"))),
            F.lit(ip), F.concat(F.lit("203.0.113."), (F.col("user_id") % 250).cast("string")), F.lit(level), F.col("level"), F.lit(rule), F.col("kind"),
        )
        out = vendor.normalised(rows.select(obj.alias("obj")), name)
        return out.select("ts", "src_ip", "severity", "category", "rule_name", "vendor", F.size("_raw_keys").alias("n_keys"))


for _name in VENDORS:
    _vendor(_name)


# Web shells -------------------------------------------------------------------------------

_SNIPPET = """concat(html, CASE page_id % 9 WHEN 0 THEN concat(chr(10), '<?php @eval($_POST[1]);') WHEN 1 THEN 'eval(base64_decode(x)' WHEN 2 THEN 'phpinfo()' WHEN 3 THEN 'cmd.exe' WHEN 4 THEN 'union select' ELSE '' END)"""
_PATH = "concat('/www/', CASE page_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN '20240101' ELSE 'page' END, page_id % 10, '.php')"
_HIT = [f"CASE WHEN {matches('t', '(?ms)' + p[2])} THEN {webshell.WEIGHTS[p[3]]} ELSE 0 END" for p in WEBSHELL_PATTERNS]
_HIGH = " OR ".join(matches("t", "(?ms)" + p[2]) for p in WEBSHELL_PATTERNS if p[3] == "high")


@query(
    "webshell_scan_score",
    f"""WITH p AS (SELECT page_id, {_SNIPPET} AS t, {_PATH} AS path FROM pages),
    c AS (SELECT page_id, c, count(*)::DOUBLE AS n FROM (SELECT page_id, unnest(string_split(substr(t, 1, 65536), '')) AS c FROM p) GROUP BY ALL),
    e AS (SELECT page_id, round(-sum(n / t * log2(n / t)), 3) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY page_id) AS t FROM c) GROUP BY page_id),
    s AS (SELECT page_id, entropy, {' + '.join(_HIT)} AS points, {_HIGH} AS high, regexp_extract(path, '/([^/]*)\\.php$', 1) AS base FROM p JOIN e USING (page_id)),
    g AS (SELECT page_id, points AS hits, high, points + CASE WHEN entropy > 6.0 THEN 3 WHEN entropy > 5.5 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(base, '^[0-9]{{8,}}$') THEN 1 ELSE 0 END AS score FROM s WHERE points > 0)
    SELECT page_id, CAST(score AS INTEGER) AS score, CASE WHEN high AND score >= 6 THEN 'P0' WHEN high OR score >= 6 THEN 'P1' WHEN score >= 3 THEN 'P2' ELSE 'P3' END AS severity FROM g""",
)
def webshell_scan_score(spark, sf):
    pages = table(spark, sf, "pages")
    files = pages.select(F.expr(_PATH).alias("name"), F.expr(_SNIPPET).alias("text"), F.col("page_id"))
    # The scan keeps the path only, so the path carries the page.
    files = files.select(F.concat("name", F.lit("")).alias("file"), "page_id", "text", F.octet_length("text").alias("size"))
    scanned = webshell.scan(files.select(F.concat(F.lit("/"), F.col("page_id").cast("string"), "file").alias("path"), "size", "text"))
    return scanned.select(F.regexp_extract("path", "^/(\\d+)/", 1).cast("bigint").alias("page_id"), "score", "severity")


# Rule merges ------------------------------------------------------------------------------

_PATTERN = "concat(p_name, ' ', p_brand, ' ', p_type)"


@query(
    "rule_merge_antijoin",
    f"""WITH k AS (SELECT DISTINCT {_PATTERN} AS pattern FROM part WHERE p_size > 25), n AS (SELECT DISTINCT {_PATTERN} AS pattern FROM part) SELECT pattern FROM n WHERE pattern NOT IN (SELECT pattern FROM k)""",
)
def rule_merge_antijoin(spark, sf):
    part = table(spark, sf, "part").select("p_size", F.expr(_PATTERN).alias("pattern"))
    return rule_compile.added(part, part.where("p_size > 25")).select("pattern")


# Remote commands --------------------------------------------------------------------------

_AUDIT = """SELECT event_id, CAST(ts AS VARCHAR(30)) AS ts, CASE event_type WHEN 'error' THEN 'validation_failed' WHEN 'signup' THEN 'authorization_denied' ELSE 'executed' END AS action,
 concat('ops@svc-', user_id % 5) AS target, concat('cmd', event_id % 59) AS cmd_id, CAST(1 + event_id % 3 AS INT) AS cmd_tier, CAST(event_id % 7 AS INT) AS exit_code,
 CAST(floor(value * 1000) AS BIGINT) AS stdout_bytes, event_id % 1000 AS duration_ms, 'why' AS error_hint FROM events"""


def _audit(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("hf_events")
    return spark.sql(_AUDIT.replace("FROM events", "FROM hf_events")).withColumn("tier", F.lit(None).cast("int"))


@query("audit_totals", f"WITH a AS ({_AUDIT}) SELECT count(*) AS total_calls, CAST(sum(duration_ms) AS BIGINT) AS total_ms, CAST(floor(sum(stdout_bytes) / 1024) AS BIGINT) AS total_stdout_kb FROM a")
def audit_totals(spark, sf):
    return recipes.audit_totals(_audit(spark, sf))


@query("audit_rejected", f"WITH a AS ({_AUDIT}) SELECT event_id, cmd_id, error_hint FROM a WHERE action <> 'executed'")
def audit_rejected(spark, sf):
    return recipes.audit_rejected(_audit(spark, sf), ["event_id"]).select("event_id", "cmd_id", "error_hint")


@query("audit_mutating", f"WITH a AS ({_AUDIT}) SELECT event_id FROM a WHERE cmd_tier = 3 AND starts_with(ts, '2024-01-09')")
def audit_mutating(spark, sf):
    return recipes.audit_mutating(_audit(spark, sf), "2024-01-09").select("event_id")


@query("audit_sequence", f"WITH a AS ({_AUDIT}) SELECT cmd_tier AS tier, cmd_id, exit_code FROM a WHERE target = 'ops@svc-1'")
def audit_sequence(spark, sf):
    return recipes.audit_sequence(_audit(spark, sf), "ops@svc-1").select("tier", "cmd_id", "exit_code")


_CALLS = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'CHG-1' END AS authorized_by, CASE WHEN event_id % 13 = 0 THEN 'nohost' ELSE 'ops@svc' END AS target,
 concat('cmd', event_id % 5) AS cmd_id, CASE WHEN event_id % 7 = 0 THEN 'a;b' WHEN event_id % 7 = 1 THEN 'UPPER' ELSE 'ok' END AS arg, event_id % 4 = 0 AS allow_mutating FROM events"""


@query(
    "audit_call_verdict",
    f"""WITH c AS ({_CALLS}) SELECT event_id, CAST(CASE WHEN trim(authorized_by) = '' OR target = 'nohost' THEN 2 WHEN cmd_id = 'cmd4' THEN 3 WHEN cmd_id = 'cmd3' AND NOT allow_mutating THEN 3
    WHEN arg <> 'ok' THEN 2 ELSE 0 END AS INTEGER) AS verdict FROM c""",
)
def audit_call_verdict(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("hf_events")
    commands = spark.createDataFrame([("cmd0", 1, "^[a-z]+$"), ("cmd1", 1, "^[a-z]+$"), ("cmd2", 2, "^[a-z]+$"), ("cmd3", 3, "^[a-z]+$")], "cmd_id string, tier int, pattern string")
    return recipes.call_verdict(spark.sql(_CALLS.replace("FROM events", "FROM hf_events")), commands).select("event_id", "verdict")
