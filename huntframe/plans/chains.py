"""Chains and escalations, rule formats, and what sinks and sources give back."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntframe.functions import time as times
from huntframe.operators import grading as ops
from huntframe.operators import playbooks, report
from huntframe.operators.windows import DAY
from huntframe.plans.base import WEB, Rendered, matches, query, table
from huntframe.rules import compile as rule_compile
from huntframe.rules import ngx
from huntframe.sources import logs
from huntframe.sources.store import new_folder

# Chains -------------------------------------------------------------------------------------

_SCAN, _RCE = r"sqlmap|Nuclei", ngx.CODE_EXECUTION
#: Requests of few addresses, some of them to scripts of short names.
CHAIN = Rendered(
    "events",
    *WEB.steps,
    {"src_ip": "concat('10.9.', user_id % 40, '.1')", "uri": "CASE WHEN event_id % 61 = 0 THEN '/x1.php' ELSE uri END"},
)


@query(
    "log_chain",
    f"""WITH {CHAIN.sql('w')}, a AS (SELECT src_ip, min(us) AS scanner_us FROM w WHERE {matches('ua', _SCAN)} GROUP BY src_ip),
    b AS (SELECT src_ip, scanner_us, min(us) AS exploit_us FROM w JOIN a USING (src_ip) WHERE us > scanner_us AND {matches('uri', _RCE)} GROUP BY ALL)
    SELECT src_ip, scanner_us, exploit_us, min(us) AS shell_us FROM w JOIN b USING (src_ip) WHERE us > exploit_us AND {matches('uri', playbooks.SHORT_SCRIPT)} AND status = 200 GROUP BY ALL""",
)
def log_chain(spark, sf):
    uri = F.col("uri")
    shell = uri.rlike(playbooks.SHORT_SCRIPT) & (F.col("status") == 200)
    return ops.log_chain(CHAIN.spark(spark, sf), F.col("ua").rlike(_SCAN), uri.rlike(_RCE), shell).select("src_ip", "scanner_us", "exploit_us", "shell_us")


TRAFFIC = Rendered(
    "events",
    {
        "us": "{us}",
        "line_no": "event_id",
        "src_file": "'events'",
        "src_ip": "concat('10.0.', user_id % 40, '.5')",
        "dst_ip": "concat('192.168.', event_id % 25, '.9')",
        "uri": "concat('/p', event_id % 50)",
        "kind": "CASE event_type WHEN 'view' THEN 'scanner' WHEN 'click' THEN 'payload' WHEN 'purchase' THEN 'webshell' WHEN 'error' THEN 'exfiltration' ELSE 'other' END",
        "severity": "CASE event_id % 4 WHEN 0 THEN 'P2' WHEN 3 THEN 'P3' ELSE 'P1' END",
        "status": "CASE WHEN event_id % 3 = 0 THEN 404 ELSE 200 END",
        "bytes": "CAST(floor(value * 2000000) AS BIGINT)",
    },
)
_MUCH, _SOON = 100_000_000, 3 * 3_600_000_000
_RAISED = f"""WITH {TRAFFIC.sql('t')}, r AS (SELECT *, CASE
      WHEN kind = 'exfiltration' AND severity = 'P1' AND bytes > {_MUCH} THEN 'P0'
      WHEN kind = 'scanner' AND severity = 'P2' AND EXISTS (SELECT 1 FROM t p WHERE p.kind = 'payload' AND p.src_ip = t.src_ip AND p.us > t.us AND p.us <= t.us + {_SOON}) THEN 'P1'
      WHEN kind = 'payload' AND severity = 'P1' AND status = 200 AND EXISTS (SELECT 1 FROM t p WHERE p.kind = 'webshell' AND p.uri = t.uri AND p.us > t.us AND p.us <= t.us + {DAY}) THEN 'P0'
      ELSE severity END AS raised FROM t)"""


def _traffic(spark, sf):
    return ops.escalate_traffic(TRAFFIC.spark(spark, sf), ("src_file", "line_no"), _SOON, DAY, _MUCH)


@query("escalate_traffic", f"{_RAISED} SELECT line_no, raised FROM r")
def escalate_traffic(spark, sf):
    return _traffic(spark, sf).select("line_no", "raised")


@query("full_response", f"{_RAISED} SELECT src_ip, count(DISTINCT dst_ip) AS hosts, count(*) AS hits FROM r WHERE raised = 'P0' GROUP BY src_ip HAVING count(DISTINCT dst_ip) >= 3")
def full_response(spark, sf):
    return ops.full_response(_traffic(spark, sf))


ALERT = Rendered(
    "events",
    {
        "category": "CASE event_id % 6 WHEN 0 THEN 'rce' WHEN 1 THEN 'brute-force' WHEN 2 THEN 'jndi' ELSE 'scan' END",
        "severity": "concat('P', event_id % 4)",
        "status": "CASE event_id % 5 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END",
        "body_bytes": "CAST(floor(value * 100) AS BIGINT)",
        "tool": "event_id % 7 < 3",
        "scanner": "event_id % 8 = 0",
        "all_missing": "user_id % 2 = 0",
        "success": "event_id % 11 < 4",
        "harmless": "event_id % 13 = 0",
        "ioc_confidence": "CASE event_id % 9 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'low' END",
        "iocs": "CAST(event_id % 3 AS INT)",
        "fp": "CAST(0.1 AS DOUBLE)",
    },
)


@query(
    "triage_priority",
    f"""WITH {ALERT.sql('a')}, l AS (SELECT event_id, harmless, ioc_confidence, CASE
      WHEN success AND category = 'brute-force' THEN 'P0' WHEN category IN ('rce', 'jndi') AND status = 200 AND body_bytes > 200 THEN 'P0'
      WHEN category IN ('rce', 'jndi') THEN CASE WHEN severity = 'P0' THEN 'P0' ELSE 'P1' END WHEN scanner AND all_missing THEN 'P3'
      WHEN tool AND (status >= 500 OR body_bytes > 10000 OR iocs >= 2) THEN 'P1' WHEN tool THEN CASE WHEN severity = 'P3' THEN 'P3' ELSE 'P2' END ELSE severity END AS level FROM a)
    SELECT event_id, CASE WHEN ioc_confidence = 'HIGH' THEN concat('P', greatest(0, CAST(substr(level, 2, 1) AS INT) - 1)) ELSE level END AS level, CASE WHEN harmless THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END AS fp FROM l""",
)
def triage_priority(spark, sf):
    return ALERT.spark(spark, sf).withColumn("p", ops.priority()).select("event_id", "p.level", "p.fp")


REDIS = Rendered(
    "events",
    {
        "us": "{us}",
        "session": "concat('s', user_id, '-', event_id % 20)",
        "msg": "CASE event_id % 11 WHEN 0 THEN '\"CONFIG\" \"SET\" \"dir\" \"/root/.ssh\"' WHEN 1 THEN '\"config\" \"set\" \"dbfilename\" \"authorized_keys\"' ELSE '\"GET\" \"k\"' END",
    },
)
_DIR, _KEYS = r'(?i)"?config"?\s+"?set"?\s+"?dir\b', r'(?i)"?config"?\s+"?set"?\s+"?dbfilename"?\s+"?authorized_keys'


@query(
    "plb_redis_keys",
    f"""WITH {REDIS.sql('r')} SELECT session, min(us) FILTER ({matches('msg', _DIR)}) AS first_us, min(us) FILTER ({matches('msg', _KEYS)}) AS second_us FROM r
    GROUP BY session HAVING first_us IS NOT NULL AND second_us IS NOT NULL""",
)
def plb_redis_keys(spark, sf):
    msg = F.col("msg")
    return playbooks.in_both(REDIS.spark(spark, sf), ["session"], msg.rlike(_DIR), msg.rlike(_KEYS))


# Rule formats -------------------------------------------------------------------------------


def _files(spark, sf, path: str, body: str):
    return table(spark, sf, "part").select(F.expr(path).alias("path"), F.expr(body).alias("value"))


_WORD = "concat('tool', p_partkey % 40)"
# Every category, a condition of each kind and a list of false alarms; ids are the published ones of the telemetry.
_CATEGORIES = ("process_creation", "file_event", "registry_set", "registry_add", "registry_event", "network_connection", "image_load", "process_access", "dns_query")
_CATEGORY = "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATEGORIES)) + " END"
_EVENT_RULE = f"""concat('title: t', p_partkey, chr(10), 'logsource: {{category: ', {_CATEGORY}, '}}', chr(10), 'level: ', CASE p_partkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'high' END, chr(10),
 'falsepositives: [', CASE p_partkey % 2 WHEN 0 THEN 'a, b, c' ELSE '' END, ']', chr(10),
 'detection:', chr(10), '  selection:', chr(10), '    CommandLine|contains: ', {_WORD}, chr(10), '    Image|endswith: /x', p_size, chr(10),
 '  condition: ', CASE p_partkey % 5 WHEN 0 THEN 'selection' WHEN 1 THEN 'selection and not filter_a' WHEN 2 THEN 'selection and not 1 of filter_b' WHEN 3 THEN 'selection or other' ELSE 'selection and not filter_a filter_b 1 of filter_c' END, chr(10))"""


@query(
    "rules_from_events",
    f"""WITH r AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'high' ELSE 'medium' END AS severity, [1, 11, 13, 12, 13, 3, 7, 10][p_partkey % 9 + 1] AS event_id,
      CASE p_partkey % 2 WHEN 0 THEN 'a, b' ELSE 'see the rule''s own list' END AS false_positive FROM part WHERE p_partkey % 4 <> 2 AND p_partkey % 9 < 8 AND p_partkey % 5 <> 3)
    SELECT concat('t', p_partkey) AS description, event_id, 'CommandLine' AS field, {_WORD} AS pattern, severity, false_positive FROM r
    UNION ALL SELECT concat('t', p_partkey), event_id, 'Image', concat('/x', p_size, '$'), severity, false_positive FROM r""",
)
def rules_from_events(spark, sf):
    files = _files(spark, sf, "concat('/r/', p_partkey, '.yml')", _EVENT_RULE)
    return rule_compile.from_sigma(files).select("description", "event_id", "field", "pattern", "severity", "false_positive")


_NET_RULE = f"""concat('alert http any any -> any any (msg:"m', p_partkey, '; x"; ', CASE p_partkey % 4 WHEN 0 THEN concat('http.uri; content:"/', {_WORD}, '"; ') WHEN 1 THEN concat('pcre:"/', {_WORD}, '/i"; ')
 WHEN 2 THEN concat('content:"', {_WORD}, '"; ') ELSE concat('content:"|00|', {_WORD}, '"; ') END, 'sid:', p_partkey, ';)')"""
_NET_SETS = ("web_server", "user_agents", "coinminer", "exploit_kit", "current_events", "web_specific_apps", "malware")
_NET_SET = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_NET_SETS)) + " END"


@query(
    "rules_from_network",
    f"""SELECT concat('m', p_partkey, '; x') AS description, ['rce', 'scanner', 'c2', 'c2', 'c2'][p_partkey % 7 + 1] AS category, CASE p_partkey % 7 WHEN 1 THEN 'medium' ELSE 'high' END AS severity,
    concat('et-open-', {_NET_SET}) AS tool, CASE p_partkey % 4 WHEN 0 THEN 'uri' ELSE 'request_line_excerpt' END AS field,
    concat(CASE p_partkey % 4 WHEN 0 THEN '/' WHEN 1 THEN '(?i)' ELSE '' END, {_WORD}) AS pattern FROM part WHERE p_partkey % 4 < 3 AND p_partkey % 7 < 5""",
)
def rules_from_network(spark, sf):
    files = _files(spark, sf, f"concat('/r/emerging-', {_NET_SET}, '.rules')", _NET_RULE)
    return rule_compile.from_suricata(files).select("description", "category", "severity", "tool", "field", "pattern")


_CORE_RULE = f"""concat('# a comment', chr(10), 'SecRule ARGS "@rx ', {_WORD}, '=[0-9]+" ', chr(92), chr(10), '  "id:', p_partkey, '"', chr(10), 'SecRule ARGS "@pm a b" "id:1"', chr(10))"""
_CORE_SETS = ("930-APPLICATION-ATTACK-LFI", "931-APPLICATION-ATTACK-RFI", "932-APPLICATION-ATTACK-RCE", "933-APPLICATION-ATTACK-PHP", "941-APPLICATION-ATTACK-XSS", "942-APPLICATION-ATTACK-SQLI", "913-SCANNER-DETECTION", "944-APPLICATION-ATTACK-JAVA")
_CORE_SET = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_CORE_SETS)) + " END"


@query(
    "rules_from_core_sets",
    f"""SELECT concat({_WORD}, '=[0-9]+') AS pattern, ['lfi', 'rfi', 'rce', 'rce', 'xss', 'sqli'][p_partkey % 8 + 1] AS category, 'request_line_excerpt' AS field,
    CASE p_partkey % 8 WHEN 4 THEN 'medium' ELSE 'high' END AS severity, concat('owasp-crs-', substr({_CORE_SET}, 1, 3)) AS tool, count(*) AS n FROM part WHERE p_partkey % 8 < 6 GROUP BY ALL""",
)
def rules_from_core_sets(spark, sf):
    files = _files(spark, sf, f"concat('/r/REQUEST-', {_CORE_SET}, '.conf')", _CORE_RULE)
    return rule_compile.from_crs(files).groupBy("pattern", "category", "field", "severity", "tool").agg(F.count(F.lit(1)).alias("n"))


_CONTENT_RULE = f"""concat('rule r', p_partkey, ' {{ meta: description = "', CASE p_partkey % 2 WHEN 0 THEN 'a webshell' ELSE 'a game' END, '" strings: $a = /', {_WORD}, 'x+/ nocase $b = "plain" condition: any of them }}')"""


@query("rules_from_content", f"SELECT concat('(?i)', {_WORD}, 'x+') AS pattern, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL")
def rules_from_content(spark, sf):
    return rule_compile.from_yara(_files(spark, sf, "'/r/x.yar'", _CONTENT_RULE)).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rule_merge_rows",
    """WITH k AS (SELECT DISTINCT p_brand AS pattern FROM part WHERE p_partkey % 50 = 0), n AS (SELECT p_brand AS pattern, min(p_type) AS description FROM part GROUP BY ALL)
    SELECT 'OLD-001' AS id, pattern, 'old' AS description FROM k UNION ALL
    SELECT printf('NEW-%03d', row_number() OVER (ORDER BY pattern)), pattern, description FROM n WHERE pattern NOT IN (SELECT pattern FROM k)""",
)
def rule_merge_rows(spark, sf):
    part = table(spark, sf, "part")
    known = part.where("p_partkey % 50 = 0").select(F.lit("OLD-001").alias("id"), F.col("p_brand").alias("pattern"), F.lit("old").alias("description")).distinct()
    return rule_compile.merged(part.select(F.col("p_brand").alias("pattern"), F.col("p_type").alias("description")), known).select("id", "pattern", "description")


# Sinks, sources and times -------------------------------------------------------------------

_ROWS = """SELECT event_id, CAST(user_id AS VARCHAR(20)) AS "user", CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS kind, concat('a "q", ', event_id, chr(10), 'é') AS note FROM events"""


def _rows(spark, sf):
    kind = F.when(F.col("event_id") % 5 != 0, F.col("event_type"))
    return table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("user"), kind.alias("kind"), F.expr("concat('a \"q\", ', event_id, chr(10), 'é')").alias("note"))


@query("sink_ndjson", _ROWS)
def sink_ndjson(spark, sf):
    rows, path = _rows(spark, sf), new_folder(spark, "ndjson")
    report.write_ndjson(rows, path)
    return logs.read_ndjson(spark, path, "event_id long, user string, kind string, note string")


@query("sink_csv", _ROWS.replace("chr(10)", "' '"))
def sink_csv(spark, sf):
    rows, path = _rows(spark, sf).withColumn("note", F.replace("note", F.lit("\n"), F.lit(" "))), new_folder(spark, "csv")
    report.write_csv(rows, path, rows.columns)
    obj = lambda n: F.try_element_at("obj", F.lit(n))
    return logs.read_csv_files(spark, path).select(obj("event_id").cast("bigint").alias("event_id"), obj("user").alias("user"), obj("kind").alias("kind"), obj("note").alias("note"))


@query(
    "source_json_wrappers",
    "SELECT concat('f', user_id) AS src_file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no, CAST(event_id AS VARCHAR) AS id FROM events WHERE user_id % 4 < 3",
)
def source_json_wrappers(spark, sf):
    """Files that are an array, an object with an array in it, and others that are no JSON."""
    items = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda i: F.concat(F.lit('{"id":"'), i.cast("string"), F.lit('"}'))), ","), F.lit("]"))
    files = table(spark, sf, "events").groupBy("user_id").agg(items.alias("items"))
    value = F.expr("CASE user_id % 4 WHEN 0 THEN items WHEN 1 THEN concat('{\"alerts\":', items, '}') WHEN 2 THEN concat(' {\"data\" : ', items, '}') ELSE concat('not ', items) END")
    made = logs.json_objects(files.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("src_file"), value.alias("value")))
    return made.select("src_file", "line_no", F.try_element_at("obj", F.lit("id")).alias("id"))


@query(
    "record_times",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+08:00') END AS access, strftime(ts, '2024-%m-%dT%H:%M:%S') AS syslog,
    strftime(to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS epoch FROM events""",
)
def record_times(spark, sf):
    """Times of three kinds of logs, rendered and read."""
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    access = F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.when(F.col("event_id") % 7 == 0, F.lit(" CEST")).otherwise(F.lit(" +0800")))
    epoch = F.floor(F.unix_micros("ts") / 1_000_000).cast("string")
    return rows.select(
        "event_id", times.access_time(access).alias("access"), times.syslog_time(F.date_format("ts", "MMM d HH:mm:ss"), 2024).alias("syslog"), F.regexp_replace(times.epoch_time(epoch), "Z$", "+00:00").alias("epoch")
    )
