"""Queries on grading, triage, escalation and reports; findings are rendered from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntframe.operators import grading as ops
from huntframe.operators import report
from huntframe.operators.windows import DAY
from huntframe.plans.base import Rendered, q, query, table

TIES = ("line_no",)
WINDOW = DAY

FOUND = Rendered(
    "events",
    {
        "us": "{us}",
        "line_no": "event_id",
        "src_file": "'events'",
        "id": "concat('F-', event_id)",
        "src_ip": "concat('10.0.', user_id % 40, '.5')",
        "dst_ip": "concat('192.168.', event_id % 25, '.9')",
        "user": "concat('u', user_id % 40)",
        "host": "concat('h', event_id % 7)",
        "rule_id": "concat('R-', event_type, '-', event_id % 3)",
        "severity": "CASE event_id % 10 WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' WHEN 2 THEN 'P1' WHEN 3 THEN 'P2' WHEN 4 THEN 'P2' WHEN 5 THEN 'P2' ELSE 'P3' END",
        "category": "CASE event_type WHEN 'view' THEN 'recon' WHEN 'click' THEN 'exploit' WHEN 'purchase' THEN 'auth_success' ELSE 'other' END",
        "view": "CASE event_id % 5 WHEN 0 THEN 'tls' WHEN 1 THEN 'dns' ELSE 'http' END",
    },
)
_F = FOUND.sql("f")
_UP = "concat('P', greatest(0, CAST(substr(severity, 2, 1) AS INT) - 1))"


def found(spark, sf):
    return FOUND.spark(spark, sf)


def _kinds(key: str, value: str, window: int) -> str:
    return f"(SELECT count(DISTINCT b.{value}) FROM f b WHERE b.{key} = f.{key} AND b.us BETWEEN f.us - {window} AND f.us AND b.line_no <= f.line_no)"


@query(
    "correlate_5min",
    f"WITH {_F}, k AS (SELECT *, {_kinds('src_ip', 'rule_id', WINDOW)} AS kinds FROM f) SELECT line_no, kinds, CASE WHEN kinds >= 7 THEN {_UP} ELSE severity END AS raised FROM k",
)
def correlate_5min(spark, sf):
    return ops.escalate_rules(found(spark, sf), TIES, WINDOW, 7).select("line_no", "kinds", "raised")


@query(
    "escalate_hosts",
    f"""WITH {_F}, k AS (SELECT *, {_kinds('"user"', 'host', WINDOW)} AS hosts FROM f) SELECT line_no, hosts, CASE WHEN hosts >= 5 THEN {_UP} ELSE severity END AS raised,
    CASE WHEN hosts >= 5 THEN 'lateral' END AS tag FROM k""",
)
def escalate_hosts(spark, sf):
    return ops.escalate_hosts(found(spark, sf), TIES, WINDOW, 5).select("line_no", "hosts", "raised", "tag")


@query(
    "escalate_assets",
    f"WITH {_F}, k AS (SELECT *, {_kinds('dst_ip', 'src_ip', WINDOW)} AS sources FROM f) SELECT line_no, sources, CASE WHEN sources >= 10 THEN {_UP} ELSE severity END AS raised FROM k",
)
def escalate_assets(spark, sf):
    return ops.escalate_assets(found(spark, sf), TIES, WINDOW, 10).select("line_no", "sources", "raised")


def _counted(where: str) -> str:
    return f"(SELECT count(*) FROM f b WHERE b.src_ip = f.src_ip AND b.us BETWEEN f.us - {WINDOW} AND f.us AND b.line_no <= f.line_no AND {where})"


@query(
    "escalate_volume",
    f"WITH {_F}, k AS (SELECT *, {_counted('b.severity < ' + q('P3'))} AS serious FROM f) SELECT line_no, serious, CASE WHEN serious >= 5 AND severity = 'P2' THEN 'P1' ELSE severity END AS raised FROM k",
)
def escalate_volume(spark, sf):
    return ops.escalate_volume(found(spark, sf), TIES, WINDOW, 5).select("line_no", "serious", "raised")


@query(
    "campaign",
    f"WITH {_F}, k AS (SELECT *, {_counted('true')} AS events, {_counted('b.severity = ' + q('P0'))} AS worst FROM f) SELECT line_no, events, CASE WHEN events >= 5 AND worst > 0 THEN 'campaign' END AS tag FROM k",
)
def campaign(spark, sf):
    return ops.campaigns(found(spark, sf), TIES, WINDOW, 5).select("line_no", "events", "tag")


@query(
    "kill_chain_stages",
    f"""WITH {_F}, a AS (SELECT src_ip, min(us) AS recon_us FROM f WHERE category = 'recon' GROUP BY src_ip),
    b AS (SELECT src_ip, recon_us, min(us) AS exploit_us FROM f JOIN a USING (src_ip) WHERE category = 'exploit' AND us > recon_us GROUP BY ALL)
    SELECT src_ip, recon_us, exploit_us, min(us) AS auth_success_us FROM f JOIN b USING (src_ip) WHERE category = 'auth_success' AND us > exploit_us GROUP BY ALL""",
)
def kill_chain_stages(spark, sf):
    stages = ("recon", "exploit", "auth_success")
    return ops.stages_in_order(found(spark, sf), ["src_ip"], "category", stages).select("src_ip", *[f"{s}_us" for s in stages])


#: Many sources with few findings each.
_SPREAD = "concat('10.', user_id % 20, '.', event_id % 149, '.1')"


@query(
    "escalate_by_source",
    f"""WITH {_F}, s AS (SELECT {_SPREAD} AS src_ip, count(DISTINCT rule_id) AS rules, min(severity) AS severity FROM f GROUP BY ALL)
    SELECT src_ip, rules, severity AS worst, CASE WHEN rules >= 5 THEN 'P0' WHEN rules >= 3 THEN {_UP} ELSE severity END AS raised FROM s""",
)
def escalate_by_source(spark, sf):
    return ops.by_source(found(spark, sf).withColumn("src_ip", F.expr(_SPREAD)))


@query(
    "cross_view",
    f"""WITH {_F}, s AS (SELECT {_SPREAD} AS src_ip, count(DISTINCT view) AS views, min(severity) AS severity FROM f GROUP BY ALL)
    SELECT src_ip, views, severity AS worst, CASE WHEN views >= 3 THEN 'P0' WHEN views = 2 THEN {_UP} ELSE severity END AS raised FROM s""",
)
def cross_view(spark, sf):
    return ops.by_view(found(spark, sf).withColumn("src_ip", F.expr(_SPREAD)))


@query("known_bad_sources", f"WITH {_F} SELECT line_no, CASE WHEN severity = 'P3' AND EXISTS (SELECT 1 FROM nation WHERE concat('10.0.', n_nationkey, '.5') = f.src_ip) THEN 'P2' ELSE severity END AS raised FROM f")
def known_bad_sources(spark, sf):
    history = table(spark, sf, "nation").select(F.concat(F.lit("10.0."), F.col("n_nationkey").cast("string"), F.lit(".5")).alias("src_ip"))
    return ops.known_bad(found(spark, sf), history).select("line_no", "raised")


@query(
    "whitelisted_scans",
    f"""WITH {_F} SELECT line_no, CASE WHEN date_part('hour', ts) BETWEEN 1 AND 5 AND EXISTS (SELECT 1 FROM region WHERE concat('10.0.', r_regionkey, '.5') = f.src_ip) THEN 'P3' ELSE severity END AS lowered FROM f""",
)
def whitelisted_scans(spark, sf):
    known = table(spark, sf, "region").select(F.concat(F.lit("10.0."), F.col("r_regionkey").cast("string"), F.lit(".5")).alias("src_ip"))
    return ops.unescalated(found(spark, sf), known, 1, 5).select("line_no", "lowered")


@query(
    "tool_then_sensitive",
    f"""WITH {_F}, t AS (SELECT src_ip, min(line_no) AS first_line FROM f WHERE event_id % 31 = 0 GROUP BY src_ip) SELECT line_no FROM f JOIN t USING (src_ip) WHERE event_id % 7 = 3 AND event_type = 'view' AND line_no > first_line""",
)
def tool_then_sensitive(spark, sf):
    rows = found(spark, sf).withColumn("status", F.when(F.col("event_type") == "view", 200).otherwise(404))
    return ops.tool_then_sensitive(rows, F.col("event_id") % 31 == 0, F.col("event_id") % 7 == 3, TIES).select("line_no")


@query(
    "silent_scanners",
    f"""WITH {_F} SELECT concat('10.3.', user_id) AS src_ip, max(us) AS last_us FROM f GROUP BY user_id HAVING user_id % 3 = 0 AND max(us) <= (SELECT max(us) FROM f) - 3600000000""",
)
def silent_scanners(spark, sf):
    rows = found(spark, sf).withColumns({"status": F.expr("CASE WHEN user_id % 3 = 0 THEN 404 ELSE 200 END"), "src_ip": F.expr("concat('10.3.', user_id)")})
    last = rows.agg(F.max("us").alias("until_us"))
    return ops.silent_scanners(rows, last, 3_600_000_000).select("src_ip", "last_us")


@query(
    "off_hours_sources",
    f"""WITH {_F}, p AS (SELECT *, concat('10.1.', event_id % 60, '.1') AS ip FROM f), o AS (SELECT "user", ip, min(line_no) AS line_no FROM p GROUP BY ALL)
    SELECT f.line_no, {_UP} AS raised FROM o JOIN f ON f.line_no = o.line_no WHERE us // 3600000000 % 24 >= 22 OR us // 3600000000 % 24 < 6""",
)
def off_hours_sources(spark, sf):
    rows = found(spark, sf).withColumn("src_ip", F.expr("concat('10.1.', event_id % 60, '.1')"))
    return ops.off_hours_sources(rows, TIES).select("line_no", "raised")


_SCORES = "SELECT event_id, CAST(event_id % 11 AS INT) AS base, CAST(user_id % 5 AS INT) AS boost, CAST(event_id % 6 AS INT) AS penalty FROM events"


@query(
    "grading_score",
    f"""SELECT event_id, CASE WHEN penalty >= 4 THEN 'P3' WHEN base + boost - penalty >= 9 THEN 'P0' WHEN base + boost - penalty >= 7 THEN 'P1' WHEN base + boost - penalty >= 5 THEN 'P2' ELSE 'P3' END AS level FROM ({_SCORES})""",
)
def grading_score(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "CAST(event_id % 11 AS INT) AS base", "CAST(user_id % 5 AS INT) AS boost", "CAST(event_id % 6 AS INT) AS penalty")
    return rows.select("event_id", ops.graded(F.col("base"), F.col("boost"), F.col("penalty")).alias("level"))


_ALERT = {
    "severity": "CASE event_id % 4 WHEN 0 THEN 'P1' ELSE 'P2' END",
    "action": "CASE event_id % 3 WHEN 0 THEN 'block' ELSE 'pass' END",
    "status": "CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 500 END",
    "category": "CASE event_type WHEN 'view' THEN 'webshell' WHEN 'click' THEN 'brute-force' ELSE 'other' END",
    "payload": "CASE event_id % 7 WHEN 0 THEN 'POST /a.jsp' WHEN 1 THEN 'x log4j y' WHEN 2 THEN 'union select' ELSE 'nothing' END",
    "user_agent": "CASE user_id % 4 WHEN 0 THEN 'sqlmap/1' WHEN 1 THEN 'Nuclei' ELSE 'Mozilla' END",
    "success": "event_id % 17 = 0",
    "fails_per_min": "CAST(event_id % 130 AS INT)",
    "error_ratio": "CAST(event_id % 5 AS DOUBLE) / 4",
    "sensitive_ok": "event_id % 9 = 0",
    "whitelisted": "user_id % 6 = 0",
    "followed": "event_id % 2 = 0",
}


@query(
    "triage_tree",
    f"""WITH a AS (SELECT event_id, {', '.join(f'{e} AS {n}' for n, e in _ALERT.items())} FROM events)
    SELECT event_id, CASE WHEN severity = 'P1' AND action = 'block' AND NOT followed THEN 'P2' WHEN payload = 'POST /a.jsp' AND status = 200 AND category = 'webshell' THEN 'P0'
     WHEN contains(payload, 'log4j') AND action <> 'block' AND status = 200 THEN 'P0' WHEN contains(payload, 'log4j') AND action <> 'block' THEN 'P1' WHEN contains(payload, 'log4j') THEN 'P2'
     WHEN category = 'brute-force' AND success THEN 'P0' WHEN category = 'brute-force' AND fails_per_min >= 100 THEN 'P1' WHEN category = 'brute-force' AND fails_per_min >= 20 THEN 'P2' WHEN category = 'brute-force' THEN 'P3'
     WHEN user_agent = 'sqlmap/1' AND error_ratio < 0.5 AND payload = 'union select' THEN 'P1' WHEN user_agent = 'sqlmap/1' AND error_ratio = 1 AND whitelisted THEN 'P3' WHEN user_agent = 'sqlmap/1' AND error_ratio >= 0.5 THEN 'P2'
     WHEN user_agent = 'Nuclei' AND sensitive_ok THEN 'P1' WHEN user_agent = 'Nuclei' THEN 'P2' WHEN whitelisted THEN 'P3' ELSE 'P2' END AS level FROM a""",
)
def triage_tree(spark, sf):
    rows = table(spark, sf, "events").withColumns({n: F.expr(e) for n, e in _ALERT.items()})
    return rows.select("event_id", ops.triage().alias("level"))


@query(
    "false_alarms",
    """SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 'scanner-whitelist' WHEN event_id % 4 = 0 THEN 'health-check' WHEN user_id % 3 = 0 THEN 'monitoring' WHEN user_id % 5 = 0 THEN 'crawler' END AS why FROM events""",
)
def false_alarms(spark, sf):
    rows = table(spark, sf, "events")
    uri = F.when(F.col("event_id") % 4 == 0, F.lit("/healthz")).otherwise(F.lit("/x"))
    ua = F.when(F.col("user_id") % 3 == 0, F.lit("Prometheus/2")).when(F.col("user_id") % 5 == 0, F.lit("Googlebot")).otherwise(F.lit("x"))
    return rows.select("event_id", ops.false_alarm(uri, ua, F.col("user_id") % 9 == 0).alias("why"))


@query("noisy_rules", "SELECT event_type AS rule_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 60 AND bool_and(event_type = 'view' OR event_type = 'click')")
def noisy_rules(spark, sf):
    action = F.when(F.col("event_type").isin("view", "click"), F.lit("block")).otherwise(F.lit("pass"))
    alerts = table(spark, sf, "events").select(F.col("event_type").alias("rule_name"), "ts", action.alias("action"))
    return ops.noisy_rules(alerts, 60).select("rule_name", F.col("day").cast("string").alias("day"), "n")


# Reports ----------------------------------------------------------------------------------


@query(
    "daily_report_cube",
    f"""WITH {_F}, r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, severity, category, src_ip, count(*) AS n FROM f GROUP BY ALL)
    SELECT coalesce(day, 'all') AS day, coalesce(severity, 'all') AS severity, coalesce(category, 'all') AS category, CAST(sum(n) AS BIGINT) AS hits FROM r GROUP BY CUBE (day, severity, category)""",
)
def daily_report_cube(spark, sf):
    return report.daily_report(found(spark, sf), F.to_date("ts").cast("string")).select("day", "severity", "category", "hits")


@query("report_hours", f"WITH {_F} SELECT CAST(date_part('hour', ts) AS INTEGER) AS hour, count(*) AS hits FROM f GROUP BY hour")
def report_hours(spark, sf):
    return report.hours(found(spark, sf))


@query("report_worst", f"WITH {_F} SELECT line_no, severity FROM f ORDER BY severity, us, line_no LIMIT 30")
def report_worst(spark, sf):
    return report.worst(found(spark, sf)).select("line_no", "severity")


@query("report_by_rule", f"WITH {_F} SELECT rule_id, count(*) AS hits FROM f GROUP BY rule_id")
def report_by_rule(spark, sf):
    return report.by_rule(found(spark, sf))


@query("report_completeness", f"WITH {_F} SELECT count(*) AS findings, 0::BIGINT AS without_key_fields, false AS one_source FROM f")
def report_completeness(spark, sf):
    return report.completeness(found(spark, sf))


@query("report_dwell", f"WITH {_F} SELECT src_ip, min(us) AS first_us, (max(us) - min(us)) / 1e6 AS dwell_s FROM f GROUP BY src_ip")
def report_dwell(spark, sf):
    rows = found(spark, sf)
    last = rows.groupBy("src_ip").agg(F.max("us").alias("last_us"))
    first = rows.groupBy("src_ip").agg(F.min("us").alias("us"))
    return report.dwell(first.join(last, "src_ip"), F.col("last_us"), ["src_ip", "last_us"]).select("src_ip", "first_us", "dwell_s")


@query(
    "attack_path_monotone",
    """WITH n AS (SELECT conv_id, turn, length(text) AS t, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
    SELECT conv_id, count(*) AS nodes, count(*) FILTER (t < b) AS out_of_order FROM n GROUP BY conv_id""",
)
def attack_path_monotone(spark, sf):
    nodes = table(spark, sf, "conversations").withColumn("at", F.length("text"))
    return report.paths_in_order(nodes, "conv_id", "turn", "at")


@query("path_first_by_tactic", "SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role")
def path_first_by_tactic(spark, sf):
    return report.first_by_tactic(table(spark, sf, "conversations"), "conv_id", "role", "turn").select("conv_id", "role", "turn")


@query("path_dangling_refs", f"WITH {_F} SELECT conv_id, turn FROM conversations WHERE concat('F-', conv_id * 300) NOT IN (SELECT id FROM f)")
def path_dangling_refs(spark, sf):
    nodes = table(spark, sf, "conversations").withColumn("finding_ref", F.concat(F.lit("F-"), (F.col("conv_id") * 300).cast("string")))
    return report.dangling(nodes, found(spark, sf)).select("conv_id", "turn")


