"""Queries on web access logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntframe.operators import recipes, report
from huntframe.operators.windows import DAY, burst
from huntframe.plans.base import QUERIES, WEB, any_of, matches, q, query, queue_sql, table, web
from huntframe.rules import ngx
from huntframe.rules.catalog import RULES
from huntframe.rules.libraries import UA_SIGNATURES
from huntframe.sources import logs
from huntframe.sources.store import dealt

#: Events are sparse: a burst here is three client errors within a day.
WINDOW, ROWS = DAY, 3

_SIGNATURE = "CASE " + " ".join(f"WHEN {matches('ua', s[2])} THEN {q(s[0])}" for s in UA_SIGNATURES) + " END"
_BURST = f"""b AS (SELECT src_ip, line_no, us, n FROM (SELECT *, {queue_sql('src_ip', WINDOW)} AS n FROM web WHERE status BETWEEN 400 AND 499)
  WHERE n >= {ROWS} QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY us, line_no) = 1)"""
_BODY = r"""TRY_CAST(regexp_extract(raw_line, '"\s+\d{3}\s+(\d+)\s+"', 1) AS BIGINT)"""
_RULES = {
    "R-NGX-001": f"ua <> '' AND {_SIGNATURE} IS NOT NULL",
    "R-NGX-003": matches("uri", ngx.SENSITIVE_PATH),
    "R-NGX-004": f"length(uri) > {ngx.LONG_URI}",
    "R-NGX-005": f"upper(method) IN {any_of(*ngx.METHODS)}",
    "R-NGX-006": matches("uri", ngx.TRAVERSAL),
    "R-NGX-007": matches("uri", ngx.SQL_INJECTION),
    "R-NGX-008": matches("uri", ngx.CODE_EXECUTION),
    "R-NGX-009": f"{_BODY} > {ngx.LARGE_BODY}",
    "R-NGX-010": f"length(ua) < {ngx.SHORT_UA} OR {matches('ua', ngx.SYMBOLS_ONLY)}",
}
_HITS = (
    f"WITH {WEB.sql('web')}, {_BURST}, h AS ("
    + " UNION ALL ".join(f"SELECT line_no, us, {q(r)} AS rule_id, {q(RULES[r].severity)} AS severity FROM web WHERE {c}" for r, c in _RULES.items())
    + " UNION ALL SELECT line_no, us, 'R-NGX-002', 'P2' FROM b)"
)


def _detected(spark, sf):
    return ngx.detect(web(spark, sf), window_us=WINDOW, at_least=ROWS)


@query("ngx_rules", f"{_HITS} SELECT line_no, rule_id, severity FROM h")
def ngx_rules(spark, sf):
    return _detected(spark, sf).select("line_no", "rule_id", "severity")


@query("ngx_rules_summary", f"{_HITS} SELECT rule_id, severity, count(*) AS hits FROM h GROUP BY rule_id, severity")
def ngx_rules_summary(spark, sf):
    return _detected(spark, sf).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "ngx_findings",
    f"""{_HITS}, o AS (SELECT *, row_number() OVER (ORDER BY us, line_no, rule_id) AS n FROM h)
    SELECT format('NGX-{{:03d}}', n) AS id, rule_id, severity, line_no FROM o""",
)
def ngx_findings(spark, sf):
    found = ngx.findings(web(spark, sf), window_us=WINDOW, at_least=ROWS)
    return found.select("id", "rule_id", "severity", F.get_json_object("evidence", "$.line_no").cast("bigint").alias("line_no"))


@query("burst_4xx", f"WITH {WEB.sql('web')}, {_BURST} SELECT src_ip, line_no, n FROM b")
def burst_4xx(spark, sf):
    return burst(ngx.client_errors(web(spark, sf)), ["src_ip"], "us", ngx.TIES, WINDOW, ROWS).select("src_ip", "line_no", "n")


@query("ngx_001_ua_signature", f"WITH {WEB.sql('web')} SELECT line_no, {_SIGNATURE} AS sig_id FROM web WHERE ua <> '' AND {_SIGNATURE} IS NOT NULL")
def ngx_001_ua_signature(spark, sf):
    rows = web(spark, sf).withColumn("sig_id", ngx.signature_of(F.col("ua"))["sig_id"])
    return rows.where("sig_id IS NOT NULL").select("line_no", "sig_id")


@query(
    "ngx_parse_combined",
    f"""WITH {WEB.sql('web')} SELECT line_no, concat(ts, '+00:00') AS ts, src_ip, user, method, uri, CAST(status AS INTEGER) AS status, ua, msg FROM web""",
)
def ngx_parse_combined(spark, sf):
    lines = web(spark, sf, deal=True).select("src_file", "line_no", F.col("raw_line").alias("value"), F.lit("nginx-access").alias("log_type"))
    return logs.parse_lines(lines, 2024).select("line_no", "ts", "src_ip", "user", "method", "uri", "status", "ua", "msg")


@query(
    "log_type_detection",
    f"""WITH {WEB.sql('web')} SELECT concat('/logs/', CASE line_no % 4 WHEN 0 THEN 'auth.log' WHEN 1 THEN 'site.apache' WHEN 2 THEN 'messages' ELSE 'x' END, line_no) AS src_file,
    CASE line_no % 4 WHEN 0 THEN 'linux-auth' WHEN 1 THEN 'apache-access' WHEN 2 THEN 'syslog'
    ELSE CASE WHEN method IN ('GET', 'POST', 'PUT') THEN 'nginx-access' ELSE 'syslog' END END AS log_type FROM web""",
)
def log_type_detection(spark, sf):
    name = "concat('/logs/', CASE line_no % 4 WHEN 0 THEN 'auth.log' WHEN 1 THEN 'site.apache' WHEN 2 THEN 'messages' ELSE 'x' END, line_no)"
    lines = web(spark, sf).select(F.expr(name).alias("src_file"), "line_no", F.col("raw_line").alias("value"))
    return logs.with_log_type(lines).select("src_file", "log_type")


@query("json_props_parse", "SELECT event_id AS line_no, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, '{\"k\": ' || json_extract_string(props, '$.k') || '}' AS msg FROM events")
def json_props_parse(spark, sf):
    obj = table(spark, sf, "events").select(F.lit("e").alias("src_file"), F.col("event_id").alias("line_no"), F.from_json("props", logs.MAP).alias("obj"))
    k = F.get_json_object("raw_line", "$.k")
    return logs.alerts(obj).select("line_no", k.alias("k"), F.concat(F.lit('{"k": '), k, F.lit("}")).alias("msg"))


def _recipe(name: str, sql: str):
    return query(name, f"WITH {WEB.sql('web')} {sql}")


@_recipe("accesslog_status_hist", "SELECT CAST(status AS INTEGER) AS status, count(*) AS hits FROM web GROUP BY status")
def accesslog_status_hist(spark, sf):
    return recipes.status_histogram(web(spark, sf))


@_recipe("accesslog_top_4xx", "SELECT src_ip, count(*) AS hits FROM web WHERE status BETWEEN 400 AND 499 GROUP BY src_ip ORDER BY hits DESC, src_ip LIMIT 20")
def accesslog_top_4xx(spark, sf):
    return recipes.busiest(ngx.client_errors(web(spark, sf)), ["src_ip"], 20)


@_recipe("accesslog_heavy_clients", "SELECT src_ip, count(*) AS hits FROM web GROUP BY src_ip HAVING count(*) >= 60")
def accesslog_heavy_clients(spark, sf):
    return recipes.heavy_clients(web(spark, sf), 60)


@_recipe("accesslog_multi_uri", "SELECT src_ip, count(DISTINCT uri) AS uris FROM web GROUP BY src_ip HAVING count(DISTINCT uri) >= 50")
def accesslog_multi_uri(spark, sf):
    return recipes.wide_clients(web(spark, sf), 50)


@_recipe("accesslog_odd_methods", f"SELECT line_no, method FROM web WHERE method IN {any_of(*recipes.ODD_METHODS)}")
def accesslog_odd_methods(spark, sf):
    return recipes.odd_methods(web(spark, sf)).select("line_no", "method")


@_recipe("accesslog_long_uri", "SELECT line_no, CAST(length(uri) AS INTEGER) AS n FROM web WHERE length(uri) >= 500")
def accesslog_long_uri(spark, sf):
    return recipes.long_uris(web(spark, sf)).select("line_no", F.length("uri").alias("n"))


@_recipe("accesslog_large_responses", f"SELECT line_no, bytes FROM web WHERE bytes > {ngx.LARGE_BODY} ORDER BY bytes DESC, line_no LIMIT 10")
def accesslog_large_responses(spark, sf):
    return recipes.large_responses(web(spark, sf)).select("line_no", "bytes")


@_recipe("accesslog_large_posts", "SELECT line_no, bytes FROM web WHERE method = 'POST' AND bytes > 4096")
def accesslog_large_posts(spark, sf):
    return recipes.large_posts(web(spark, sf)).select("line_no", "bytes")


@_recipe("accesslog_bare_agents", "SELECT line_no, ua FROM web WHERE length(ua) < 20")
def accesslog_bare_agents(spark, sf):
    return recipes.bare_agents(web(spark, sf)).select("line_no", "ua")


@_recipe("accesslog_errors", "SELECT line_no, CAST(status AS INTEGER) AS status FROM web WHERE status >= 400")
def accesslog_errors(spark, sf):
    return recipes.errors(web(spark, sf)).select("line_no", "status")


@_recipe("accesslog_uris_of_ip", "SELECT uri, count(*) AS hits FROM web WHERE src_ip = '10.0.7.7' GROUP BY uri")
def accesslog_uris_of_ip(spark, sf):
    return recipes.uris_of(web(spark, sf), "10.0.7.7")


@_recipe("accesslog_error_shares", "SELECT src_ip, count(*) FILTER (status = 200) AS ok, count(*) FILTER (status >= 400) AS errors, count(*) AS hits, count(*) FILTER (status >= 400) / count(*)::DOUBLE AS error_share FROM web GROUP BY src_ip")
def accesslog_error_shares(spark, sf):
    return recipes.error_shares(web(spark, sf))


@_recipe(
    "accesslog_slow_and_steady",
    "SELECT src_ip, count(*) FILTER (n BETWEEN 1 AND 2) AS hours, max(n) AS busiest FROM (SELECT src_ip, us // 3600000000 AS h, count(*) AS n FROM web WHERE status >= 400 GROUP BY ALL) GROUP BY src_ip HAVING hours >= 5 AND busiest <= 2",
)
def accesslog_slow_and_steady(spark, sf):
    return recipes.slow_and_steady(web(spark, sf), 1, 2, 5)


@_recipe("accesslog_night_shares", "SELECT src_ip, count(*) FILTER (us // 3600000000 % 24 BETWEEN 2 AND 4) AS night, count(*) AS hits FROM web GROUP BY src_ip")
def accesslog_night_shares(spark, sf):
    return recipes.night_shares(web(spark, sf))


@query("accesslog_json_status", "SELECT CAST(CASE event_type WHEN 'error' THEN 404 ELSE 500 END AS INTEGER) AS status, count(*) AS hits FROM events WHERE event_type IN ('error', 'view') GROUP BY status")
def accesslog_json_status(spark, sf):
    status = F.expr("CASE event_type WHEN 'error' THEN '404' WHEN 'view' THEN '500' ELSE '200' END")
    value = F.to_json(F.struct(status.alias("status"), F.lit("1.1.1.1").alias("client_ip")))
    lines = dealt(table(spark, sf, "events")).select(F.lit("a").alias("src_file"), F.col("event_id").alias("line_no"), value.alias("value"), F.lit("nginx-access").alias("log_type"))
    return recipes.status_histogram(recipes.errors(logs.parse_lines(lines, 2024)))


@query(
    "severity_summary",
    f"{_HITS} SELECT count(*) FILTER (severity = 'P0') AS p0, count(*) FILTER (severity = 'P1') AS p1, "
    "count(*) FILTER (severity = 'P2') AS p2, count(*) FILTER (severity = 'P3') AS p3, count(*) AS total FROM h",
)
def severity_summary(spark, sf):
    return report.severity_summary(_detected(spark, sf))


FLAGSHIP = QUERIES["ngx_rules_summary"]
