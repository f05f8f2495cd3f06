"""Queries on Windows events, rendered from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.operators.windows import DAY, HOUR
from huntframe.plans.base import Rendered, any_of, matches, q, query, queue_sql
from huntframe.rules import win as rules
from huntframe.rules.libraries import PERSISTENCE

WINDOW, ROWS, GRACE = DAY, 3, 12 * HOUR

#: One kind of event for each remainder; the event's own fields are columns named f_... here.
WIN = Rendered(
    "events",
    {
        "us": "{us}",
        "line_no": "event_id",
        "src_file": "'events'",
        "record_id": "event_id",
        "win_id": """CASE WHEN event_type = 'error' THEN 4625 WHEN event_type = 'purchase' THEN 4624 ELSE
            CASE event_id % 20 WHEN 0 THEN 4720 WHEN 1 THEN 4732 WHEN 2 THEN 4672 WHEN 3 THEN 1102 WHEN 4 THEN 4698 WHEN 5 THEN 4662 WHEN 6 THEN 4769 WHEN 7 THEN 4771
            WHEN 8 THEN 7045 WHEN 9 THEN 4688 WHEN 10 THEN 4688 WHEN 11 THEN 4104 WHEN 12 THEN 4104 WHEN 13 THEN 10 WHEN 14 THEN 11 WHEN 15 THEN 13 WHEN 16 THEN 19 WHEN 17 THEN 1
            WHEN 18 THEN 4768 ELSE 4769 END END""",
        "src_ip": "CASE WHEN event_id % 6 = 0 THEN concat('8.8.', user_id % 200, '.8') ELSE concat('10.0.', user_id % 30, '.5') END",
        "login": "CASE user_id % 6 WHEN 0 THEN 'SYSTEM' WHEN 1 THEN 'host$' ELSE concat('u', user_id % 20) END",
        "f_logon": "CASE event_id % 3 WHEN 0 THEN '10' WHEN 1 THEN '3' ELSE '2' END",
        "f_group": "CASE event_id % 40 WHEN 1 THEN 'Administrators' ELSE 'Users' END",
        "f_ticket": "CASE event_id % 2 WHEN 0 THEN '0x17' ELSE '0x12' END",
        "f_parent": "CASE user_id % 3 WHEN 0 THEN 'C:/Office/WINWORD.EXE' WHEN 1 THEN 'C:/srv/w3wp.exe' ELSE 'C:/explorer.exe' END",
        "f_child": "CASE user_id % 2 WHEN 0 THEN 'C:/Windows/cmd.exe' ELSE 'C:/app/tool.exe' END",
        "f_script": "CASE event_id % 5 WHEN 0 THEN 'iex FromBase64String(x)' WHEN 1 THEN '[Ref] AmsiUtils' WHEN 2 THEN 'Net.WebClient DownloadString' ELSE 'Get-Item' END",
        "f_service": "CASE event_id % 3 WHEN 0 THEN 'C:/x/PowerShell -nop' ELSE 'C:/svc.exe' END",
        "f_command": "CASE user_id % 3 WHEN 0 THEN 'certutil -urlcache http' WHEN 1 THEN 'vssadmin delete shadows' ELSE 'whoami' END",
        "f_source": "CASE user_id % 2 WHEN 0 THEN 'C:/Windows/svchost.exe' ELSE 'C:/t/dump.exe' END",
        "f_target": """CASE WHEN event_id % 3 = 0 THEN concat('HKLM', chr(92), 'software', chr(92), 'microsoft', chr(92), 'Windows', chr(92), 'CurrentVersion', chr(92), 'Run', chr(92), 'x')
            WHEN event_id % 3 = 1 THEN concat('C:', chr(92), 'Users', chr(92), 'bob', chr(92), 'AppData', chr(92), 'Local', chr(92), 'Temp', chr(92), 'a.exe') ELSE 'HKCU' END""",
    },
    {
        "channel": "CASE WHEN win_id IN (1, 10, 11, 13, 19) THEN 'Microsoft-Windows-Sysmon/Operational' ELSE 'Security' END",
        "message": "''",
        "computer": "'host'",
    },
)
_DATA = {
    "LogonType": "f_logon", "TargetUserName": "f_group", "TicketEncryptionType": "f_ticket", "ParentProcessName": "f_parent", "NewProcessName": "f_child", "ScriptBlockText": "f_script",
    "ImagePath": "f_service", "CommandLine": "f_command", "SourceImage": "f_source", "TargetObject": "f_target", "TargetFilename": "f_target", "WorkstationName": "login",
}


def events(spark, sf) -> DataFrame:
    rows = WIN.spark(spark, sf)
    pairs = [x for k, c in _DATA.items() for x in (F.lit(k), F.col(c))]
    pairs += [F.lit("TargetImage"), F.lit("C:/Windows/System32/lsass.exe"), F.lit("Properties"), F.concat(F.lit("x "), F.lit(rules.REPLICATION[0]))]
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"), "us", "channel", F.col("win_id").alias("event_id"), "record_id", "computer",
        F.col("login").alias("user"), "src_ip", "message", F.create_map(*pairs).alias("data"), "src_file", "line_no",
    )


_W = WIN.sql("w")
_GLOBAL = "starts_with(src_ip, '8.8.')"
_SYSMON = "contains(channel, 'Sysmon')"
_BASE = lambda c: f"regexp_extract(lower({c}), '[^/]*$')"
_RULES = {
    "R-WIN-003": f"win_id = 4624 AND f_logon = '10' AND {_GLOBAL}",
    "R-WIN-016": f"win_id = 4624 AND f_logon = '3' AND {_GLOBAL}",
    "R-WIN-004": "win_id = 4720",
    "R-WIN-005": f"win_id = 4732 AND lower(f_group) IN {any_of(*rules.ADMIN_GROUPS)}",
    "R-WIN-006": f"win_id = 4672 AND lower(login) NOT IN {any_of(*rules.SERVICE_USERS)} AND NOT ends_with(login, '$')",
    "R-WIN-007": "win_id = 1102",
    "R-WIN-008": "win_id = 4698",
    "R-WIN-015": "win_id = 4662",
    "R-WIN-012": f"win_id IN (4768, 4769) AND f_ticket IN {any_of(*rules.WEAK_TICKETS)}",
    "R-WIN-009": "win_id = 7045 AND contains(lower(f_service), 'powershell')",
    "R-WIN-010": f"win_id = 4688 AND {_BASE('f_parent')} IN {any_of(*rules.MACRO_PARENTS)} AND {_BASE('f_child')} IN {any_of(*rules.SHELLS)}",
    "R-WIN-011": f"win_id = 4688 AND {_BASE('f_parent')} IN {any_of(*rules.WEB_PARENTS)} AND {_BASE('f_child')} IN {any_of(*rules.SHELLS)}",
    "R-WIN-017": "win_id = 4104 AND contains(f_script, 'FromBase64String')",
    "R-WIN-018": "win_id = 4104 AND contains(f_script, 'AmsiUtils')",
    "R-WIN-019": "win_id = 4104 AND contains(f_script, 'Net.WebClient')",
    "R-WIN-020": f"{_SYSMON} AND win_id = 10 AND {_BASE('f_source')} NOT IN {any_of(*rules.LSASS_READERS)}",
    "R-WIN-021": f"{_SYSMON} AND win_id = 11 AND {matches('f_target', rules.TEMP_PROGRAM)}",
    "R-WIN-022": f"{_SYSMON} AND win_id IN (19, 20, 21)",
}


@query("win_event_rules", f"WITH {_W} " + " UNION ALL ".join(f"SELECT line_no, {q(r)} AS rule_id FROM w WHERE {c}" for r, c in _RULES.items()))
def win_event_rules(spark, sf):
    from huntframe.operators.findings import hits

    found = hits(events(spark, sf), rules.branches())
    return found.where("rule_id <> 'R-WIN-024'").select("line_no", "rule_id")


_PLACE = "CASE " + " ".join(f"WHEN contains(lower(f_target), {q(p[2].lower())}) THEN {q(p[0])}" for p in PERSISTENCE) + " END"


@query("win_persistence", f"WITH {_W} SELECT line_no, {_PLACE} AS persist_id FROM w WHERE {_SYSMON} AND win_id IN (11, 12, 13) AND {_PLACE} IS NOT NULL")
def win_persistence(spark, sf):
    from huntframe.operators.findings import hits

    found = hits(events(spark, sf), rules.branches()).where("rule_id = 'R-WIN-024'")
    return found.select("line_no", F.get_json_object("extra", "$.persist_id").alias("persist_id"))


_LEVELS = {r[0]: rules.SIGNATURE_LEVELS[r[4]] for r in rules.SYSMON_RULES}
_TELEMETRY = " UNION ALL ".join(
    f"SELECT line_no, {q(r[0])} AS sig_id, {q(_LEVELS[r[0]])} AS severity FROM w WHERE {_SYSMON} AND win_id = {r[1]} AND {matches('f_command', r[3])}"
    for r in rules.SYSMON_RULES
    if r[2] == "CommandLine"
)


@query("win_sysmon_rules", f"WITH {_W} {_TELEMETRY}")
def win_sysmon_rules(spark, sf):
    found = rules.telemetry_rules(events(spark, sf))
    return found.select("line_no", F.get_json_object("extra", "$.sig_id").alias("sig_id"), "severity")


@query(
    "win_parent_child",
    f"""WITH {_W} SELECT line_no, {_BASE('f_parent')} AS parent, {_BASE('f_child')} AS child FROM w WHERE win_id = 4688 AND {_BASE('f_child')} = 'cmd.exe'
    AND {_BASE('f_parent')} IN ('winword.exe', 'w3wp.exe')""",
)
def win_parent_child(spark, sf):
    from huntframe.operators.findings import hits

    found = hits(events(spark, sf), rules.branches()).where("rule_id IN ('R-WIN-010', 'R-WIN-011')")
    return found.select("line_no", F.get_json_object("extra", "$.parent").alias("parent"), F.get_json_object("extra", "$.child").alias("child"))


#: The state machine as it reads: one step a record, for every address at once.
_STATE = f"""WITH RECURSIVE {_W},
c AS (SELECT src_ip, us, line_no, win_id, CASE WHEN win_id = 4625 THEN {queue_sql('src_ip, win_id', WINDOW)} END AS n FROM w WHERE win_id IN (4624, 4625)),
t AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY us, line_no) AS k FROM c WHERE win_id = 4624 OR n >= {ROWS}),
s AS (
  SELECT src_ip, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS armed, CAST(NULL AS BIGINT) AS line_no, CAST(NULL AS VARCHAR) AS rule_id FROM (SELECT DISTINCT src_ip FROM t)
  UNION ALL
  SELECT t.src_ip, t.k,
    CASE WHEN t.win_id = 4625 THEN coalesce(s.armed, t.us) WHEN s.armed IS NOT NULL AND t.us - s.armed <= {GRACE} THEN NULL ELSE s.armed END,
    t.line_no,
    CASE WHEN t.win_id = 4625 AND s.armed IS NULL THEN 'R-WIN-001' WHEN t.win_id = 4624 AND s.armed IS NOT NULL AND t.us - s.armed <= {GRACE} THEN 'R-WIN-002' END
  FROM s JOIN t ON t.src_ip = s.src_ip AND t.k = s.k + 1)
SELECT src_ip, line_no, rule_id FROM s WHERE rule_id IS NOT NULL"""


@query("win_brute_state", _STATE)
def win_brute_state(spark, sf):
    armed, won = rules.brute_state(events(spark, sf), WINDOW, ROWS, GRACE)
    name = lambda df, r: df.select("src_ip", "line_no", F.lit(r).alias("rule_id"))
    return name(armed, "R-WIN-001").unionByName(name(won, "R-WIN-002"))


def _burst_sql(key: str, where: str, rows: int) -> str:
    return (
        f"WITH {_W} SELECT {key} AS k, line_no, n FROM (SELECT *, {queue_sql(key, WINDOW)} AS n FROM w WHERE {where}) "
        f"WHERE n >= {rows} QUALIFY row_number() OVER (PARTITION BY k ORDER BY us, line_no) = 1"
    )


@query("win_ticket_burst", _burst_sql("login", "win_id = 4769", 4))
def win_ticket_burst(spark, sf):
    return rules.many_tickets(events(spark, sf), WINDOW, 4).select(F.col("account").alias("k"), "line_no", "n")


@query("win_preauth_burst", _burst_sql("src_ip", "win_id = 4771", 2))
def win_preauth_burst(spark, sf):
    return rules.many_preauth_failures(events(spark, sf), WINDOW, 2).select(F.col("source").alias("k"), "line_no", "n")


@query(
    "win_combos",
    f"""WITH {_W}, a AS (SELECT src_ip, us, line_no FROM w WHERE win_id = 4624 AND f_logon = '3')
    SELECT a.line_no AS logon_line, min(b.line_no) AS service_line FROM a JOIN w b ON b.src_ip = a.src_ip AND b.win_id = 7045 AND b.us > a.us AND b.us - a.us <= {WINDOW} GROUP BY a.line_no""",
)
def win_combos(spark, sf):
    from huntframe.operators.playbooks import followed_by

    rows = events(spark, sf)
    logon = rows.where((F.col("event_id") == 4624) & (rules.field("LogonType") == "3"))
    service = rows.where("event_id = 7045")
    return followed_by(logon, service, ["src_ip"], WINDOW, "line_no").select(F.col("line_no").alias("logon_line"), F.col("next").alias("service_line"))
