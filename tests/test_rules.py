"""Rules on hand-made records, with the sets worked out by hand."""

from __future__ import annotations

import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from huntframe import schemas
from huntframe.rules import auth, ngx, traffic, win
from huntframe.rules.catalog import RULES

START = datetime(2026, 7, 1, 10)


def log(spark, records):
    names = [f.split(" ")[0] for f in schemas.LOG.split(", ")]
    base = {"src_file": "f", "log_type": "x"}
    full = [{**base, "line_no": i, **r} for i, r in enumerate(records, 1)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schemas.LOG)


def at(seconds):
    return (START + timedelta(seconds=seconds)).isoformat()


def test_catalogue():
    assert len(RULES) == 111
    assert {r.severity for r in RULES.values()} <= {"P0", "P1", "P2", "P3"}
    assert all(r.action for r in RULES.values())


@pytest.mark.parametrize(
    "rule,yes,no",
    [
        ("R-NGX-003", {"uri": "/.git/config"}, {"uri": "/git"}),
        ("R-NGX-004", {"uri": "/" + "a" * 1000}, {"uri": "/" + "a" * 999}),
        ("R-NGX-005", {"method": "propfind"}, {"method": "GET"}),
        ("R-NGX-006", {"uri": "/a/%2e%2e/b"}, {"uri": "/a..b"}),
        ("R-NGX-007", {"uri": "/?q=1 UNION ALL SELECT 2"}, {"uri": "/union"}),
        ("R-NGX-008", {"uri": "/?x=${jndi:ldap}"}, {"uri": "/jndi"}),
        ("R-NGX-009", {"raw_line": '"GET / HTTP/1.1" 200 10485761 "-"'}, {"raw_line": '"GET / HTTP/1.1" 200 10485760 "-"'}),
        ("R-NGX-010", {"ua": "abcd"}, {"ua": "abcde"}),
        ("R-NGX-010", {"ua": "!!!!!!"}, {"ua": "!!!!!a"}),
        ("R-NGX-010", {"ua": None}, {"ua": "Mozilla"}),
        ("R-NGX-001", {"ua": "x sqlmap/1.7"}, {"ua": "Mozilla/5.0"}),
    ],
)
def test_web_rules(spark, rule, yes, no):
    plain = {"ua": "Mozilla/5.0", "method": "GET", "uri": "/", "status": 200, "src_ip": "1.2.3.4", "ts": at(0)}
    found = ngx.detect(log(spark, [plain | yes, plain | no])).where(F.col("rule_id") == rule).collect()
    assert [r.line_no for r in found] == [1]


@pytest.mark.parametrize("n,gap,found", [(50, 0, 1), (49, 0, 0), (50, 1, 0)])
def test_web_burst_borders(spark, n, gap, found):
    rows = [{"ts": at(0), "src_ip": "1.1.1.1", "status": 404, "ua": "Mozilla", "uri": "/"}] + [
        {"ts": at(300 + gap), "src_ip": "1.1.1.1", "status": 404, "ua": "Mozilla", "uri": "/"} for _ in range(n - 1)
    ]
    assert ngx.detect(log(spark, rows)).where("rule_id = 'R-NGX-002'").count() == found


def test_findings_are_numbered_in_order_and_valid_json(spark):
    rows = [{"ts": at(i), "src_ip": "1.1.1.1", "status": 200, "ua": "-", "uri": "/.env", "method": "GET"} for i in range(3)]
    found = ngx.findings(log(spark, rows)).orderBy("id").collect()
    assert [r.id for r in found] == [f"NGX-{i:03d}" for i in range(1, 7)]
    assert [r.rule_id for r in found] == ["R-NGX-003", "R-NGX-010"] * 3
    assert json.loads(found[0].evidence)["uri"] == "/.env"
    assert found[0].iocs[0]["value"] == "1.1.1.1" and found[0].false_positive_prob == 0.3


def ssh(seconds, ok=False, ip="9.9.9.9", user="bob", msg=None):
    return {"ts": at(seconds), "src_ip": ip, "user": user, "msg": msg or ("ssh-success password" if ok else "ssh-fail password")}


def rules_of(df):
    return Counter(r.rule_id for r in df.select("rule_id").collect())


@pytest.mark.parametrize(
    "records,want",
    [
        ([ssh(i) for i in range(20)], {"R-AUTH-001": 1}),
        ([ssh(i) for i in range(19)], {}),
        ([ssh(i) for i in range(20)] + [ssh(1800, True), ssh(1815, True)], {"R-AUTH-001": 1, "R-AUTH-002": 2, "R-AUTH-006": 1}),
        ([ssh(i) for i in range(20)] + [ssh(1900, True)], {"R-AUTH-001": 1, "R-AUTH-006": 1}),
        ([ssh(i) for i in range(5)] + [ssh(10, True)], {"R-AUTH-002": 1, "R-AUTH-006": 1}),
        ([ssh(i) for i in range(5)] + [ssh(301, True)], {"R-AUTH-006": 1}),
        ([ssh(0, True, "1.1.1.1", "root"), ssh(1, True, "1.1.1.2", "root"), ssh(2, True, "1.1.2.1", "root")], {"R-AUTH-003": 1, "R-AUTH-006": 1}),
        ([ssh(0, msg="userdel[9]: delete user 'temp'", user=None), ssh(5, True, user="temp")], {"R-AUTH-006": 1, "R-AUTH-007": 1}),
        ([ssh(5, True, user="temp"), ssh(9, msg="userdel[9]: delete user 'temp'", user=None)], {"R-AUTH-006": 1}),
        ([ssh(0, msg="useradd[3]: new user: name=eve, UID=0")], {"R-AUTH-004": 1}),
        ([ssh(i, msg="sudo: x ; COMMAND=/bin/ls") for i in range(10)], {"R-AUTH-005": 1}),
        ([ssh(i, msg="sudo: x ; COMMAND=/bin/ls") for i in range(9)], {}),
    ],
)
def test_login_rules(spark, records, want):
    assert rules_of(auth.detect(log(spark, records))) == want


def test_keys_without_baseline(spark):
    records = [ssh(0, msg="ssh-success publickey", user="a"), ssh(1, msg="ssh-success publickey", user="b"), ssh(2, True, user="c")]
    found = auth.detect(log(spark, records), spark.createDataFrame([("a",)], "user string"))
    assert [r.user for r in found.where("rule_id = 'R-AUTH-008'").collect()] == ["b"]


def test_ipv6_subnets(spark):
    records = [ssh(0, True, "2001:db8::1", "root"), ssh(1, True, "2001:db8::2", "root"), ssh(2, True, "2001:db8:0:1::1", "root")]
    found = auth.detect(log(spark, records)).where("rule_id = 'R-AUTH-003'").collect()
    assert [json.loads(r.extra)["new_subnet"] for r in found] == ["2001:db8:0:1::/64"]


SYSMON = "Microsoft-Windows-Sysmon/Operational"


def events(spark, rows):
    full = []
    for n, (seconds, channel, eid, data) in enumerate(rows):
        user = data.get("TargetUserName") or data.get("SubjectUserName")
        full.append((START + timedelta(seconds=seconds), channel, eid, 100 + n, "host", user, data.get("IpAddress"), "", data, "e", n))
    return spark.createDataFrame(full, schemas.WINEVT + ", src_file string, line_no bigint")


def windows_fixture():
    login = {"IpAddress": "203.0.113.5", "TargetUserName": "administrator"}
    return [
        *[(i, "Security", 4625, login) for i in range(22)],
        (60, "Security", 4624, login | {"LogonType": "10"}),
        (120, "Security", 4720, {"TargetUserName": "hacker$"}),
        (180, "Security", 1102, {"SubjectUserName": "administrator"}),
        (240, "Security", 4688, {"NewProcessName": r"C:\Windows\powershell.exe", "ParentProcessName": r"C:\Office\WINWORD.EXE", "CommandLine": "powershell"}),
        (300, "Microsoft-Windows-PowerShell/Operational", 4104, {"ScriptBlockText": "IEX ([Convert]::FromBase64String('x'))"}),
        (360, SYSMON, 1, {"CommandLine": "certutil -urlcache -f http://x", "Image": "certutil.exe"}),
        (420, SYSMON, 13, {"TargetObject": r"HKLM\SOFTWARE\Microsoft\Windows\CurrentVersion\Run\backdoor"}),
    ]


def test_windows_fixture(spark):
    rule = [("X-1", 1, "CommandLine", "certutil.*urlcache", "high", "x")]
    place = [("P-1", "run-key", r"SOFTWARE\Microsoft\Windows\CurrentVersion\Run", "registry")]
    found = win.findings(events(spark, windows_fixture()), rules=rule, places=place).orderBy("id").collect()
    assert [r.rule_id for r in found] == [f"R-WIN-{n}" for n in ("001", "002", "004", "007", "010", "017", "023", "024")]
    assert [r.id for r in found] == [f"IR-WIN-{i:03d}" for i in range(1, 9)]
    first = json.loads(found[0].evidence)
    assert first["record_id"] == 119 and json.loads(first["rule"])["fail_count_60s"] == 20
    assert json.loads(found[1].evidence)["record_id"] == 122 and found[6].severity == "P1"


def test_windows_brute_state_rearms(spark):
    login = {"IpAddress": "10.0.0.9", "TargetUserName": "x"}
    fails = lambda s: [(s + i, "Security", 4625, login) for i in range(20)]
    win_at = lambda s: (s, "Security", 4624, login)
    rows = [*fails(0), win_at(30), win_at(40), *fails(100), win_at(150), *fails(1000), win_at(1000 + 3600), *fails(9000), win_at(9050)]
    found = win.detect(events(spark, rows)).where("rule_id IN ('R-WIN-001', 'R-WIN-002')").orderBy("us")
    # The fourth log-in comes too late, which leaves the address armed for good.
    assert [r.rule_id[-1] for r in found.collect()] == ["1", "2", "1", "2", "1"]


@pytest.mark.parametrize(
    "rule,yes,no",
    [
        ("R-WIN-003", (4624, {"LogonType": "10", "IpAddress": "8.8.8.8"}), (4624, {"LogonType": "10", "IpAddress": "203.0.113.5"})),
        ("R-WIN-016", (4624, {"LogonType": "3", "IpAddress": "8.8.8.8", "WorkstationName": "WS"}), (4624, {"LogonType": "3", "IpAddress": "8.8.8.8", "WorkstationName": " "})),
        ("R-WIN-005", (4732, {"TargetUserName": "Administratoren"}), (4732, {"TargetUserName": "Users"})),
        ("R-WIN-006", (4672, {"SubjectUserName": "bob"}), (4672, {"SubjectUserName": "HOST$"})),
        ("R-WIN-009", (7045, {"ImagePath": "C:\\x\\PowerShell.exe -EncodedCommand"}), (7045, {"ImagePath": "C:\\svc.exe"})),
        ("R-WIN-012", (4769, {"TicketEncryptionType": "0x17"}), (4769, {"TicketEncryptionType": "0x12"})),
        ("R-WIN-015", (4662, {"Properties": "%{1131F6AA-9C07-11D1-F79F-00C04FC2DCD2}"}), (4662, {"Properties": "{0}"})),
        ("R-WIN-011", (4688, {"NewProcessName": "cmd.exe", "ParentProcessName": "w3wp.exe"}), (4688, {"NewProcessName": "cmd.exe", "ParentProcessName": "explorer.exe"})),
    ],
)
def test_windows_rules(spark, rule, yes, no):
    found = win.detect(events(spark, [(0, "Security", *yes), (1, "Security", *no)])).where(F.col("rule_id") == rule).collect()
    assert [r.line_no for r in found] == [0]


def test_windows_sysmon_rules(spark):
    rows = [
        (0, SYSMON, 10, {"TargetImage": r"C:\Windows\System32\lsass.exe", "SourceImage": r"C:\t\dump.exe"}),
        (1, SYSMON, 10, {"TargetImage": r"C:\Windows\System32\lsass.exe", "SourceImage": r"C:\w\MsMpEng.exe"}),
        (2, SYSMON, 11, {"TargetFilename": r"C:\Users\bob\AppData\Local\Temp\x.EXE"}),
        (3, SYSMON, 20, {}),
        (4, "Security", 20, {}),
    ]
    found = win.detect(events(spark, rows)).orderBy("line_no").collect()
    assert [(r.rule_id, r.line_no) for r in found] == [("R-WIN-020", 0), ("R-WIN-021", 2), ("R-WIN-022", 3)]


def flow_rows(spark, records):
    raw_names = [f.split(" ")[0] for f in schemas.RAW.split(", ")]
    names = [f.split(" ")[0] for f in schemas.FLOWREC.split(", ")[:8]]
    out = []
    for i, r in enumerate(records, 1):
        raw = tuple(r["raw"].get(n) for n in raw_names)
        out.append((*[r.get(n) for n in ("ts", "view", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "stream_id")], raw, "f", i))
    assert len(names) == 8
    return spark.createDataFrame(out, schemas.FLOWREC)


def traffic_fixture():
    rows = [
        {"ts": at(0), "view": "tls", "src_ip": "10.0.0.5", "dst_ip": "203.0.113.10", "dst_port": 443, "raw": {"sni": "cdn.example.com", "host": "cdn.example.com", "cert_cn": "Major Cobalt Strike", "cert_issuer": "Major Cobalt Strike", "cipher": "TLS_AES_128", "ja3": "72a589da586844d7f0818ce684948eea", "alpn": "h2"}},
        {"ts": at(1), "view": "http", "src_ip": "192.0.2.10", "dst_ip": "10.0.0.100", "dst_port": 80, "raw": {"method": "POST", "uri": "/upload/index.jsp", "request_line_excerpt": "e45e329feb5d925b"}},
        {"ts": at(2), "view": "http", "src_ip": "192.0.2.11", "dst_ip": "10.0.0.101", "dst_port": 80, "raw": {"method": "POST", "uri": "/suo5", "request_line_excerpt": "X-Suo5-Ver: 1"}},
        {"ts": at(3), "view": "http", "src_ip": "192.0.2.12", "dst_ip": "10.0.0.102", "dst_port": 80, "raw": {"method": "POST", "uri": "/tunnel.jsp", "request_line_excerpt": "X-CMD: CONNECT"}},
        {"ts": at(4), "view": "tls", "src_ip": "192.0.2.13", "dst_ip": "198.51.100.5", "dst_port": 443, "raw": {"sni": "viper.example", "host": "viper.example", "cert_cn": "Sliver", "cipher": "ECDHE-SM2-SM4", "ja3s": "ec74a5c51106f0419184d0dd08fb05bc", "alpn": "h2"}},
    ]
    for i in range(40):
        name = "abcdef1234567890" * 3 + f"{i:04d}.tunnel.example.com"
        rows.append({"ts": at(10 + 3 * i), "view": "dns", "src_ip": "10.0.0.7", "dst_ip": "8.8.8.8", "dst_port": 53, "raw": {"qname": name, "qtype": "TXT", "rcode": 0, "payload_len": 512}})
    return rows


def test_traffic_fixture(spark):
    flows = flow_rows(spark, traffic_fixture())
    found = traffic.detect(flows, signatures=[])
    rows = found.select("rule_id", "line_no").collect()
    assert len(rows) == 114
    assert {r.rule_id for r in rows if r.line_no == 1} == {"R-TRAF-050", "R-TRAF-054", "R-TRAF-064"}
    assert {r.rule_id for r in rows if r.line_no == 2} == {"R-TRAF-012", "R-TRAF-085"}
    assert {r.rule_id for r in rows if r.line_no == 3} == {"R-TRAF-095"}
    assert {r.rule_id for r in rows if r.line_no == 4} == {"R-TRAF-096"}
    assert {r.rule_id for r in rows if r.line_no == 5} == {"R-TRAF-052", "R-TRAF-054", "R-TRAF-056", "R-TRAF-064", "R-TRAF-089"}
    dns = Counter(r.rule_id for r in rows if r.line_no > 5)
    assert dns == {"R-TRAF-006": 40, "R-TRAF-005": 20, "R-TRAF-070": 1, "R-TRAF-073": 1, "R-TRAF-076": 40}
    assert [r.line_no - 6 for r in rows if r.rule_id == "R-TRAF-070"] == [19]
    assert [r.line_no - 6 for r in rows if r.rule_id == "R-TRAF-073"] == [29]
    strict = {r.src_ip: r for r in traffic.correlated(found).collect()}
    assert {k: len(r.rules) for k, r in strict.items()} == {"10.0.0.5": 3, "192.0.2.13": 5, "10.0.0.7": 5}
    assert [k for k, r in strict.items() if r.apt_suspect] == ["192.0.2.13"]
    assert strict["192.0.2.13"].clusters == ["tls-deep", "cn-redteam"]
    assert traffic.correlated(found, compat="last").count() == 0
    assert traffic.findings(flows, []).count() == 117


def test_signature_tables_choose_their_rule():
    assert traffic.signature_rule("flow", "lateral", "PsExec-like") == "R-TRAF-102"
    assert traffic.signature_rule("flow", "tunnel", "nps") == "R-TRAF-202"
    assert traffic.signature_rule("dns", "c2", "dga-x") == "R-TRAF-005"
    assert traffic.signature_rule("tls", "tunnel", "frp") == "R-TRAF-201"
    assert traffic.signature_rule("http", "unknown", "x") is None


def test_flow_rules(spark):
    base = {"view": "flow", "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2"}
    rows = [
        base | {"dst_port": 4444, "raw": {"duration_s": 301.0}},
        base | {"dst_port": 4444, "raw": {"duration_s": 300.0}},
        base | {"dst_port": 9, "raw": {"bytes_a2b": 50 * 1024 * 1024 + 1, "duration_s": 61.0}},
        base | {"dst_port": 9, "raw": {"packets_total": 101, "duration_s": 1801.0, "bytes_total": 20199}},
        base | {"dst_port": 445, "raw": {}},
    ]
    rows += [base | {"src_ip": f"10.0.1.{i}", "dst_ip": "10.9.9.9", "dst_port": 3389, "raw": {"rel_start": float(i)}} for i in range(6)]
    found = {(r.rule_id, r.line_no) for r in traffic.detect(flow_rows(spark, rows), []).select("rule_id", "line_no").collect()}
    assert found == {("R-TRAF-008", 1), ("R-TRAF-010", 3), ("R-TRAF-011", 4), ("R-TRAF-098", 4), ("R-TRAF-101", 5), ("R-TRAF-103", 10)}


def test_empty_inputs(spark):
    assert ngx.findings(log(spark, [])).count() == 0
    assert auth.findings(log(spark, [])).count() == 0
    assert win.findings(events(spark, [])).count() == 0
    assert traffic.findings(flow_rows(spark, [])).count() == 0
