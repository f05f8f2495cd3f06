"""Readers and normalisers on small files."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from huntframe import schemas
from huntframe.functions.time import access_time, bucket_seconds, epoch_time, in_time_window, parsed, syslog_time
from huntframe.operators import report
from huntframe.sources import libraries, logs, vendor, views, winevt

ACCESS = '192.168.1.10 - - [30/Jun/2026:10:15:23 +0800] "GET /api/user HTTP/1.1" 200 1532 "-" "Mozilla/5.0"'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "site").mkdir()
    (tmp_path / "site/access.log").write_text(f"{ACCESS}\n\nbroken\n" + json.dumps({"time": "t", "client_ip": "1.1.1.1", "status": "0", "uri": "/x"}) + "\n")
    with gzip.open(tmp_path / "site/auth.log.gz", "wt") as f:
        f.write("Oct 10 13:55:36 h sshd[7]: Failed password for invalid user bob from 9.9.9.9 port 22 ssh2\n")
        f.write("Oct  1 13:55:36 h sudo: alice : TTY=pts/0 ; COMMAND=/bin/ls\n")
    (tmp_path / "alert.json").write_text('{"type": "x", "src": "8.8.8.8", "name": "n", "status": "500"}\n')
    return tmp_path


def test_folder_of_logs(spark, folder):
    got = {(r.src_file.rsplit("/", 1)[-1], r.line_no): r for r in logs.read_logs(spark, str(folder), 2026).collect()}
    assert sorted(got) == [("access.log", 1), ("access.log", 4), ("alert.json", 1), ("auth.log.gz", 1), ("auth.log.gz", 2)]
    first = got["access.log", 1]
    assert (first.ts, first.src_ip, first.user, first.method, first.uri, first.status, first.msg) == ("2026-06-30T10:15:23+08:00", "192.168.1.10", None, "GET", "/api/user", 200, "GET /api/user 200")
    assert first.raw_line == ACCESS
    assert got["access.log", 4].status is None and json.loads(got["access.log", 4].msg) == {"method": None, "uri": "/x", "status": None}
    assert (got["auth.log.gz", 1].msg, got["auth.log.gz", 1].user, got["auth.log.gz", 1].ts) == ("ssh-fail password", "bob", "2026-10-10T13:55:36")
    assert (got["auth.log.gz", 2].user, got["auth.log.gz", 2].ts) == ("alice", "2026-10-01T13:55:36")
    assert (got["alert.json", 1].src_ip, got["alert.json", 1].status, got["alert.json", 1].msg) == ("8.8.8.8", 500, "n")


def test_line_numbers_of_a_file_in_pieces(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        lines = logs.read_lines(spark, str(tmp_path / "big.log"))
        assert lines.where(F.col("value") != F.concat(F.lit("line "), F.col("line_no"))).count() == 0
        assert lines.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lines_are_numbered_and_typed_without_a_shuffle(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(f"line {i}" for i in range(1, 3000)))
    (tmp_path / "access.log").write_text("x\n")
    typed = logs.with_log_type(logs.read_lines(spark, str(tmp_path)))
    typed.collect()
    plan = typed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan and "BroadcastExchange" in plan
    assert typed.count() == 3000


@pytest.mark.parametrize(
    "text,n",
    [('[{"a": "1"}, {"a": "2"}]', 2), ('{"data": [{"a": "1"}], "x": 1}', 1), ('{"a": "1"}', 1), ("﻿[{}]", 1), ("nothing", 0), ("", 0), ("[]", 0)],
)
def test_json_wrappers(spark, text, n):
    got = logs.json_objects(spark.createDataFrame([("f", text)], "src_file string, value string")).collect()
    assert [r.line_no for r in got] == list(range(1, n + 1))


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('time,clientip,message\n2026,1.1.1.1,"a, ""b"""\n2027,,c\n')
    got = logs.alerts(logs.read_csv_files(spark, str(tmp_path / "a.csv")), "csv-alert").orderBy("line_no").collect()
    assert [(r.line_no, r.ts, r.src_ip, r.msg, r.log_type) for r in got] == [(2, "2026", "1.1.1.1", 'a, "b"', "csv-alert"), (3, "2027", None, "c", "csv-alert")]


def test_ndjson_drops_broken_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"ts": "1", "log_type": "a"}\nbad\n\n{"ts": "2", "log_type": "b"}\n')
    got = logs.read_ndjson(spark, str(tmp_path / "x.json"), log_types=["a"])
    assert [r.ts for r in got.collect()] == ["1"]


VENDOR = [
    ("qax-ngsoc", {"detect_time": "t", "attacker_ip": "203.0.113.50", "risk_level": "高危", "attack_type": "SQL注入"}, ("203.0.113.50", "sqli", "P1")),
    ("sangfor-sip", {"alarm_time": "t", "atk_src_ip": "198.51.100.10", "threat_level": "高危", "event_name": "Fastjson利用"}, ("198.51.100.10", "rce", "P0")),
    ("changting-safeline", {"event_time": "t", "client_ip": "203.0.113.99", "risk_level": "high", "attack_type": "命令执行"}, ("203.0.113.99", "rce", "P1")),
    ("dbappsec-mingyu", {"attack_time": "t", "attack_source_ip": "203.0.113.7", "threat_level": "致命", "attack_type_name": "WebShell上传"}, ("203.0.113.7", "webshell", "P0")),
    ("sangfor-sip", {"ALARM_TIME": "t", "threat_level": "4.0"}, (None, "其他", "P0")),
    ("sangfor-sip", {"alarm_time": "t", "threat_level": "odd"}, (None, "其他", "P2")),
]


@pytest.mark.parametrize("name,record,want", VENDOR)
def test_vendors(spark, name, record, want):
    objects = spark.createDataFrame([(record,), ({"severity": "x"},)], "obj map<string,string>")
    got = vendor.normalised(objects, name).collect()
    assert [(r.src_ip, r.category, r.severity) for r in got] == [want]
    assert got[0]._raw_keys == sorted(record) and got[0].vendor == name


def test_strict_vendor_fails_on_unknown_severity(spark):
    objects = spark.createDataFrame([({"alarm_time": "t", "threat_level": "odd"},)], "obj map<string,string>")
    with pytest.raises(Exception, match="unknown severity"):
        vendor.normalised(objects, "sangfor-sip", strict=True).collect()


def test_alerts_as_logs(spark):
    objects = spark.createDataFrame([({"alarm_time": "t", "user_agent": "sqlmap", "payload": "/x"},)], "obj map<string,string>")
    alerts = vendor.normalised(objects, "sangfor-sip")
    assert vendor.as_log(alerts).first().ua == "sqlmap"
    assert vendor.as_log(alerts, compat=True).first().ua is None


def test_windows_sources(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text(json.dumps({"ts": "2026-07-01T10:00:00", "Channel": "Security", "EventID": 4625, "EventData": {"IpAddress": "-", "TargetUserName": "u"}}) + "\nbad\n")
    got = winevt.read_jsonl(spark, str(tmp_path / "e.jsonl")).collect()
    assert [(r.event_id, r.user, r.src_ip, r.data["TargetUserName"]) for r in got] == [(4625, "u", None, "u")]
    (tmp_path / "e.csv").write_text("TimeCreated,Id,LogName,EventData.IpAddress,Message\n7/1/2026 10:00:00 AM,4624,Security,1.2.3.4,hi\n")
    row = winevt.read_csv(spark, str(tmp_path / "e.csv")).first()
    assert (row.event_id, row.src_ip, row.ts.hour, row.line_no) == (4624, "1.2.3.4", 10, 2)
    xml = '<Event><System><EventID>1102</EventID><Channel>Security</Channel><TimeCreated SystemTime="2026-07-01T10:00:00Z"/></System><EventData><Data Name="SubjectUserName">eve</Data></EventData></Event>'
    row = winevt.from_xml(spark.createDataFrame([(xml,)], "value string")).first()
    assert (row.event_id, row.user, row.channel, row.record_id) == (1102, "eve", "Security", None)


def test_event_data_pairs(spark):
    df = spark.createDataFrame([("a=1; b: two words; a=3",)], "t string")
    assert df.select(winevt.event_data(F.col("t")).alias("d")).first().d == {"a": "3", "b": "two words"}


def lines(spark, values):
    return spark.createDataFrame([("p", i, v) for i, v in enumerate(values, 1)], "src_file string, line_no long, value string")


def test_views(spark):
    http = views.http_view(views.split_rows(lines(spark, ["1751364000.5|1.1.1.1|2.2.2.2|5|80|7|get|h|/x|200|ua||t|12|" + "r" * 400]), views.FIELDS["http"]))
    row = http.first()
    assert (row.view, row.dst_port, row.stream_id, row.raw.method, row.raw.status, len(row.raw.request_line_excerpt)) == ("http", 80, 7, "GET", 200, 300)
    assert row.ts == "2025-07-01T10:00:00.500000+00:00"
    hello = views.split_rows(lines(spark, ["1|1.1.1.1|2.2.2.2|5|443|9|sni|3|c|j|"]), views.FIELDS["tls"])
    certs = views.split_rows(lines(spark, ["1|9||printable|dns", "2|9|late||"]), views.FIELDS["certificates"])
    assert views.tls_view(hello, certs).first().raw.cert_cn == "printable"
    assert views.tls_view(hello).first().raw.cert_cn is None
    flow = lines(spark, ["1.1.1.1:5 <-> 2.2.2.2:80  1 100 bytes 2 200 bytes 3 300 bytes 0.5 9.25", "no flow"])
    payload = views.split_rows(lines(spark, ["2.2.2.2|80|1.1.1.1|5|ff00616263"]), views.FIELDS["payloads"])
    raw = views.flow_view(flow, payload).first().raw
    assert (raw.packets_b2a, raw.bytes_a2b, raw.packets_total, raw.bytes_total, raw.duration_s, raw.payload_first_bytes) == (1, 200, 3, 300, 9.25, "ÿ\x00abc")
    creds = views.creds_view(views.split_rows(lines(spark, ["1|1.1.1.1|2.2.2.2|5|21|ftp|bob:s3cret"]), views.FIELDS["creds"])).first().raw
    assert (creds.username, creds.password_masked) == ("bob", "***<6>")


def test_flows_round_trip(spark, tmp_path):
    rows = views.dns_view(views.split_rows(lines(spark, ["1|1.1.1.1|2.2.2.2|5|53|q.x|16|0|"]), views.FIELDS["dns"]))
    report.write_ndjson(rows, str(tmp_path / "out"))
    got = views.read_flows(spark, str(tmp_path / "out"))
    assert got.first().raw.qname == "q.x" and views.read_flows(spark, str(tmp_path / "out"), ["http"]).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t", None), ("u", "x")], "ts string, user string")
    report.write_csv(df.coalesce(1), str(tmp_path / "csv"), ["ts", "user"])
    assert next((tmp_path / "csv").glob("part*")).read_text() == "ts,user\nt,\nu,x\n"
    report.append_audit(df, str(tmp_path / "audit"))
    report.append_audit(df, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 4


def test_libraries(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"rules": [{"id": "a", "pattern": "x"}, {"id": "b", "pattern": "("}]}))
    rows = libraries.read_rows(spark, str(tmp_path / "r.json"))
    assert libraries.as_tuples(rows, ("id", "pattern")) == (("a", "x"),)
    (tmp_path / "v.md").write_text("---\nvendor_name: v\nfield_map: {ts: [t], severity: [s]}\nseverity_map: {4: P0}\ncategory_map: {x: rce}\n---\ntext\n")
    config = libraries.read_vendor(spark, str(tmp_path / "v.md"))
    got = vendor.normalised(spark.createDataFrame([({"t": "1", "s": "4"},)], "obj map<string,string>"), config).first()
    assert (got.severity, got.vendor, got.src_ip) == ("P0", "v", None)
    (tmp_path / "b.txt").write_text("# who\nalice=SHA256:x\nbob\n\n")
    assert sorted(r.user for r in libraries.read_baseline(spark, str(tmp_path / "b.txt")).collect()) == ["alice", "bob"]


def test_times(spark):
    texts = ["2026-07-01T10:00:00Z", "2026-07-01 10:00:00", "2026-07-01T10:00:00.5+0800", "7/1/2026 1:02:03 PM", "2026", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(parsed(F.col("t")).cast("string")).collect()
    assert [r[0] for r in got] == ["2026-07-01 10:00:00", "2026-07-01 10:00:00", "2026-07-01 02:00:00.5", "2026-07-01 13:02:03", None, None, None]
    bad = spark.createDataFrame([("31/Feb/2026:10:00:00", "Feb 30 10:00:00", "x")], "a string, b string, c string")
    assert tuple(bad.select(access_time(F.col("a")), syslog_time(F.col("b"), 2026), epoch_time(F.col("c"))).first()) == (None, None, None)
    assert [bucket_seconds(s) for s in ("30s", "5m", "1h", "2d")] == [30, 300, 3600, 172800]
    with pytest.raises(ValueError, match="not a bucket"):
        bucket_seconds("5x")
    assert spark.range(1).where(in_time_window(F.lit(None).cast("timestamp"), since=None)).count() == 1


def test_schemas_parse(spark):
    for ddl in (schemas.LOG, schemas.ALERT, schemas.WINEVT, schemas.FLOWREC, schemas.FINDING, schemas.AUDIT):
        assert spark.createDataFrame([], ddl).count() == 0


def test_stored_records_are_pruned(spark, tmp_path):
    from huntframe.sources import store
    from tests.test_rules import at, log

    rows = log(spark, [{"ts": at(i), "log_type": "nginx-access" if i % 2 else "linux-auth", "uri": "/"} for i in range(10)] + [{"ts": None, "log_type": "syslog"}])
    store.write_records(rows, str(tmp_path / "t"))
    back = store.read_records(spark, str(tmp_path / "t"))
    assert back.count() == 11
    plan = back.where("log_type = 'nginx-access'").select("uri")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_type" in plan and "ReadSchema: struct<uri:string>" in plan
