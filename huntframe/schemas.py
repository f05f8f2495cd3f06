"""Schemas of the records, as DDL."""

from __future__ import annotations

LOG = (
    "ts string, log_type string, src_ip string, dst_ip string, user string, method string, uri string, status int, "
    "ua string, msg string, raw_line string, line_no bigint, src_file string"
)

ALERT = (
    "ts string, src_ip string, dst_ip string, dst_port string, proto string, rule_name string, severity string, payload string, "
    "user_agent string, username string, hostname string, action string, category string, vendor string, _raw_keys array<string>"
)

WINEVT = (
    "ts timestamp, channel string, event_id int, record_id bigint, computer string, user string, src_ip string, message string, "
    "data map<string,string>"
)

#: Every view's fields in one nullable struct; tables of it are best partitioned by ``view``.
RAW = (
    "host string, method string, uri string, status int, ua string, referer string, content_type string, content_length int, "
    "request_line_excerpt string, qname string, qtype string, rcode int, response_ip string, payload_len bigint, answer_len bigint, "
    "ttl bigint, sni string, cert_cn string, cert_issuer string, version string, cipher string, ja3 string, ja3s string, alpn string, "
    "cert_not_before string, cert_not_after string, tls_extensions string, http_version string, session_id_empty boolean, "
    "session_ticket_empty boolean, alert_level string, ua_hint string, duration_s double, bytes_total bigint, packets_total bigint, "
    "bytes_a2b bigint, bytes_b2a bigint, packets_a2b bigint, packets_b2a bigint, rel_start double, payload_first_bytes string, "
    "auth_type string, username string, password_masked string, seq bigint, ack bigint, flags string, length int"
)
FLOWREC = (
    "ts string, view string, src_ip string, dst_ip string, src_port int, dst_port int, proto string, stream_id bigint, "
    f"raw struct<{RAW.replace(' ', ':').replace(',:', ',')}>, src_file string, line_no bigint"
)

IOC = "type string, value string, confidence string, first_seen string, source string, tag string"
FINDING = (
    "id string, severity string, category string, evidence string, rule_id string, false_positive_prob double, "
    f"recommended_action string, iocs array<struct<{IOC.replace(' ', ':').replace(',:', ',')}>>"
)

#: ``cmd_tier`` is the writer's name of ``tier``; both are accepted.
AUDIT = (
    "ts string, action string, target string, user string, port int, proxy_jump string, cmd_id string, tier int, cmd_tier int, "
    "cmd_expanded string, cmd_expanded_sha256 string, effective_os string, authorized_by string, allow_mutating boolean, "
    "auth_method string, auth_source string, dry_run boolean, session_log string, audit_log_version string, desensitized boolean, "
    "exit_code int, stdout_bytes bigint, stderr_bytes bigint, duration_ms bigint, error string, error_hint string"
)
