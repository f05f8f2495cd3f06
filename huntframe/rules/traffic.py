"""Rules on packet views (FLOWREC): R-TRAF-001 to 012, 050 to 098, 101 to 104, 201 to 203 and 999.

Rules of one record are branches of one array, a scan for each view; rules with a memory are
operators of ``operators.windows``.  Signature tables join by (view, field).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions import text as T
from huntframe.functions.text import blank, has_any, truncated
from huntframe.functions.time import parsed
from huntframe.operators.findings import Branch, as_findings, hits, ioc, one_rule
from huntframe.operators.signatures import matching, valid
from huntframe.operators.windows import HOUR, MINUTE, burst, distinct_over, first_over, looking_back, nth_rows, numbered, running, trailing
from huntframe.rules.catalog import RULES
from huntframe.rules.ngx import TIES, timed
from huntframe.sources.store import settled

# Patterns, tables, ports and thresholds.
SCANNER_AGENT = (
    r"(?i)(sqlmap|nuclei|\bxray\b|acunetix|AWVS|nessus|nikto|dirsearch|"
    r"wpscan|fscan|masscan|nmap|pocsuite|afrog|wfuzz|\bffuf\b|hydra|"
    r"gobuster|feroxbuster|zgrab|BurpCollaborator|Burp Suite|"
    r"antSword|antsword)"
)
SENSITIVE_PATH = (
    r"(?i)/(\.git(/|$)|\.env(\.|$|/|\?)|wp-admin|wp-login|actuator(/|$)|"
    r"swagger|phpinfo\.php|phpmyadmin|console/login|manager/html|"
    r"jmx-console|web-console|\.ssh/|/etc/passwd)"
)
SQL_INJECTION = (
    r"(?i)(\bunion\s+(?:all\s+)?select\b|\bsleep\(\s*\d+\s*\)|"
    r"\bbenchmark\(\s*\d+|'\s*or\s*'?1'?\s*=\s*'?1|"
    r"\"\s*or\s*\"?1\"?\s*=\s*\"?1|"
    r"\bextractvalue\b|\bupdatexml\b|information_schema)"
)
CODE_EXECUTION = (
    r"(?i)(\$\{jndi:|Runtime\.getRuntime|java\.lang\.Runtime|ProcessBuilder|"
    r"@type[\"']?\s*:\s*[\"']?com\.|TemplatesImpl|fastjson|"
    r"cmd\.exe|/bin/(?:sh|bash)\b|/etc/passwd|/proc/self|"
    r"[?&](?:cmd|exec|command|c)=(?:cat|ls|whoami|id|uname|wget|curl|nc|bash|sh)\b|"
    r"\(\)\s*\{\s*:;\s*\})"
)
WEBSHELL_KEY = (
    r"(?i)(3c6e0b8a9c15224a|e45e329feb5d925b|antSword|antsword|"
    r"pass=@eval|pass=@assert|/(?:shell|c99|r57|wso|b374k)\.(?:php|jsp|aspx))"
)
LISTENER_PORTS = (4444, 1337, 8888, 13337, 6666, 7777, 31337)
SMB_PORTS, RDP_PORT, FRP_PORTS, NPS_PORTS, RESOLVER_PORTS = (445, 139), 3389, (7000, 7500, 7001), (8024, 8082), (443, 853)
CLIENT_FINGERPRINTS = (
    ("72a589da586844d7f0818ce684948eea", "cobalt-strike"),
    ("a0e9f5d64349fb13191bc781f81f42e1", "cobalt-strike-4x"),
    ("8916410db85077a5460817142dcbc8bc", "cobalt-strike-tls13"),
    ("80215ceceabc84f78e10c14e0932abfd", "sliver"),
    ("b32309a26951912be7dba376398abc3b", "sliver-mtls"),
    ("d9d99a03093874c9f309b7f2f052ffa1", "mythic"),
    ("3fed133de60c35724739b913924b6c24", "havoc"),
    ("0a3d5f30f81f79e46f682dc98354c1c1", "brute-ratel"),
    ("3b5074b1b5d032e5620f69f9f700ff0e", "metasploit"),
    ("6e9b0f7fd66a37b0aeecda0d4b40b1e5", "merlin"),
)
SERVER_FINGERPRINTS = (
    ("b742b407517bac9536a77a7b0fee28e9", "cobalt-strike-server"),
    ("ec74a5c51106f0419184d0dd08fb05bc", "cobalt-strike-cn-mod"),
    ("f4febc55ea12b31ae17cfb7e614afda8", "sliver-server"),
    ("5c1a3d5eaa5e78d5c85a2f8b5b6d3e2a", "havoc-server"),
)
DEFAULT_CERTIFICATE = (
    r"(?i)^(?:Major Cobalt Strike|Cobalt Strike|multiplayer|"
    r"Sliver|cloudflare-inc|HavocFramework|BRC4|localhost\.localdomain|"
    r"OperatorFoundation|Mythic C2)$"
)
NATIONAL_CIPHER = (
    r"(?i)(SM2|SM3|SM4|ECC-SM2|ECDHE-SM2|GM-.*|"
    r"0x00c6|0x00c7|0xe011|0xe013|0xe019|0xe051|0xe053|0xe055|0xe057)"
)
GREASE = tuple(f"{d:x}a{d:x}a" for d in range(16))
PRIVATE_SUFFIX = r"(?i)\.(?:local|corp|internal|lan|intra|prod\.internal)$"
PRIVATE_PREFIX = r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|127\.)"
BEACON_NAME = r"(?i)^(?:api|cdn|www|post|www6)\.[a-f0-9]{8,}\."
RESOLVERS = (
    "dns.google", "cloudflare-dns.com", "one.one.one.one", "dns.quad9.net", "doh.opendns.com", "dns.adguard.com",
    "dns.alidns.com", "doh.pub", "doh.360.cn",
)
RESOLVER_WORDS = ("doh", "dns-over", "dnstls", "dot")
BROWSERS = ("chrome", "firefox", "safari")
LOGIN_WORDS = ("login", "auth", "admin", "signin", "logon")
#: Marks that tools leave in a request: (rule, tool, pattern).
MARKERS = (
    ("R-TRAF-085", "behinder", r"(?i)(?:e45e329feb5d925b|rebeyond|Pass:\s*[A-Za-z0-9+/=]{16,}|Content-Type:\s*application/octet-stream.*Cookie:\s*rememberMe=)"),
    ("R-TRAF-086", "godzilla", r"(?i)(?:3c6e0b8a9c15224a|Cookie:\s*[a-zA-Z0-9]+=[A-Za-z0-9+/=]{40,}|pass=@?assert|Referer:\s*http[s]?://[^ ]+/?[a-z0-9]{16,}\.jsp)"),
    ("R-TRAF-087", "antsword", r"(?i)(?:antSword|antsword|Referer:\s*http[s]?://[^ ]+/[^\s]+\.(?:php|jsp|asp)$|X-Forwarded-For:\s*127\.0\.0\.1$)"),
    ("R-TRAF-088", "linx", r"(?i)(?:/linx-agent|X-Session-Id:\s*[a-f0-9]{32}|Linx\s*Agent|User-Agent:.*linx[- ]?\d)"),
    ("R-TRAF-089", "viper", r"(?i)(?:/api/v[0-9]/user/login/index|/msf/download|Viper-Sn|User-Agent:.*Viper(?:\s|/))"),
    ("R-TRAF-090", "fscan", r"(?i)(?:User-Agent:\s*Mozilla/5\.0.*fscan|/nice\s+ports.*Trinity|/webalizer/webalizer\.current)"),
    ("R-TRAF-091", "goby", r"(?i)(?:User-Agent:\s*Goby|X-Goby-.*:|/goby-webapp)"),
    ("R-TRAF-092", "xray", r"(?i)(?:User-Agent:\s*.*[Xx]ray|X-Xray-Reproduce-Id|/xray-cb-[a-f0-9]{8,})"),
    ("R-TRAF-093", "nuclei", r"(?i)(?:User-Agent:\s*Nuclei|X-Nuclei-Id|/nuclei-\d)"),
    ("R-TRAF-094", "yakit", r"(?i)(?:User-Agent:\s*Yakit|X-Yakit-|/yakit\-web)"),
    ("R-TRAF-095", "suo5", r"(?i)(?:/suo5|Suo5-|X-Suo5-|Upgrade:\s*websocket.*/suo5)"),
    ("R-TRAF-096", "regeorg", r"(?i)(?:tunnel\.(?:aspx|jsp|php|nosocket\.php)|X-CMD:\s*(?:CONNECT|CONNECTED|FORWARD|DISCONNECT)|neo-regeorg|reGeorg)"),
    ("R-TRAF-097", "brute-force", r"(?i)(?:User-Agent:\s*(?:hydra|patator|medusa|bp/[0-9])|POST\s+/(?:login|admin|auth)\b.*Content-Length:\s*[1-6][0-9]$)"),
)
MB = 1024 * 1024
#: Names of query types that captures give as numbers.
QUERY_TYPES = {"1": "A", "10": "NULL", "16": "TXT", "28": "AAAA"}

#: Our own small signature table: (id, category, view, field, pattern, tool, severity).
SIGNATURES = (
    ("HF-NET-001", "scanner", "http", "ua", r"(?i)\b(whatweb|arjun|dalfox)\b", "web-scanner", "medium"),
    ("HF-NET-002", "webshell", "http", "uri", r"(?i)/(cmd|shell|backdoor)\.(php|jsp|aspx)\b", "dropped-script", "high"),
    ("HF-NET-003", "c2", "http", "uri", r"(?i)^/submit\.php\?id=\d+$", "default-profile", "high"),
    ("HF-NET-004", "tunnel", "http", "request_line_excerpt", r"(?i)sec-websocket-protocol:\s*chisel-", "chisel", "high"),
    ("HF-NET-005", "exfil", "http", "host", r"(?i)(^|\.)(transfer\.sh|file\.io)$", "public-drop", "medium"),
    ("HF-NET-006", "xss", "http", "uri", r"(?i)(<|%3c)script\b", "script-tag", "medium"),
    ("HF-NET-007", "lfi", "http", "uri", r"(?i)\bphp://(filter|input)", "stream-wrapper", "medium"),
    ("HF-NET-008", "sqli", "http", "uri", r"(?i)\bwaitfor\s+delay\b", "timed-query", "high"),
    ("HF-NET-009", "rce", "http", "uri", r"(?i)class\.module\.classLoader", "binder", "high"),
    ("HF-NET-010", "c2", "dns", "qname", r"(?i)^[bcdfghjklmnpqrstvwxz]{14,}\.", "dga-consonants", "medium"),
    ("HF-NET-011", "tunnel", "dns", "qname", r"(?i)\.dnscat\.", "dnscat", "high"),
    ("HF-NET-012", "tunnel", "tls", "sni", r"(?i)\bfrps?\b", "frp", "medium"),
    ("HF-NET-013", "c2", "tls", "cert_issuer", r"(?i)^(evil|pwned|hacked)", "default-issuer", "medium"),
    ("HF-NET-014", "c2", "flow", "dst_port", r"^50050$", "team-server", "high"),
    ("HF-NET-015", "lateral", "flow", "payload_first_bytes", r"PSEXESVC", "psexec", "high"),
    ("HF-NET-016", "lateral", "flow", "payload_first_bytes", r"^\x05\x00\x0b", "wmi-bind", "medium"),
    ("HF-NET-017", "lateral", "flow", "payload_first_bytes", r"\xffSMB|\xfeSMB", "smb-header", "low"),
    ("HF-NET-018", "tunnel", "flow", "payload_first_bytes", r"^\x6f\x00\x00\x00\x00", "frp-login", "medium"),
)


def raw(name: str) -> Column:
    return F.col(f"raw.{name}")


def _src() -> Column:
    return F.coalesce(F.nullif("src_ip", F.lit("")), F.lit("?"))


def said(text: str, **extra: Column) -> dict[str, Column]:
    return {"narrative": F.lit(text), **extra}


def query_type() -> Column:
    """``TXT`` for ``TXT``, ``txt`` and ``16``."""
    upper = F.upper(blank(raw("qtype")))
    pairs = [F.lit(x) for p in QUERY_TYPES.items() for x in p]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), upper), upper)


def _lookup(table: Sequence[tuple[str, str]], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in table for x in p]), F.lower(key))


# Records of one view ------------------------------------------------------------------


def signature_rule(view: str, category: str, tool: str) -> str | None:
    """The rule that a signature of this view, category and tool reports; None for none."""
    tool = tool.lower()
    if view == "http":
        table = {"scanner": "001", "webshell": "012", "c2": "007", "tunnel": "203", "exfil": "010", "sqli": "003", "rce": "004", "xss": "002", "lfi": "002", "rfi": "002"}
        return f"R-TRAF-{table[category]}" if category in table else None
    if view == "dns":
        return "R-TRAF-005" if category == "c2" and "dga" in tool else "R-TRAF-006"
    if view == "tls":
        return "R-TRAF-201" if category == "tunnel" else "R-TRAF-007"
    if view == "flow":
        for words, rule in ((("psexec", "winexe"), "102"), (("wmi",), "104"), (("smb", "svcctl", "samr"), "101")):
            if any(w in tool for w in words):
                return f"R-TRAF-{rule}"
        if category == "tunnel":
            return "R-TRAF-201" if "frp" in tool else "R-TRAF-202" if "nps" in tool else "R-TRAF-203"
        return "R-TRAF-008" if category == "c2" else None
    return None


def signature_branches(view: str, signatures: Sequence[tuple] = SIGNATURES) -> list[Branch]:
    """One branch a signature of this view."""
    out = []
    for rule, sig_id, field, pattern, tool in signatures_of(view, signatures):
        value = signature_value(field)
        extra = {"sig_id": F.lit(sig_id), "tool": F.lit(tool), "matched_field": F.lit(field)}
        out.append(Branch(rule, (blank(value) != "") & value.rlike(pattern), extra))
    return out


def signatures_of(view: str, signatures: Sequence[tuple]) -> list[tuple[str, str, str, str, str]]:
    """(rule, id, field, pattern, tool) of the signatures of a view that a rule reports."""
    mine = ((signature_rule(view, category, tool), sig_id, field, pattern, tool) for sig_id, category, its_view, field, pattern, tool, _ in signatures if its_view == view)
    return [s for s in mine if s[0] is not None]


def signature_value(field: str) -> Column:
    """What a signature on a field looks at."""
    value = F.col("dst_port").cast("string") if field == "dst_port" else raw(field).cast("string")
    return query_type() if field == "qtype" else F.lower(value) if field in ("ja3", "ja3s") else value


#: Places of the signatures among the branches of their view.
SIGNATURE_PLACES = {"http": 1, "dns": 0, "tls": 0, "flow": 6}
#: Up to so many signatures of a view are branches, without Python; the rows are the same either way.
FEW = 100


def signature_hits(flows: DataFrame, view: str, signatures: Sequence[tuple]) -> DataFrame:
    """What ``signature_branches`` report of the records of a view, from one automaton: for signature sets of any size."""
    mine = signatures_of(view, [s for s in signatures if valid([(s[0], s[3], s[4])])])
    rows = [(n, rule, RULES[rule].severity, json.dumps({"sig_id": sig_id, "tool": tool, "matched_field": field}, ensure_ascii=False, separators=(",", ":"))) for n, (rule, sig_id, field, _, tool) in enumerate(mine)]
    table = flows.sparkSession.createDataFrame(rows, "ordinal int, rule_id string, severity string, extra string")
    fields = {f: signature_value(f) for f in {m[2] for m in mine}}
    seen = flows.where(F.col("view") == view).withColumn("ordinal", F.explode(matching(fields, [(n, m[2], m[3]) for n, m in enumerate(mine)], flows.sparkSession)))
    seen = seen.join(F.broadcast(table), "ordinal")
    return seen.withColumn("ordinal", F.col("ordinal") + SIGNATURE_PLACES[view])


def http_branches(signatures: Sequence[tuple] = SIGNATURES) -> list[Branch]:
    uri, agent, line = blank(raw("uri")), blank(raw("ua")), blank(raw("request_line_excerpt"))
    return [
        Branch("R-TRAF-001", agent.rlike(SCANNER_AGENT), said("user agent of a scanner", ua=truncated(agent, 200, "…"))),
        *signature_branches("http", signatures),
        Branch("R-TRAF-002", uri.rlike(SENSITIVE_PATH), said("sensitive path")),
        Branch("R-TRAF-003", uri.rlike(SQL_INJECTION), said("SQL in the address")),
        Branch("R-TRAF-004", F.concat_ws(" ", uri, line).rlike(CODE_EXECUTION), said("code execution in the request")),
        Branch("R-TRAF-012", line.rlike(WEBSHELL_KEY), said("web shell key")),
        *marker_branches("http"),
    ]


def marker_text() -> Column:
    return F.concat_ws(" ", *[blank(raw(n)) for n in ("uri", "ua", "request_line_excerpt", "host")])


def marker_branches(view: str) -> list[Branch]:
    """Marks of tools; all but AntSword's count in every view that has them."""
    out, text = [], marker_text()
    for rule, tool, pattern in MARKERS:
        found = T.rlike_with_words(text, F.lower(text), pattern)
        if rule == "R-TRAF-089":
            found = found | has_any(raw("sni"), ["viper"])
        if rule != "R-TRAF-087" or view == "http":
            out.append(Branch(rule, found, said("mark of a tool", tool=F.lit(tool))))
    return out


def tls_branches(signatures: Sequence[tuple] = SIGNATURES) -> list[Branch]:
    sni, cn, issuer, ja3, ja3s = (blank(raw(n)) for n in ("sni", "cert_cn", "cert_issuer", "ja3", "ja3s"))
    cipher, alpn, host, offered = (blank(raw(n)) for n in ("cipher", "alpn", "host", "tls_extensions"))
    client, server = _lookup(CLIENT_FINGERPRINTS, ja3), _lookup(SERVER_FINGERPRINTS, ja3s)
    cobalt = client.startswith("cobalt")
    life = F.unix_micros(parsed(raw("cert_not_after"))) - F.unix_micros(parsed(raw("cert_not_before")))
    parts = F.split(offered, ",")
    n_parts = F.size(F.filter(parts, lambda x: F.trim(x) != ""))
    some = (ja3 != "") | (cipher != "")
    fingerprint = {"ja3": ja3, "tool": client}
    return [
        *signature_branches("tls", signatures),
        Branch("R-TRAF-050", cobalt, said("client fingerprint of a beacon", **fingerprint)),
        Branch("R-TRAF-051", ~cobalt, said("client fingerprint of a control tool", **fingerprint)),
        Branch("R-TRAF-052", server.isNotNull(), said("server fingerprint of a control tool", ja3s=ja3s, tool=server)),
        Branch("R-TRAF-053", sni.contains(".") & host.contains(".") & (F.lower(sni) != F.lower(host)), said("SNI and host differ", sni=truncated(sni, 80, "…"), host=truncated(host, 80, "…"))),
        Branch("R-TRAF-054", cn.rlike(DEFAULT_CERTIFICATE), said("default certificate name", cert_cn=truncated(cn, 80, "…"))),
        Branch("R-TRAF-055", ((sni == "") | T.numeric_or_address(sni)) & (some | (cn != "")), said("empty or numeric SNI", sni=sni)),
        Branch("R-TRAF-056", cipher.rlike(NATIONAL_CIPHER), said("national cipher", cipher=truncated(cipher, 80, "…"))),
        Branch("R-TRAF-057", (life < 24 * HOUR) & (cn != "") & (F.lower(issuer) == F.lower(cn)), said("short-lived self-signed certificate", hours=F.format_string("%.1f", life / HOUR))),
        Branch("R-TRAF-058", has_any(alpn, ["h2"]) & blank(raw("http_version")).contains("1."), said("h2 offered, HTTP/1 spoken", alpn=alpn)),
        Branch("R-TRAF-059", sni.rlike(PRIVATE_SUFFIX) & (blank(F.col("dst_ip")) != "") & ~F.col("dst_ip").rlike(PRIVATE_PREFIX), said("private name at a public address", sni=truncated(sni, 80, "…"))),
        Branch("R-TRAF-060", (offered != "") & ~has_any(offered, ["grease"]) & (ja3 != "") & ~F.arrays_overlap(F.split(F.lower(offered), ","), F.array(*map(F.lit, GREASE))), said("no GREASE", exts_len=F.size(parts))),
        Branch("R-TRAF-061", has_any(offered, ["ech"]), said("encrypted client hello")),
        Branch("R-TRAF-062", (offered != "") & n_parts.between(1, 3), said("few extensions", extension_count=n_parts)),
        Branch("R-TRAF-063", T.numeric_or_address(sni) & sni.contains("."), said("SNI is an address", sni=sni)),
        Branch("R-TRAF-064", ~cipher.contains(",") & (F.length(cipher) > 4), said("a single cipher suite", cipher=truncated(cipher, 40, "…"))),
        Branch("R-TRAF-065", raw("session_id_empty") & raw("session_ticket_empty"), said("neither session nor ticket")),
        Branch("R-TRAF-068", has_any(raw("ua_hint"), BROWSERS) & (alpn == ""), said("a browser without ALPN", ua_hint=truncated(raw("ua_hint"), 80, "…"))),
        Branch("R-TRAF-069", (sni == "") & (alpn == "") & some, said("neither SNI nor ALPN", ja3=ja3)),
        *marker_branches("tls"),
    ]


def dns_branches(signatures: Sequence[tuple] = SIGNATURES) -> list[Branch]:
    name = blank(raw("qname"))
    label, size = T.first_label(name), F.length(name)
    bits, b32, b64, run = T.entropy(label), T.base32_ratio(label), T.base64url_ratio(label), T.consonant_run(label)
    hint = F.coalesce(F.nullif(raw("sni"), F.lit("")), blank(raw("host")))
    cut = truncated(name, 80, "…")
    return [
        *signature_branches("dns", signatures),
        Branch("R-TRAF-071", (F.length(label) >= 16) & (bits > 4.0), said("first label of high entropy", shannon=F.format_string("%.2f", bits), qname=cut)),
        Branch("R-TRAF-075", (raw("payload_len") > 400) & (query_type() == "A"), said("large answer to a simple question", payload_len=raw("payload_len"))),
        Branch("R-TRAF-076", (F.length(label) >= 20) & (F.greatest(b32, b64) >= 0.85), said("first label looks encoded", b32_ratio=F.format_string("%.2f", b32), b64_ratio=F.format_string("%.2f", b64))),
        Branch("R-TRAF-078", name.rlike(BEACON_NAME), said("name of a DNS beacon", qname=cut)),
        Branch("R-TRAF-079", F.col("dst_port").isin(*RESOLVER_PORTS) & ~hint.isin(*RESOLVERS) & has_any(hint, RESOLVER_WORDS), said("unknown encrypted resolver", host_hint=truncated(hint, 80, "…"))),
        Branch("R-TRAF-080", (F.length(label) >= 12) & (run >= 7), said("run of consonants", max_consec_consonant=run)),
        Branch("R-TRAF-082", (size > 0) & (raw("answer_len") > size * 4) & (raw("answer_len") > 200), said("answer far larger than question", answer_len=raw("answer_len"), qname_len=size)),
        Branch("R-TRAF-083", (raw("ttl") == 0) | (raw("ttl") > 604800), said("odd TTL", ttl=raw("ttl"))),
    ]


def flow_branches(signatures: Sequence[tuple] = SIGNATURES) -> list[Branch]:
    seconds, packets, size = F.coalesce(raw("duration_s"), F.lit(0.0)), F.coalesce(raw("packets_total"), F.lit(0)), F.coalesce(raw("bytes_total"), F.lit(0))
    port, mean = F.col("dst_port"), size / F.greatest(packets, F.lit(1))
    return [
        Branch("R-TRAF-008", port.isin(*LISTENER_PORTS) & (seconds > 300), said("listener port, long connection", duration_s=seconds)),
        Branch("R-TRAF-010", (raw("bytes_a2b") > 50 * MB) & (seconds > 60), said("large outbound stream", bytes_a2b=raw("bytes_a2b"))),
        Branch("R-TRAF-011", (packets > 100) & (seconds > 1800) & (mean < 200), said("heartbeat", packets=packets, avg_bytes_per_pkt=F.format_string("%.1f", mean))),
        Branch("R-TRAF-101", port.isin(*SMB_PORTS), said("SMB", bytes_total=size)),
        Branch("R-TRAF-201", port.isin(*FRP_PORTS), said("default port of frp", dst_port=port)),
        Branch("R-TRAF-202", port.isin(*NPS_PORTS), said("default port of nps", dst_port=port)),
        *signature_branches("flow", signatures),
        *marker_branches("flow"),
        Branch("R-TRAF-098", (packets >= 30) & (seconds > 600) & (size < 20 * 1024), said("pulses", packets=packets, bytes_total=size)),
    ]


def creds_branches() -> list[Branch]:
    return [
        Branch("R-TRAF-009", F.lit(True), said("credential in the clear", auth_type=F.lower(blank(raw("auth_type"))), username=truncated(blank(raw("username")), 40, "…"), password_masked=raw("password_masked")))
    ]


# Rules with a memory --------------------------------------------------------------------


def _view(flows: DataFrame, *views: str) -> DataFrame:
    return timed(flows).where(F.col("view").isin(*views)).withColumn("src", _src())


def generated_names(flows: DataFrame, window_us: int = HOUR, more_than: int = 20) -> DataFrame:
    """R-TRAF-005: long names with many digits, from sources with more than ``more_than`` queries in the window."""
    counted = trailing(_view(flows, "dns"), ["src"], "us", TIES, window_us, {"n": F.lit(1).cast("bigint")})
    found = counted.unionByName(_view(flows, "dns").where("us IS NULL").withColumn("n", F.lit(None).cast("bigint")))
    ratio = T.digit_ratio(raw("qname"))
    return found.where((F.length(raw("qname")) > 30) & (F.col("n").isNull() | (F.col("n") > more_than)) & (ratio > 0.25)).withColumn("ratio", ratio)


def tunnel_names(flows: DataFrame, window_us: int = HOUR, more_than: int = 40) -> DataFrame:
    """R-TRAF-006: names over 60 characters; else TXT queries of sources with more than ``more_than`` in the window."""
    long = _view(flows, "dns").where(F.length(raw("qname")) > 60).withColumn("n", F.lit(None).cast("bigint"))
    txt = trailing(_view(flows, "dns").where(query_type() == "TXT"), ["src"], "us", TIES, window_us, {"n": F.lit(1).cast("bigint")})
    return long.unionByName(txt.where((F.length(blank(raw("qname"))) <= 60) & (F.col("n") > more_than)))


def long_names(flows: DataFrame, window_us: int = 5 * MINUTE, at_least: int = 20, mean_over: int = 40) -> DataFrame:
    """R-TRAF-070: a source's first query at which ``at_least`` lie in the window and their names are long on average."""
    sums = {"n": F.lit(1).cast("bigint"), "chars": F.length(blank(raw("qname"))).cast("bigint")}
    counted = trailing(_view(flows, "dns"), ["src"], "us", TIES, window_us, sums)
    return first_over(counted, ["src"], "us", TIES, (F.col("n") >= at_least) & (F.col("chars") > mean_over * F.col("n")))


def many_subdomains(flows: DataFrame, more_than: int = 100) -> DataFrame:
    """R-TRAF-072: a parent domain's query that makes it more than ``more_than`` different first labels."""
    named = _view(flows, "dns").where("us IS NOT NULL").withColumn("parent", T.parent_domain(raw("qname"))).withColumn("label", T.first_label(raw("qname")))
    return distinct_over(named.where("parent <> ''"), ["parent"], "label", "us", TIES, more_than)


def type_share(flows: DataFrame, kind: str, over: float, at_least: int = 30) -> DataFrame:
    """R-TRAF-073 and 074: a source's first query at which, of ``at_least`` so far, more than the share ``over`` is of type ``kind``."""
    sums = {"n": F.lit(1).cast("bigint"), "kinds": (query_type() == kind).cast("bigint")}
    so_far = running(_view(flows, "dns"), ["src"], "us", TIES, sums)
    return first_over(so_far, ["src"], "us", TIES, (F.col("n") >= at_least) & (F.col("kinds") / F.col("n") > over))


def missing_names(flows: DataFrame, window_us: int = 5 * MINUTE, more_than: int = 50) -> DataFrame:
    """R-TRAF-077: a source's first answer with more than ``more_than`` missing names in the window."""
    return burst(_view(flows, "dns").where(raw("rcode") == 3), ["src"], "us", TIES, window_us, more_than + 1)


def beacons(df: DataFrame, keys: Sequence[str], last: int = 20, at_least: int = 15, cv_under: float = 0.15, mean_over: float = 5.0) -> DataFrame:
    """R-TRAF-081: a key's first row at which the last ``last`` intervals, ``at_least`` of them, hardly differ.

    Adds ``mean_s`` and ``cv``, their mean and their coefficient of variation.
    """
    timed_rows = looking_back(df, keys, "us", TIES, 1, lambda w: {"delta": (F.col("us") - F.lag("us").over(w)) / F.lit(1e6)})

    def spread(w):
        frame = w.rowsBetween(-(last - 1), 0)
        mean, n = F.avg("delta").over(frame), F.count("delta").over(frame)
        return {"intervals": n, "mean_s": mean, "cv": F.when(mean > 0, F.stddev_pop("delta").over(frame) / mean)}

    found = looking_back(timed_rows, keys, "us", TIES, last, spread)
    return first_over(found, keys, "us", TIES, (F.col("intervals") >= at_least) & (F.col("cv") < cv_under) & (F.col("mean_s") > mean_over))


def repeated_names(flows: DataFrame, more_than: int = 30) -> DataFrame:
    """R-TRAF-084: the query that asks for a name more than ``more_than`` times from one source."""
    named = _view(flows, "dns").where("us IS NOT NULL").withColumn("qname", raw("qname")).where("qname <> ''")
    return nth_rows(named, ["src", "qname"], "us", TIES, more_than + 1)


def fatal_alerts(flows: DataFrame, more_than: int = 20) -> DataFrame:
    """R-TRAF-066: every fatal alert of a source after the first ``more_than``."""
    fatal = _view(flows, "tls").where(raw("alert_level") == "fatal")
    return numbered(fatal, ["src"], "us", TIES, "nth").where(F.col("nth") > more_than)


def many_server_names(flows: DataFrame, more_than: int = 40) -> DataFrame:
    """R-TRAF-067: the record that makes it more than ``more_than`` different SNIs from one source."""
    named = _view(flows, "tls").withColumn("sni", F.nullif(raw("sni"), F.lit("")))
    return distinct_over(named, ["src"], "sni", "us", TIES, more_than)


def many_ports(flows: DataFrame, more_than: int = 25) -> DataFrame:
    """R-TRAF-090: the record that makes it more than ``more_than`` different ports from one source; records with the tool's mark don't count."""
    marker = next(p for r, _, p in MARKERS if r == "R-TRAF-090")
    used = _view(flows, "http", "tls", "flow").where(~marker_text().rlike(marker) & (F.col("dst_port") != 0))
    return distinct_over(used, ["src"], "dst_port", "us", TIES, more_than)


def many_logins(flows: DataFrame, more_than: int = 40) -> DataFrame:
    """R-TRAF-097: the short POST to a log-in address that is a source's number ``more_than`` + 1."""
    marker = next(p for r, _, p in MARKERS if r == "R-TRAF-097")
    short = raw("content_length").between(1, 199) & has_any(raw("uri"), LOGIN_WORDS)
    posts = _view(flows, "http").where((raw("method") == "POST") & short & ~marker_text().rlike(marker))
    return nth_rows(posts, ["src"], "us", TIES, more_than + 1)


def desktop_fan_in(flows: DataFrame, at_least: int = 5) -> DataFrame:
    """R-TRAF-103: the flow that makes it ``at_least`` different sources at a host's remote desktop."""
    used = _view(flows, "flow").where((F.col("dst_port") == RDP_PORT) & (blank(F.col("src_ip")) != "") & (blank(F.col("dst_ip")) != ""))
    return distinct_over(used, ["dst_ip"], "src_ip", "us", TIES, at_least - 1)


# All of them ----------------------------------------------------------------------------


def _plain(flows: DataFrame, view: str, branches: Callable[[Sequence[tuple]], list[Branch]], signatures: Sequence[tuple], few: int) -> list[DataFrame]:
    """Rules of one record of a view, with few signatures as branches among them, with many beside them."""
    mine = signatures_of(view, signatures) if view in SIGNATURE_PLACES else []
    if len(mine) <= few:
        return [hits(flows.where(F.col("view") == view), branches(signatures))]
    others = hits(flows.where(F.col("view") == view), branches([]))
    shifted = F.when(F.col("ordinal") >= SIGNATURE_PLACES[view], F.col("ordinal") + len(mine)).otherwise(F.col("ordinal"))
    return [others.withColumn("ordinal", shifted), signature_hits(flows, view, signatures)]


def detect(flows: DataFrame, signatures: Sequence[tuple] = SIGNATURES, few: int = FEW) -> DataFrame:
    """Records of FLOWREC to (record, ``ordinal, rule_id, severity, extra``), without R-TRAF-999.

    Views with more than ``few`` signatures get them from one automaton.  Flows have no time of their own; rules with a memory then go by file and line.
    """
    flows = timed(flows)
    flows = flows.withColumn("us", F.when(F.col("view") == "flow", F.coalesce("us", (F.coalesce(raw("rel_start"), F.lit(0.0)) * 1e6).cast("bigint"))).otherwise(F.col("us")))
    names = [*flows.columns, "ordinal", "rule_id", "severity", "extra"]
    plain = [
        part.withColumn("ordinal", F.col("ordinal") + 20)
        for view, branches in (("http", http_branches), ("dns", dns_branches), ("tls", tls_branches), ("flow", flow_branches), ("creds", lambda _: creds_branches()))
        for part in _plain(flows, view, branches, signatures, few)
    ]
    memory = [
        one_rule(generated_names(flows), "R-TRAF-005", 0, {"digit_ratio": F.format_string("%.2f", "ratio")}),
        one_rule(tunnel_names(flows), "R-TRAF-006", 1, {"qname_len": F.length(raw("qname")), "txt_count_1h": F.col("n")}),
        one_rule(long_names(flows), "R-TRAF-070", 10, {"avg_qname_len": F.format_string("%.1f", F.col("chars") / F.col("n"))}),
        one_rule(many_subdomains(flows), "R-TRAF-072", 11, {"parent": F.col("parent")}),
        one_rule(type_share(flows, "TXT", 0.30), "R-TRAF-073", 12, {"txt_ratio": F.format_string("%.2f", F.col("kinds") / F.col("n"))}),
        one_rule(type_share(flows, "NULL", 0.05), "R-TRAF-074", 13, {"null_ratio": F.format_string("%.2f", F.col("kinds") / F.col("n"))}),
        one_rule(missing_names(flows), "R-TRAF-077", 14, {"nxdomain_5min": F.col("n")}),
        one_rule(beacons(_view(flows, "dns"), ["src"]), "R-TRAF-081", 15, {"coeff_variation": F.format_string("%.3f", "cv"), "mean_interval_s": F.format_string("%.1f", "mean_s")}),
        one_rule(repeated_names(flows), "R-TRAF-084", 16, {"qname": F.col("qname")}),
        one_rule(fatal_alerts(flows), "R-TRAF-066", 2, {"alert_count": F.col("nth")}),
        one_rule(many_server_names(flows), "R-TRAF-067", 3),
        one_rule(many_ports(flows), "R-TRAF-090", 4),
        one_rule(many_logins(flows), "R-TRAF-097", 5),
        one_rule(desktop_fan_in(flows), "R-TRAF-103", 6),
    ]
    return reduce(DataFrame.unionByName, [p.select(*names) for p in [*plain, *memory]])


#: Groups of rules whose company makes a source suspect: (name, first, last).
CLUSTERS = (("tls-deep", 50, 69), ("dns-covert", 70, 84), ("cn-redteam", 85, 98))


def correlated(found: DataFrame, at_least: int = 3, compat: str = "strict") -> DataFrame:
    """R-TRAF-999: sources of ``at_least`` different rules, with ``first_ts, rules, clusters, apt_suspect``.

    ``strict`` takes all rules; ``last`` takes only the last rule of each record, as the
    scripts this replaces do.
    """
    if compat == "last":
        found = found.groupBy("src_ip", "us", *TIES).agg(F.max_by(F.struct("rule_id", "ts"), "ordinal").alias("l")).select("src_ip", "us", *TIES, "l.*")
    # First one row a source and rule: a busy source is no larger than the catalogue.
    pairs = found.where("src_ip <> ''").groupBy("src_ip", "rule_id").agg(F.min("ts").alias("ts"))
    sources = pairs.groupBy("src_ip").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"), F.min("ts").alias("first_ts"))
    numbers = F.transform("rules", lambda r: F.substring(r, 8, 3).cast("int"))
    named = F.array(*[F.when(F.arrays_overlap(numbers, F.sequence(F.lit(a), F.lit(b))), F.lit(n)) for n, a, b in CLUSTERS])
    return (
        sources.where(F.size("rules") >= at_least)
        .withColumn("clusters", F.array_compact(named))
        .withColumn("apt_suspect", F.size("clusters") >= 2)
    )


def findings(flows: DataFrame, signatures: Sequence[tuple] = SIGNATURES, compat: str = "strict") -> DataFrame:
    """The same as findings ``TRAF-001``, ``TRAF-002``, ...; correlated sources come last."""
    # All rules run once: correlation, the ranges of the ids and the ids read what they gave.
    found = settled(detect(flows, signatures), "traffic-hits")
    cluster = settled(correlated(found, compat=compat), "traffic-sources")
    columns = ["ts", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "view", "src_file", "line_no", "us", "ordinal", "rule_id", "severity", "extra"]
    group = one_rule(cluster, "R-TRAF-999", 0, {"distinct_rules": F.col("rules"), "cluster_hits": F.col("clusters"), "tag": F.when(F.col("apt_suspect"), F.lit("apt-suspect"))})
    group = group.withColumns({"ts": F.col("first_ts"), "view": F.lit("correlation"), "src_file": F.col("src_ip")})
    kinds = dict(found.dtypes)
    group = group.select(*[F.col(c) if c in group.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    evidence = {c: F.col(c) for c in columns[:9]}
    place = F.concat_ws("", "rule_id", F.lit("@"), "src_file", F.lit(":"), "line_no")
    address = F.when(blank(F.col("src_ip")) != "", ioc("ip", F.col("src_ip"), "medium", F.col("ts"), place, F.concat(F.lit("rule:"), F.col("rule_id"))))
    return as_findings(found.select(*columns).unionByName(group), "TRAF", evidence, F.array_compact(F.array(address)))
