"""Playbook rules: patterns in a table, and the shapes of behaviour they name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.net import is_internal
from huntframe.functions.text import all_matches, blank
from huntframe.operators.grading import distinct_trailing
from huntframe.operators.windows import HOUR, MINUTE, first_over, followed_by, looking_back
from huntframe.sources.store import settled

# What a playbook rule looks for, as (rule, field, pattern).
PATTERNS = (
    ("PLB-BF-005", "ua", r"(?i)\b(hydra|medusa|patator|ncrack)\b|^python-"),
    ("PLB-BF-009", "user", r"(?i)^(root|admin|test|oracle|mysql|postgres)$"),
    ("PLB-CE-001", "text", r"(?i)\$\{(jndi:|\$\{|lower:|upper:|env:|::-)"),
    ("PLB-CE-002", "text", r"\"@type\"\s*:\s*\"[a-zA-Z_][\w.$]+\""),
    ("PLB-CE-003", "text", r"\"@class\"\s*:\s*\"[a-zA-Z_][\w.$]+\""),
    ("PLB-CE-004", "text", r"(?i)<dynamic-proxy>|<map>.*java[.x]"),
    ("PLB-CE-005", "text", r"(?i)!!(javax\.script|java\.net\.URLClassLoader)"),
    ("PLB-CE-006", "text", r"T\(java\.lang\.Runtime\)|new\s+ProcessBuilder"),
    ("PLB-CE-007", "text", r"\(#_memberAccess|@java\.lang\.Runtime@"),
    ("PLB-CE-008", "text", r"(?i)freemarker\.template\.utility\.Execute|#set\(\$\w+\s*=.*runtime"),
    ("PLB-CE-009", "text", r"\{\{.*(config\.__class__|__globals__|__import__)"),
    ("PLB-CE-010", "text", r"rememberMe=[A-Za-z0-9+/]{100,}={0,2}"),
    ("PLB-CE-011", "text", r"(?i);\s*(id|whoami|uname|cat\s+/etc)|\$\(|`"),
    ("PLB-CE-015", "text", r"(?i)curl\s+\S+\s*\|\s*(bash|sh)|wget\s+\S+.*\|\s*sh"),
    ("PLB-CE-016", "text", r"(?i)base64\s+-d.*\|.*bash|echo\s+\S{50,}\s*\|\s*base64\s+-d\s*\|\s*bash"),
    ("PLB-CE-017", "text", r"(?i)bash\s+-i|>&\s*/dev/tcp/|\bnc\s+.*\s-e|socket\.fromfd"),
    ("PLB-LM-007", "text", r"(?i)\bfrpc\s+-c|\bnpc\s+-server|\bchisel\s+client"),
    ("PLB-LM-010", "text", r"(?i)cat\s+/etc/shadow|reg\s+save\s+HKLM\\SAM|ntdsutil"),
    ("PLB-LM-013", "text", r"(?i)\b(psexec|wmiexec|smbexec|secretsdump)\.py"),
    ("PLB-SQ-001", "text", r"(?i)union\s+(all\s+)?select"),
    ("PLB-SQ-003", "text", r"(?i)sleep\(|benchmark\(|pg_sleep|waitfor\s+delay"),
    ("PLB-SQ-004", "text", r"(?i)extractvalue\(|updatexml\(|floor\(rand|exp\(~"),
    ("PLB-SQ-005", "ua", r"(?i)sqlmap"),
    ("PLB-SQ-007", "text", r"(?i)information_schema|mysql\.user|sys\.tables"),
    ("PLB-SQ-008", "text", r"(?i);\s*(insert|update|drop|exec|shutdown)\b"),
    ("PLB-SQ-009", "text", r"(?i)load_file\(|xp_dirtree"),
    ("PLB-SQ-010", "text", r"(?i)/\*!|/\*\*/|%2f%2a"),
    ("PLB-SQ-012", "text", r"SQL syntax|ORA-\d{5}|MSSQL|PSQLException"),
    ("PLB-SQ-015", "text", r"(?i)into\s+(outfile|dumpfile)"),
    ("PLB-WS-005", "ua", r"(?i)antsword"),
    ("PLB-WS-006", "text", r"(?i)eval\s*\(\s*\$_(REQUEST|POST|GET)"),
    ("PLB-WS-008", "text", r"(?i)(Runtime\.getRuntime\(\)\.exec|ProcessBuilder).*request\."),
    ("PLB-WS-012", "text", r"(?i)(crontab|authorized_keys|\.service).*(/tmp/|/dev/shm/|https?://)"),
)
SHORT_SCRIPT = r"^/[a-zA-Z0-9]{1,3}\.(jsp|jspx|php|aspx?)$"
STATIC_SCRIPT = r"(?i)/(upload|static|images)/.*\.(jsp|jspx|php|aspx?)$"
DECODERS = r"(?i)base64_decode|gzinflate|str_rot13"
CALLBACK_PORTS = (1389, 389, 1099, 1090, 4444, 8888)
CALLBACK_DOMAINS = ("dnslog.cn", "interactsh.com", "ceye.io", "burpcollaborator.net")
ADMIN_PANELS = r"(?i)/(manager/html|jenkins|gitlab|solr)\b"
SHARES = r"(?i)(IPC|ADMIN)\$"


def patterns_hit(df: DataFrame, fields: dict[str, Column], patterns: Sequence[tuple] = PATTERNS) -> DataFrame:
    """A row a record and rule whose field (``text``, ``ua`` or ``user``) matches."""
    rules = [(blank(fields[f]).rlike(p), F.lit(r)) for r, f, p in patterns if f in fields]
    return df.withColumn("rule_id", F.explode(all_matches(rules)))


def sprays(failures: DataFrame, at_least: int = 20, each: int = 3) -> DataFrame:
    """PLB-BF-006: sources that tried many users a few times each."""
    tries = failures.groupBy("src_ip", "user").agg(F.count(F.lit(1)).alias("tries"))
    return tries.groupBy("src_ip").agg(F.count("user").alias("users"), F.max("tries").alias("most")).where((F.col("users") >= at_least) & (F.col("most") <= each))


def refused_logins(log: DataFrame, size: str, at_least: int = 100, share: float = 0.7, uri: str = "(?i)/(admin/)?login") -> DataFrame:
    """PLB-BF-010: per address and bucket, many POSTs to a log-in page of which most were refused."""
    posts = log.where((F.col("method") == "POST") & F.col("uri").rlike(uri))
    counts = posts.groupBy("src_ip", F.window(F.timestamp_micros("us"), size).alias("w")).agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col("status").isin(401, 403)).alias("refused"))
    return counts.where((F.col("posts") >= at_least) & (F.col("refused") > share * F.col("posts"))).select("src_ip", F.col("w.start").alias("bucket"), "posts", "refused")


def refused_panels(log: DataFrame, at_least: int = 20, uri: str = ADMIN_PANELS) -> DataFrame:
    """PLB-BF-012: addresses that administration pages refused often."""
    return log.where(F.col("uri").rlike(uri) & F.col("status").isin(401, 403)).groupBy("src_ip").agg(F.count(F.lit(1)).alias("refused")).where(F.col("refused") >= at_least)


def failure_runs(rows: DataFrame, keys: Sequence[str], failed: Column, ties: Sequence[str], at_least: int = 30) -> DataFrame:
    """PLB-BF-011: runs of failures without a success between them, as ``start_us, end_us, failures``.

    A run is named by the number of successes before it: a running sum over slabs.
    """
    from huntframe.operators.windows import running

    marked = running(rows.withColumn("__failed", failed), keys, "us", ties, {"__run": (~F.col("__failed")).cast("bigint")})
    runs = marked.where("__failed").groupBy(*keys, "__run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("failures"))
    return runs.where(F.col("failures") >= at_least).drop("__run")


def night_first_logins(firsts: DataFrame, until_hour: int = 6) -> DataFrame:
    """PLB-BF-013: first log-ins between midnight and ``until_hour``."""
    return firsts.where(F.hour(F.timestamp_micros("us")) < until_hour)


def wide_scans(flows: DataFrame, ties: Sequence[str], window_us: int = 5 * MINUTE, at_least: int = 20) -> DataFrame:
    """PLB-LM-001: a host's first flow at which it has reached ``at_least`` internal hosts at one port in the window."""
    inside = flows.where(is_internal(F.col("dst_ip")))
    counted = distinct_trailing(inside, ["src_ip", "dst_port"], "dst_ip", "us", ties, window_us, "hosts")
    return first_over(counted, ["src_ip", "dst_port"], "us", ties, F.col("hosts") >= at_least)


def many_hosts(rows: DataFrame, key: str, host: str, ties: Sequence[str], window_us: int = HOUR, at_least: int = 10) -> DataFrame:
    """PLB-LM-002 and 008: a key's first row with ``at_least`` hosts in the window."""
    counted = distinct_trailing(rows, [key], host, "us", ties, window_us, "hosts")
    return first_over(counted, [key], "us", ties, F.col("hosts") >= at_least)


def in_both(rows: DataFrame, keys: Sequence[str], first: Column, second: Column) -> DataFrame:
    """PLB-SQ-002 and LM-005: keys that show both marks, with the first time of each."""
    marks = rows.groupBy(*keys).agg(F.min(F.when(first, F.col("us"))).alias("first_us"), F.min(F.when(second, F.col("us"))).alias("second_us"))
    return marks.where("first_us IS NOT NULL AND second_us IS NOT NULL")


def many_variants(log: DataFrame, agent: str = r"(?i)xray|nuclei|w13scan", at_least: int = 20) -> DataFrame:
    """PLB-SQ-006: scanners with many different URIs."""
    return log.where(F.col("ua").rlike(agent)).select("src_ip", "uri").distinct().groupBy("src_ip").agg(F.count("uri").alias("uris")).where(F.col("uris") >= at_least)


def double_encoded(uri: Column, words: str = r"(?i)\b(union|select|insert|sleep)\b") -> Column:
    """PLB-SQ-011: percent signs encoded twice, and a SQL word after decoding twice."""
    once = F.try_url_decode(uri)
    return F.coalesce(uri.rlike("(?i)%25[0-9a-f]{2}") & F.try_url_decode(once).rlike(words), F.lit(False))


def outsized(log: DataFrame, path: Column, size: Column, times: float = 10.0) -> DataFrame:
    """PLB-SQ-013: responses more than ``times`` the mean of their endpoint; the means are one row an endpoint."""
    rows = log.withColumns({"path": path, "size": size})
    means = settled(rows.groupBy("path").agg(F.avg("size").alias("mean")), "means")
    return rows.join(means, "path").where(F.col("size") > times * F.col("mean"))


def short_scripts(log: DataFrame) -> DataFrame:
    """PLB-WS-001: short script names, with how many answers were 2xx and 5xx."""
    rows = log.where(F.col("uri").rlike(SHORT_SCRIPT))
    return rows.groupBy("uri").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("status").between(200, 299)).alias("ok"), F.count_if(F.col("status") >= 500).alias("failed"))


def static_scripts(log: DataFrame) -> DataFrame:
    """PLB-WS-002: scripts that answered from folders of static files."""
    return log.where(F.col("uri").rlike(STATIC_SCRIPT) & (F.col("status") == 200))


def uploads_used(log: DataFrame, path: Column, ties: Sequence[str], within_us: int = MINUTE) -> DataFrame:
    """PLB-WS-009: a path that answered 200 within ``within_us`` of a POST to it: pairs of rows that follow each other."""
    rows = log.withColumn("path", path).where("status = 200")
    seen = looking_back(rows, ["path"], "us", ties, 1, lambda w: {"was": F.lag("method").over(w), "was_us": F.lag("us").over(w)})
    return seen.where((F.col("was") == "POST") & (F.col("us") - F.col("was_us") <= within_us))


def nested_decoders(text: Column, at_least: int = 3) -> Column:
    """PLB-WS-007: at least so many decoding calls."""
    return F.regexp_count(blank(text), F.lit(DECODERS)) >= at_least


def block_sized(payload: Column) -> Column:
    """PLB-WS-004: base 64 of whole 16-byte blocks."""
    plain = F.try_to_binary(payload, F.lit("base64"))
    return F.coalesce(payload.rlike("^[A-Za-z0-9+/]{22,}={0,2}$") & (F.length(plain) % 16 == 0), F.lit(False))


def fixed_size(posts: DataFrame, keys: Sequence[str], size: str = "size", entropy: str = "entropy", over: float = 7.5, at_least: int = 3) -> DataFrame:
    """PLB-WS-003: keys whose bodies all have one size and look encrypted."""
    sizes = posts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.min(entropy).alias("entropy"))
    return sizes.where((F.col("n") >= at_least) & (F.col("least") == F.col("most")) & (F.col("entropy") > over))


def callbacks(flows: DataFrame, ports: Sequence[int] = CALLBACK_PORTS) -> DataFrame:
    """PLB-CE-013: connections to outside at ports of callback servers."""
    return flows.where(F.col("dst_port").isin(*ports) & ~is_internal(F.col("dst_ip")))


def long_heartbeats(flows: DataFrame, usual: Sequence[int], seconds: float = 3600.0) -> DataFrame:
    """PLB-LM-012: pairs of hosts with long connections at unusual ports."""
    odd = flows.where(~F.col("dst_port").isin(*usual) & (F.col("duration_s") >= seconds))
    return odd.groupBy("src_ip", "dst_ip", "dst_port").agg(F.count(F.lit(1)).alias("flows"), F.sum("duration_s").alias("seconds"))


def wmi_children(events: DataFrame, parent: Column, child: Column, shells: Sequence[str] = ("cmd.exe", "powershell.exe")) -> DataFrame:
    """PLB-LM-004: shells started by the WMI host."""
    return events.where((F.col("event_id") == 4688) & (parent == "wmiprvse.exe") & child.isin(*shells))


def share_log_ins(events: DataFrame, logon_type: Column, share: Column, within_us: int = 10 * MINUTE) -> DataFrame:
    """PLB-LM-003: network log-ins followed by the use of a hidden share on the same computer: ``next`` is that event's record."""
    log_ins = events.where((F.col("event_id") == 4624) & logon_type.isin("3", "5"))
    return followed_by(log_ins, events.where((F.col("event_id") == 5145) & share.rlike(SHARES)), ["computer", "user"], within_us, "record_id")


def odd_tickets(events: DataFrame, service: Column) -> DataFrame:
    """PLB-LM-014: service tickets for the ticket-granting account."""
    return events.where((F.col("event_id") == 4769) & (F.lower(service) == "krbtgt"))


def catalog_reads(log: DataFrame, text: Column, business: DataFrame) -> DataFrame:
    """PLB-SQ-014: reads of the database's own tables by accounts that aren't in ``business`` (column ``user``)."""
    reads = log.where(text.rlike(r"(?i)information_schema\.|mysql\.user"))
    return reads.join(business.select("user").distinct(), "user", "left_anti")


def slow_exfiltration(flows: DataFrame, at_least: int, seconds: float = 1800.0) -> DataFrame:
    """Sources whose long flows together sent at least so many bytes, with none of them large."""
    long = flows.where(F.col("duration_s") >= seconds)
    return long.groupBy("src_ip").agg(F.sum("bytes_a2b").alias("sent"), F.max("bytes_a2b").alias("largest")).where((F.col("sent") >= at_least) & (F.col("largest") < at_least / 10))


def new_places(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PLB-LM-009, 011 and 015: rows whose key isn't in the baseline."""
    return rows.join(known.select(*keys).distinct(), list(keys), "left_anti")


def shared_payloads(alerts: DataFrame, at_least: int = 3) -> DataFrame:
    """Payloads from many sources, by their hash: counted by (payload, source) first."""
    pairs = alerts.select(F.sha2("payload", 256).alias("payload_sha256"), "src_ip").distinct()
    return pairs.groupBy("payload_sha256").agg(F.count(F.lit(1)).alias("sources")).where(F.col("sources") >= at_least)


def wide_sources(alerts: DataFrame, value: str, at_least: int) -> DataFrame:
    """Sources with ``at_least`` different values: categories (WAF) or destinations."""
    return alerts.select("src_ip", value).distinct().groupBy("src_ip").agg(F.count(value).alias("kinds")).where(F.col("kinds") >= at_least)
