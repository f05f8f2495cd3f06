"""Rules on web access logs: R-NGX-001 to 010."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.text import blank, first_match, truncated
from huntframe.functions.time import micros, parsed
from huntframe.operators.findings import Branch, as_findings, hits, ioc, one_rule
from huntframe.operators.windows import MINUTE, burst
from huntframe.rules.libraries import UA_SIGNATURES

# Patterns, methods and thresholds.
SENSITIVE_PATH = (
    r"(?i)/(\.git/|\.env(?:\.|$|/|\?)|wp-admin|wp-login\.php|actuator(?:/|$)|swagger|"
    r"\.ssh/|/etc/passwd|/proc/self|phpinfo\.php|phpmyadmin|console/login|"
    r"manager/html|jmx-console|web-console)"
)
TRAVERSAL = r"(?i)(?:\.\./|\.\.%2f|%2e%2e/|\.\.%5c|\.\.\\|\.\.\\\\)"
SQL_INJECTION = (
    r"(?i)(\bunion\s+(?:all\s+)?select\b|\bsleep\(\s*\d+\s*\)|\bbenchmark\(\s*\d+|"
    r"'\s*or\s*'1|\"\s*or\s*\"1|\bextractvalue\b|\bupdatexml\b|\bload_file\b|"
    r"information_schema\.tables)"
)
CODE_EXECUTION = (
    r"(?i)(\$\{jndi:|Runtime\.getRuntime|java\.lang\.Runtime|ProcessBuilder|"
    r"@type[\"']\s*:\s*[\"']com\.|fastjson|TemplatesImpl|cmd\.exe|/bin/(?:sh|bash)\b|"
    r"[?&](?:cmd|exec|command|c)=(?:cat|ls|whoami|id|uname|wget|curl|nc|bash|sh)\b|"
    r"%20(?:/etc/(?:passwd|shadow|hosts)|/proc/self)|"
    r";(?:cat|ls|whoami|id|wget|curl|nc)\s|"
    r"\|(?:cat|ls|whoami|id|wget|curl|nc)\s|"
    r"`(?:cat|ls|whoami|id|wget|curl)\s|"
    r"\$\((?:cat|ls|whoami|id|wget|curl)\s)"
)
METHODS = ("PUT", "PATCH", "TRACE", "CONNECT", "DELETE", "PROPFIND", "MOVE")
BODY_SIZE = r"\"\s+\d{3}\s+(\d+)\s+\""
SYMBOLS_ONLY = r"^[^\p{L}\p{Nd}]+$"
LONG_URI, LARGE_BODY, SHORT_UA = 1000, 10 * 1024 * 1024, 5
BURST_WINDOW, BURST_ROWS = 5 * MINUTE, 50

TIES = ("src_file", "line_no")


def timed(log: DataFrame) -> DataFrame:
    """Adds ``us`` where it is missing: the record's time in microseconds, null if it has none."""
    return log if "us" in log.columns else log.withColumn("us", micros(parsed(F.col("ts"))))


def signature_of(ua: Column, signatures: Sequence[tuple] = UA_SIGNATURES) -> Column:
    """``id`` and ``tool`` of the first signature that a non-empty user agent matches."""
    value = lambda s: F.struct(F.lit(s[0]).alias("sig_id"), F.lit(s[1]).alias("tool"))
    found = first_match((ua.rlike(s[2]), value(s)) for s in signatures)
    return F.when(blank(ua) != "", found)


def body_bytes(raw_line: Column) -> Column:
    return F.regexp_extract(blank(raw_line), BODY_SIZE, 1).try_cast("bigint")


def branches(signatures: Sequence[tuple] = UA_SIGNATURES) -> list[Branch]:
    """The rules that look at one record; ``signature`` must be a column already."""
    uri, ua, method = blank(F.col("uri")), blank(F.col("ua")), F.upper(blank(F.col("method")))
    return [
        Branch("R-NGX-001", F.col("signature").isNotNull(), {"sig_id": F.col("signature.sig_id"), "tool": F.col("signature.tool")}),
        Branch("R-NGX-003", uri.rlike(SENSITIVE_PATH)),
        Branch("R-NGX-004", F.length(uri) > LONG_URI, {"uri_len": F.length(uri)}),
        Branch("R-NGX-005", method.isin(*METHODS), {"method": method}),
        Branch("R-NGX-006", uri.rlike(TRAVERSAL)),
        Branch("R-NGX-007", uri.rlike(SQL_INJECTION)),
        Branch("R-NGX-008", uri.rlike(CODE_EXECUTION)),
        Branch("R-NGX-009", body_bytes(F.col("raw_line")) > LARGE_BODY, {"body_bytes": body_bytes(F.col("raw_line"))}),
        Branch("R-NGX-010", (F.length(ua) < SHORT_UA) | ua.rlike(SYMBOLS_ONLY), {"ua_repr": truncated(F.concat(F.lit("'"), ua, F.lit("'")), 80)}),
    ]


def client_errors(log: DataFrame) -> DataFrame:
    return timed(log).where("status BETWEEN 400 AND 499 AND src_ip <> ''")


def detect(
    log: DataFrame, signatures: Sequence[tuple] = UA_SIGNATURES, window_us: int = BURST_WINDOW, at_least: int = BURST_ROWS
) -> DataFrame:
    """Records of LOG to (record, ``ordinal, rule_id, severity, extra``), a row for each rule that reports.

    R-NGX-002 reports an address once: at its first record with ``at_least`` client errors
    within ``window_us``.  Null fields count as empty.
    """
    log = timed(log)
    plain = hits(log.withColumn("signature", signature_of(F.col("ua"), signatures)), branches(signatures)).drop("signature")
    flood = burst(client_errors(log), ["src_ip"], "us", TIES, window_us, at_least)
    flood = one_rule(flood, "R-NGX-002", 1, {"4xx_count_5min": F.col("n")}).select(*plain.columns)
    # The burst stands second in a record.
    plain = plain.withColumn("ordinal", F.when(F.col("ordinal") > 0, F.col("ordinal") + 1).otherwise(F.col("ordinal")))
    return plain.unionByName(flood)


def findings(log: DataFrame, **options) -> DataFrame:
    """The same as findings ``NGX-001``, ``NGX-002``, ..."""
    evidence = {c: F.col(c) for c in ("ts", "src_ip", "method", "status", "src_file", "line_no")}
    evidence |= {"uri": F.substring(blank(F.col("uri")), 1, 300), "ua": F.substring(blank(F.col("ua")), 1, 200)}
    place = F.concat_ws("", F.col("rule_id"), F.lit("@"), F.col("src_file"), F.lit(":"), F.col("line_no"))
    address = F.when(
        blank(F.col("src_ip")) != "", ioc("ip", F.col("src_ip"), "medium", F.col("ts"), place, F.concat(F.lit("rule:"), F.col("rule_id")))
    )
    agent = F.when(
        F.col("rule_id") == "R-NGX-001", ioc("ua", F.substring("ua", 1, 200), "high", F.col("ts"), F.col("rule_id"), F.lit("tool"))
    )
    return as_findings(detect(log, **options), "NGX", evidence, F.array_compact(F.array(address, agent)))
