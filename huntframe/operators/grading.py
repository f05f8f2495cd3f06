"""Severity arithmetic, triage, and escalation of findings by what happens around them.

Findings here are rows with ``us``, ``severity`` and the columns that a rule names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe.functions.text import blank, has_any
from huntframe.operators.findings import level_rank, raised
from huntframe.operators.windows import HOUR, MINUTE, after_first, first_rows, followed_by, trailing
from huntframe.sources.store import settled

# Fixed values.
FLOORS = ((9, "P0"), (7, "P1"), (5, "P2"))
FORGIVEN = 4
DAY_LIMIT = 500
HEALTH_PATHS = ("/healthz", "/ping", "/actuator/health")
PROBES = ("prometheus", "zabbix", "nagios")
CRAWLERS = ("googlebot", "bingbot")
SCANNERS = ("nuclei", "xray", "dirsearch", "fscan")


def graded(base: Column, boost: Column, penalty: Column) -> Column:
    """Level of base + boost - penalty; a penalty of 4 or more always gives P3."""
    total = base + boost - penalty
    out = F.when(penalty >= FORGIVEN, F.lit("P3"))
    for floor, level in FLOORS:
        out = out.when(total >= floor, level)
    return out.otherwise(F.lit("P3"))


def distinct_trailing(df: DataFrame, keys: Sequence[str], value: str, us: str, ties: Sequence[str], window_us: int, name: str = "kinds") -> DataFrame:
    """Adds the number of different values of the key in the trailing window, the row itself included.

    Rows of one value that follow each other within the window are one spell of it.  The
    number is that of the spells begun so far less those that ended before the window, so no
    set is kept.  Null values count nothing.
    """
    size = max(window_us, min(8 * window_us, 8 * HOUR))
    slab = F.floor(F.col(us) / size).cast("bigint")
    late = F.col(us) >= (slab + 1) * size - window_us
    rows = df.where(F.col(us).isNotNull()).withColumn("__own", slab).withColumn("__slab", F.explode(F.when(late, F.array(slab, slab + 1)).otherwise(F.array(slab))))
    rows = rows.repartition(*keys, "__slab")  # serves all three windows
    same = Window.partitionBy(*keys, "__slab", value).orderBy(us, *ties)
    so_far = Window.partitionBy(*keys, "__slab").orderBy(us, *ties).rowsBetween(Window.unboundedPreceding, 0)
    too_old = Window.partitionBy(*keys, "__slab").orderBy(us).rangeBetween(Window.unboundedPreceding, -(window_us + 1))
    before, after = F.col(us) - F.lag(us).over(same), F.lead(us).over(same) - F.col(us)
    begins = (F.col(value).isNotNull() & (before.isNull() | (before > window_us))).cast("bigint")
    ends = (F.col(value).isNotNull() & (after.isNull() | (after > window_us))).cast("bigint")
    rows = rows.withColumns({"__begins": begins, "__ends": ends})
    rows = rows.withColumn(name, F.sum("__begins").over(so_far) - F.coalesce(F.sum("__ends").over(too_old), F.lit(0)))
    return rows.where("__own = __slab").drop("__own", "__slab", "__begins", "__ends")


def escalate_rules(found: DataFrame, ties: Sequence[str], window_us: int = 5 * MINUTE, at_least: int = 3) -> DataFrame:
    """Findings of an address with ``at_least`` different rules in the window go up one level."""
    out = distinct_trailing(found, ["src_ip"], "rule_id", "us", ties, window_us, "kinds")
    return out.withColumn("raised", F.when(F.col("kinds") >= at_least, raised(F.col("severity"))).otherwise(F.col("severity")))


def escalate_hosts(found: DataFrame, ties: Sequence[str], window_us: int = 10 * MINUTE, at_least: int = 3) -> DataFrame:
    """Findings of a user on ``at_least`` hosts in the window go up one level and are tagged ``lateral``."""
    out = distinct_trailing(found, ["user"], "host", "us", ties, window_us, "hosts")
    many = F.col("hosts") >= at_least
    return out.withColumns({"raised": F.when(many, raised(F.col("severity"))).otherwise(F.col("severity")), "tag": F.when(many, F.lit("lateral"))})


def escalate_assets(found: DataFrame, ties: Sequence[str], window_us: int = 30 * MINUTE, at_least: int = 5) -> DataFrame:
    """Findings on a destination with ``at_least`` sources in the window go up one level."""
    out = distinct_trailing(found, ["dst_ip"], "src_ip", "us", ties, window_us, "sources")
    many = F.col("sources") >= at_least
    return out.withColumns({"raised": F.when(many, raised(F.col("severity"))).otherwise(F.col("severity")), "tag": F.when(many, F.lit("asset-of-interest"))})


def escalate_volume(found: DataFrame, ties: Sequence[str], window_us: int = HOUR, at_least: int = 10) -> DataFrame:
    """Findings of P2 or worse of an address that has ``at_least`` of them in the window become P1."""
    out = trailing(found, ["src_ip"], "us", ties, window_us, {"serious": (level_rank(F.col("severity")) <= 2).cast("bigint")})
    due = (F.col("serious") >= at_least) & (level_rank(F.col("severity")) == 2)
    return out.withColumn("raised", F.when(due, F.lit("P1")).otherwise(F.col("severity")))


def campaigns(found: DataFrame, ties: Sequence[str], window_us: int = 5 * MINUTE, at_least: int = 5) -> DataFrame:
    """Findings of an address with a P0 among ``at_least`` findings in the window are tagged ``campaign``."""
    sums = {"events": F.lit(1).cast("bigint"), "worst": (F.col("severity") == "P0").cast("bigint")}
    out = trailing(found, ["src_ip"], "us", ties, window_us, sums)
    return out.withColumn("tag", F.when((F.col("events") >= at_least) & (F.col("worst") > 0), F.lit("campaign")))


def stages_in_order(found: DataFrame, keys: Sequence[str], stage: str, stages: Sequence[str], us: str = "us") -> DataFrame:
    """Keys whose stages all occur, each after the first row of the one before: one row a key with the time of each.

    For the second and later stages this needs the first row after a time that another
    aggregate finds, so it is one join a stage; each side has one row a key.
    """
    at = settled(found.where(F.col(stage) == stages[0]).groupBy(*keys).agg(F.min(us).alias(f"{stages[0]}_us")), "stages")
    for last, s in zip(stages, stages[1:], strict=False):
        later = found.where(F.col(stage) == s).select(*keys, F.col(us).alias("__us")).join(at, list(keys)).where(F.col("__us") > F.col(f"{last}_us"))
        names = [f"{x}_us" for x in stages[: stages.index(s)]]
        at = settled(later.groupBy(*keys).agg(F.min("__us").alias(f"{s}_us"), *[F.first(n).alias(n) for n in names]), "stages")
    return at


def unescalated(found: DataFrame, whitelist: DataFrame, first_hour: int, last_hour: int) -> DataFrame:
    """Findings of whitelisted scanners (column ``src_ip``) within their hours become P3."""
    mine = settled(whitelist.select("src_ip", F.lit(True).alias("__known")).distinct(), "whitelist")
    hour = F.hour(F.timestamp_micros("us"))
    due = F.col("__known") & hour.between(first_hour, last_hour)
    return found.join(mine, "src_ip", "left").withColumn("lowered", F.when(due, F.lit("P3")).otherwise(F.col("severity"))).drop("__known")


def known_bad(found: DataFrame, history: DataFrame) -> DataFrame:
    """P3 findings of addresses in ``history`` (column ``src_ip``) become P2."""
    mine = settled(history.select("src_ip", F.lit(True).alias("__known")).distinct(), "history")
    due = F.col("__known") & (F.col("severity") == "P3")
    return found.join(mine, "src_ip", "left").withColumn("raised", F.when(due, F.lit("P2")).otherwise(F.col("severity"))).drop("__known")


def tool_then_sensitive(log: DataFrame, tool: Column, sensitive: Column, ties: Sequence[str]) -> DataFrame:
    """Sensitive paths that answered 200 to an address that had used a tool before: they are P1."""
    marks = first_rows(log.where(tool & (blank(F.col("src_ip")) != "")), ["src_ip"], "us", ties).select("src_ip", F.col("us").alias("tool_us"), *ties)
    marks = settled(marks, "marks")
    return after_first(log.where(sensitive & (F.col("status") == 200)), marks, ["src_ip"], "us", ties, "tool_us", 1 << 62)


def silent_scanners(log: DataFrame, until: DataFrame, quiet_us: int = 24 * HOUR) -> DataFrame:
    """Addresses that only got client errors and were quiet for the last ``quiet_us`` before ``until`` (one row, ``until_us``): they go down to P3."""
    out = log.groupBy("src_ip").agg(F.min("status").alias("least"), F.max("status").alias("most"), F.max("us").alias("last_us"))
    out = out.where(F.col("least").between(400, 499) & F.col("most").between(400, 499))
    return out.join(F.broadcast(until), F.col("until_us") - F.col("last_us") >= quiet_us).drop("until_us")


def off_hours_sources(found: DataFrame, ties: Sequence[str], first: int = 22, last: int = 6) -> DataFrame:
    """A user's first finding from each address, if it is at night: it goes up one level."""
    firsts = first_rows(found, ["user", "src_ip"], "us", ties)
    hour = F.hour(F.timestamp_micros("us"))
    return firsts.where((hour >= first) | (hour < last)).withColumn("raised", raised(F.col("severity")))


def log_chain(log: DataFrame, scanner: Column, exploit: Column, shell: Column) -> DataFrame:
    """C3: addresses that scanned, then used an exploit, then reached a script of a short name, with the first time of each."""
    stages = ("scanner", "exploit", "shell")
    marks = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in zip(stages, (scanner, exploit, shell), strict=True)]))
    rows = log.where(blank(F.col("src_ip")) != "").withColumn("stage", F.explode(marks)).select("src_ip", "us", "stage")
    return stages_in_order(settled(rows, "stages"), ["src_ip"], "stage", stages)


def escalate_traffic(found: DataFrame, ties: Sequence[str], soon_us: int = 5 * MINUTE, later_us: int = 24 * HOUR, much: int = 100 * 1024 * 1024) -> DataFrame:
    """C7: hits with ``kind`` (scanner, payload, webshell, exfiltration) and their level after what follows them, as ``raised``.

    A P2 scanner becomes P1 if a payload of its address follows soon; a P1 payload that was answered
    with 200 becomes P0 if a web shell's mark follows at its URI; a P1 exfiltration of more than ``much``
    bytes in one flow becomes P0.
    """
    kind = lambda k, level: (F.col("kind") == k) & (F.col("severity") == level)
    payloads = found.where("kind = 'payload'")
    scans = followed_by(found.where(kind("scanner", "P2")), payloads, ["src_ip"], soon_us, ties[-1]).select(*ties, F.lit("P1").alias("__to"))
    dropped = followed_by(payloads.where((F.col("severity") == "P1") & (F.col("status") == 200)), found.where("kind = 'webshell'"), ["uri"], later_us, ties[-1])
    marks = settled(scans.unionByName(dropped.select(*ties, F.lit("P0").alias("__to"))), "marks")
    large = F.when(kind("exfiltration", "P1") & (F.col("bytes") > much), F.lit("P0"))
    return found.join(marks, list(ties), "left").withColumn("raised", F.coalesce(large, "__to", "severity")).drop("__to")


def full_response(found: DataFrame, at_least: int = 3) -> DataFrame:
    """C7: sources of P0 hits on ``at_least`` hosts, for which a full response is due."""
    hosts = found.where("raised = 'P0'").groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("hits"))
    return hosts.groupBy("src_ip").agg(F.count("dst_ip").alias("hosts"), F.sum("hits").alias("hits")).where(F.col("hosts") >= at_least)


def priority(long_body: int = 10_000) -> Column:
    """T3: ``struct(level, fp)`` of an alert, from ``category, severity, status, body_bytes, tool, scanner, success, all_missing,
    harmless, ioc_confidence, iocs, fp``.

    Success after brute force is P0; code execution P1, or P0 if it was answered with 200 and some body; a
    scanner that found nothing P3; a tool P2 or P3, or P1 if it met an error of the server, a long body or several
    indicators.  A sure indicator raises what comes out by one.  What is known to be harmless keeps its
    level and is likely a false alarm.
    """
    status, body = F.coalesce("status", F.lit(0)), F.coalesce("body_bytes", F.lit(0))
    severe = F.col("category").isin("rce", "deserialization", "jndi", "fastjson")
    busy = (status >= 500) | (body > long_body) | (F.coalesce("iocs", F.lit(0)) >= 2)
    level = (
        F.when(F.col("success") & (F.col("category") == "brute-force"), F.lit("P0"))
        .when(severe & (status == 200) & (body > 200), F.lit("P0"))
        .when(severe, F.when(F.col("severity") == "P0", F.lit("P0")).otherwise(F.lit("P1")))
        .when(F.col("scanner") & F.col("all_missing"), F.lit("P3"))
        .when(F.col("tool") & busy, F.lit("P1"))
        .when(F.col("tool"), F.when(F.col("severity") == "P3", F.lit("P3")).otherwise(F.lit("P2")))
        .otherwise(F.col("severity"))
    )
    level = F.when(F.lower(blank(F.col("ioc_confidence"))) == "high", raised(level)).otherwise(level)
    fp = F.coalesce("fp", F.lit(0.0))
    return F.struct(level.alias("level"), F.when(F.col("harmless"), F.greatest(fp, F.lit(0.8))).otherwise(fp).alias("fp"))


def by_source(found: DataFrame) -> DataFrame:
    """Per address: different rules, and the worst level raised by one for 3 rules and to P0 for 5."""
    pairs = found.groupBy("src_ip", "rule_id").agg(F.min("severity").alias("severity"))
    out = pairs.groupBy("src_ip").agg(F.count(F.lit(1)).alias("rules"), F.min("severity").alias("worst"))
    return out.withColumn("raised", F.when(F.col("rules") >= 5, F.lit("P0")).when(F.col("rules") >= 3, raised(F.col("worst"))).otherwise(F.col("worst")))


def by_view(found: DataFrame) -> DataFrame:
    """Per address: different views, and the worst level raised by one for 2 views and to P0 for 3."""
    pairs = found.groupBy("src_ip", "view").agg(F.min("severity").alias("severity"))
    out = pairs.groupBy("src_ip").agg(F.count(F.lit(1)).alias("views"), F.min("severity").alias("worst"))
    return out.withColumn("raised", F.when(F.col("views") >= 3, F.lit("P0")).when(F.col("views") == 2, raised(F.col("worst"))).otherwise(F.col("worst")))


def triage() -> Column:
    """The triage tree over an alert's ``category, action, status, payload, user_agent, severity, success,
    fails_per_min, error_ratio, sensitive_ok, whitelisted, followed``: the first branch that holds."""
    blocked = F.lower(blank(F.col("action"))) == "block"
    agent = F.lower(blank(F.col("user_agent")))
    payload = F.lower(blank(F.col("payload")))
    deserial = has_any(payload, ("fastjson", "log4j", "jndi", "shiro", "rememberme"))
    dropped = payload.rlike("\\.(?:jspx?|php)\\b") & (F.col("status") == 200) & (F.col("category") == "webshell")
    words = has_any(payload, ("union", "sleep"))
    ratio = F.coalesce(F.col("error_ratio"), F.lit(0.0))
    fails = F.coalesce(F.col("fails_per_min"), F.lit(0))
    return (
        F.when((F.col("severity") == "P1") & blocked & ~F.col("followed"), "P2")
        .when(dropped, "P0")
        .when(deserial & ~blocked & (F.col("status") == 200), "P0")
        .when(deserial & ~blocked & (F.col("status") >= 400), "P1")
        .when(deserial & blocked, "P2")
        .when((F.col("category") == "brute-force") & F.col("success"), "P0")
        .when((F.col("category") == "brute-force") & (fails >= 100), "P1")
        .when((F.col("category") == "brute-force") & (fails >= 20), "P2")
        .when(F.col("category") == "brute-force", "P3")
        .when(agent.contains("sqlmap") & (ratio < 0.5) & words, "P1")
        .when(agent.contains("sqlmap") & (ratio >= 1.0) & F.col("whitelisted"), "P3")
        .when(agent.contains("sqlmap") & (ratio >= 0.5), "P2")
        .when(has_any(agent, SCANNERS) & F.col("sensitive_ok"), "P1")
        .when(has_any(agent, SCANNERS), "P2")
        .when(F.col("whitelisted"), "P3")
        .otherwise("P2")
    )


def false_alarm(uri: Column, ua: Column, whitelisted: Column) -> Column:
    """Why a record is likely harmless; null if nothing says so."""
    return (
        F.when(whitelisted, F.lit("scanner-whitelist"))
        .when(blank(uri).isin(*HEALTH_PATHS), F.lit("health-check"))
        .when(has_any(ua, PROBES), F.lit("monitoring"))
        .when(has_any(ua, CRAWLERS), F.lit("crawler"))
    )


def noisy_rules(alerts: DataFrame, more_than: int = DAY_LIMIT) -> DataFrame:
    """Rules that fired more than ``more_than`` times on a day, every time blocked."""
    days = alerts.groupBy("rule_name", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min((F.lower(blank(F.col("action"))) == "block").cast("int")).alias("all_blocked"))
    return days.where((F.col("n") > more_than) & (F.col("all_blocked") == 1)).select("rule_name", "day", "n")
