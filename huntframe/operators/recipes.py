"""Everyday questions to access and log-in logs, and to records of remote commands, as small queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.net import is_internal
from huntframe.functions.text import blank
from huntframe.operators.windows import looking_back, running
from huntframe.rules.ngx import LARGE_BODY, TIES, body_bytes, timed

# Fixed values.
ODD_METHODS = ("PUT", "DELETE", "PATCH", "TRACE", "CONNECT", "OPTIONS", "PROPFIND", "MOVE")
SSH_PORTS = ("22", "2222", "22222")
FORBIDDEN = ("|", ";", "&", "`", "$(", ">", "<", "\n", "\r", "\\")
MAX_ARGUMENT = 512


def busiest(df: DataFrame, keys: Sequence[str], n: int, name: str = "hits") -> DataFrame:
    """The ``n`` most frequent keys, ties by key: a top-k report."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), *keys).limit(n)


# Access logs ---------------------------------------------------------------------------


def errors(log: DataFrame) -> DataFrame:
    return log.where("status >= 400")


def status_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("hits"))


def heavy_clients(log: DataFrame, at_least: int = 200) -> DataFrame:
    return log.groupBy("src_ip").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= at_least)


def wide_clients(log: DataFrame, at_least: int = 50) -> DataFrame:
    """Addresses with many different URIs; counted by (address, URI) first, so a busy address is no hot group."""
    return log.select("src_ip", "uri").distinct().groupBy("src_ip").agg(F.count("uri").alias("uris")).where(F.col("uris") >= at_least)


def odd_methods(log: DataFrame) -> DataFrame:
    return log.where(F.upper(blank(F.col("method"))).isin(*ODD_METHODS))


def long_uris(log: DataFrame, at_least: int = 500) -> DataFrame:
    return log.where(F.length("uri") >= at_least)


def large_responses(log: DataFrame, over: int = LARGE_BODY, n: int = 10) -> DataFrame:
    return log.withColumn("bytes", body_bytes(F.col("raw_line"))).where(F.col("bytes") > over).orderBy(F.col("bytes").desc(), *TIES).limit(n)


def large_posts(log: DataFrame, over: int = 4096) -> DataFrame:
    return log.withColumn("bytes", body_bytes(F.col("raw_line"))).where((F.col("method") == "POST") & (F.col("bytes") > over))


def bare_agents(log: DataFrame, under: int = 20) -> DataFrame:
    """No referer and a short agent."""
    referer = F.regexp_extract(blank(F.col("raw_line")), r'"\s+\d{3}\s+\S+\s+"([^"]*)"\s+"[^"]*"', 1)
    return log.where(referer.isin("", "-") & (F.length(blank(F.col("ua"))) < under))


# Log-in logs ---------------------------------------------------------------------------


def failed(msg: Column) -> Column:
    return msg.startswith("ssh-fail") | msg.contains("Failed password") | msg.contains("Failed publickey")


def success_after_many(log: DataFrame, at_least: int = 5) -> DataFrame:
    """Successes of an address after ``at_least`` failures, whenever those were."""
    msg = blank(F.col("msg"))
    marked = timed(log).where("src_ip <> ''").withColumn("__failed", failed(msg).cast("bigint"))
    so_far = running(marked, ["src_ip"], "us", TIES, {"fails": F.col("__failed")})
    return so_far.where(msg.startswith("ssh-success") & (F.col("fails") >= at_least)).drop("__failed")


def sprayed_minutes(log: DataFrame, at_least: int = 1) -> DataFrame:
    """Different users that failed in each minute."""
    minute = F.date_format(F.date_trunc("minute", F.timestamp_micros("us")), "yyyy-MM-dd HH:mm")
    users = timed(log).where(failed(blank(F.col("msg")))).select(minute.alias("minute"), "user").distinct()
    return users.groupBy("minute").agg(F.count("user").alias("users")).where(F.col("users") >= at_least)


def outside_roots(log: DataFrame) -> DataFrame:
    """Root's successes from addresses that aren't internal."""
    return log.where(blank(F.col("msg")).startswith("ssh-success") & (F.col("user") == "root") & ~is_internal(F.col("src_ip")))


def sessions(log: DataFrame, keys: Sequence[str] = ("user",)) -> DataFrame:
    """Openings with the closing that follows directly, and how long that was."""
    opened, closed = blank(F.col("msg")).contains("session opened"), blank(F.col("msg")).contains("session closed")
    marked = timed(log).where(opened | closed).withColumn("__opened", opened)
    was = lambda w: {"was_opened": F.lag("__opened").over(w), "opened_us": F.lag("us").over(w)}
    pairs = looking_back(marked, list(keys), "us", TIES, 1, was).where(~F.col("__opened") & F.col("was_opened"))
    return pairs.select(*keys, "opened_us", F.col("us").alias("closed_us"), ((F.col("us") - F.col("opened_us")) / 1e6).alias("seconds"))


def commands_outside(log: DataFrame, allowed: str) -> DataFrame:
    """sudo commands that the pattern ``allowed`` doesn't cover."""
    command = F.regexp_extract(blank(F.col("msg")), "COMMAND=(.*)$", 1)
    return log.withColumn("command", command).where((F.col("command") != "") & ~F.col("command").rlike(allowed))


def log_ins(log: DataFrame) -> DataFrame:
    """Successes with how they were made."""
    msg = blank(F.col("msg"))
    return log.where(msg.startswith("ssh-success")).select("ts", "user", "src_ip", F.regexp_extract(msg, "ssh-success (\\S+)", 1).alias("auth_method"), *TIES)


def account_changes(log: DataFrame) -> DataFrame:
    return log.where(blank(F.col("msg")).rlike(r"\b(useradd|userdel|usermod|groupadd|groupdel|passwd|new user|delete user)\b"))


def root_rights(log: DataFrame) -> DataFrame:
    """Accounts with UID 0, and switches to root."""
    return log.where(blank(F.col("msg")).rlike(r"\bUID=0\b|\bto root\b|\(to root\)"))


def disconnects(log: DataFrame) -> DataFrame:
    """Connections that ended before a log-in."""
    return log.where(blank(F.col("msg")).rlike(r"Received disconnect|Connection closed|Disconnected from"))


def key_fingerprints(log: DataFrame) -> DataFrame:
    """The different keys that were shown, with their users."""
    key = F.regexp_extract(blank(F.col("msg")), r"((?:SHA256|MD5):[A-Za-z0-9+/:=]+)", 1)
    return log.withColumn("fingerprint", key).where("fingerprint <> ''").select("user", "fingerprint").distinct()


def odd_ports(log: DataFrame, usual: Sequence[str] = SSH_PORTS) -> DataFrame:
    """Records that name a port which isn't one of ``usual``."""
    port = F.regexp_extract(blank(F.col("msg")), r"\bport (\d+)", 1)
    return log.withColumn("port", port).where((F.col("port") != "") & ~F.col("port").isin(*usual))


def uris_of(log: DataFrame, ip: str) -> DataFrame:
    """How often an address asked for each URI."""
    return log.where(F.col("src_ip") == ip).groupBy("uri").agg(F.count(F.lit(1)).alias("hits"))


def error_shares(log: DataFrame) -> DataFrame:
    """Per address: answers of 200, errors, and the share of errors."""
    out = log.groupBy("src_ip").agg(F.count_if(F.col("status") == 200).alias("ok"), F.count_if(F.col("status") >= 400).alias("errors"), F.count(F.lit(1)).alias("hits"))
    return out.withColumn("error_share", F.col("errors") / F.col("hits"))


def slow_and_steady(log: DataFrame, least: int = 10, most: int = 20, hours: int = 3) -> DataFrame:
    """Addresses with ``least`` to ``most`` errors in each of at least so many hours, and never more."""
    hour = F.floor(F.col("us") / 3_600_000_000)
    counts = timed(log).where("status >= 400").groupBy("src_ip", hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("src_ip").agg(F.count_if(F.col("n").between(least, most)).alias("hours"), F.max("n").alias("busiest"))
    return out.where((F.col("hours") >= hours) & (F.col("busiest") <= most))


def night_shares(log: DataFrame, first: int = 2, last: int = 5) -> DataFrame:
    """Per address the share of its records between two hours of the night."""
    hour = F.hour(F.timestamp_micros("us"))
    return timed(log).groupBy("src_ip").agg(F.count_if(hour.between(first, last - 1)).alias("night"), F.count(F.lit(1)).alias("hits"))


# Remote commands -----------------------------------------------------------------------


def tier() -> Column:
    return F.coalesce("tier", "cmd_tier")


def audit_totals(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.sum("duration_ms").alias("total_ms"),
        F.floor(F.sum("stdout_bytes") / 1024).cast("bigint").alias("total_stdout_kb"),
    )


def audit_mutating(audit: DataFrame, day: str) -> DataFrame:
    return audit.where((tier() == 3) & F.col("ts").startswith(day))


def audit_rejected(audit: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Calls that were refused, with the columns in ``keep`` too."""
    return audit.where(F.col("action").isin("validation_failed", "authorization_denied")).select(*keep, "ts", "cmd_id", "error_hint")


def audit_sequence(audit: DataFrame, target: str) -> DataFrame:
    return audit.where(F.col("target") == target).orderBy("ts").select("ts", tier().alias("tier"), "cmd_id", "exit_code")


def call_verdict(calls: DataFrame, commands: DataFrame) -> DataFrame:
    """Planned calls (``authorized_by, target, cmd_id, arg, allow_mutating``) against the command table (``cmd_id,
    tier, pattern``): ``verdict`` 0 allowed, 2 not authorised or malformed, 3 not allowed.  Nothing is run.
    """
    table = commands.select("cmd_id", F.col("tier").alias("cmd_tier"), F.col("pattern").alias("arg_pattern"))
    arg = blank(F.col("arg"))
    bad = F.lit(False)
    for m in FORBIDDEN:
        bad = bad | arg.contains(m)
    # Few rows and a pattern a row: a column pattern is right here.
    misfit = F.col("arg_pattern").isNotNull() & ~F.regexp_like(arg, F.col("arg_pattern"))
    verdict = (
        F.when(F.trim(blank(F.col("authorized_by"))) == "", 2)
        .when(~blank(F.col("target")).rlike("^[^@\\s]+@[^@\\s]+$") | (blank(F.col("cmd_id")) == ""), 2)
        .when(F.col("cmd_tier").isNull(), 3)
        .when((F.col("cmd_tier") == 3) & ~F.coalesce(F.col("allow_mutating"), F.lit(False)), 3)
        .when(bad | misfit | (F.length(arg) > MAX_ARGUMENT), 2)
        .otherwise(0)
    )
    return calls.join(table, "cmd_id", "left").withColumn("verdict", verdict).drop("arg_pattern")
