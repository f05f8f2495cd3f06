"""Rules on Linux log-ins: R-AUTH-001 to 008.

Records are read in the order of their times; the reference order of one file is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.net import subnet
from huntframe.functions.text import blank
from huntframe.operators.findings import Branch, as_findings, hits, ioc, one_rule
from huntframe.operators.windows import MINUTE, after_first, burst, first_rows, trailing
from huntframe.rules.ngx import TIES, timed
from huntframe.sources.store import settled

# Fixed values.
WINDOW, FAILURES, FEW_FAILURES, GRACE = 5 * MINUTE, 20, 5, 30 * MINUTE
SUDO_WINDOW, SUDO_ROWS = 5 * MINUTE, 10
NEW_ACCOUNT = r"\b(useradd|adduser|new user|new group)\b"
NEW_NAME = r"name=([\w\-\.]+)"
OLD_ACCOUNT = r"\b(userdel|deluser|remove user)\b"
OLD_NAME = r"\b(?:userdel|deluser).+?\b([A-Za-z0-9_\-\.]+)['\"]?\s*$"


def _msg() -> Column:
    return blank(F.col("msg"))


def failures(log: DataFrame) -> DataFrame:
    """Failed log-ins that have an address."""
    failed = _msg().startswith("ssh-fail") | _msg().contains("Failed password") | _msg().contains("Failed publickey")
    return timed(log).where(failed & (blank(F.col("src_ip")) != ""))


def successes(log: DataFrame) -> DataFrame:
    return timed(log).where(_msg().startswith("ssh-success") | _msg().contains("Accepted"))


def brute_force(log: DataFrame, window_us: int = WINDOW, at_least: int = FAILURES) -> DataFrame:
    """R-AUTH-001: an address's first failure with ``at_least`` failures in the window, as column ``n``."""
    return burst(failures(log), ["src_ip"], "us", TIES, window_us, at_least)


def success_after_failures(
    log: DataFrame, window_us: int = WINDOW, at_least: int = FAILURES, few: int = FEW_FAILURES, grace_us: int = GRACE
) -> DataFrame:
    """R-AUTH-002: every success within ``grace_us`` of the address's burst; before a burst, every
    success with ``few`` failures in the window.  ``brute_us`` is the burst's time, null for the latter.
    """
    log = timed(log)
    marks = settled(brute_force(log, window_us, at_least).select("src_ip", F.col("us").alias("brute_us"), *TIES), "marks")
    won = successes(log).where(blank(F.col("src_ip")) != "")
    hard = after_first(won, marks, ["src_ip"], "us", TIES, "brute_us", grace_us)
    both = failures(log).withColumn("failed", F.lit(1)).unionByName(won.withColumn("failed", F.lit(0)))
    soft = trailing(both, ["src_ip"], "us", TIES, window_us, {"fails": F.col("failed").cast("bigint")}).where(
        (F.col("failed") == 0) & (F.col("fails") >= few)
    )
    early = marks.select("src_ip", "brute_us", *[F.col(t).alias(f"m_{t}") for t in TIES])
    before = F.struct("us", *TIES) < F.struct("brute_us", *[F.col(f"m_{t}") for t in TIES])
    soft = soft.join(early, "src_ip", "left").where(F.col("brute_us").isNull() | before)
    return hard.withColumn("fails", F.lit(None).cast("bigint")).unionByName(
        soft.drop("failed", *[f"m_{t}" for t in TIES]).withColumn("brute_us", F.lit(None).cast("bigint"))
    )


def new_root_subnets(log: DataFrame, net: Column | None = None) -> DataFrame:
    """R-AUTH-003: root's first success from each /24 (or /64), but for the first of all."""
    net = subnet(F.col("src_ip")) if net is None else net
    roots = successes(log).where("user = 'root' AND src_ip IS NOT NULL AND us IS NOT NULL")
    firsts = first_rows(roots.withColumn("subnet", net).where("subnet IS NOT NULL"), ["subnet"], "us", TIES)
    # One row: the first of all, found by an aggregate.
    first = firsts.agg(F.min(F.struct("us", *TIES)).alias("__first"))
    return firsts.join(F.broadcast(first), F.struct("us", *TIES) > F.col("__first")).drop("__first")


def first_logins(log: DataFrame) -> DataFrame:
    """R-AUTH-006: each user's first success."""
    return first_rows(successes(log).where("user <> ''"), ["user"], "us", TIES)


def deleted_name() -> Column:
    """The account that a deletion names; else the record's user."""
    named = F.regexp_extract(_msg(), OLD_NAME, 1)
    return F.when(_msg().rlike(OLD_ACCOUNT), F.when(named != "", named).otherwise(F.col("user")))


def deleted_users_back(log: DataFrame) -> DataFrame:
    """R-AUTH-007: successes of users that were deleted before."""
    gone = timed(log).withColumn("gone", deleted_name()).where("gone <> ''")
    gone = settled(first_rows(gone.select(F.col("gone").alias("user"), F.col("us").alias("gone_us"), *TIES), ["user"], "gone_us", TIES), "marks")
    return after_first(successes(log).where("user <> ''"), gone, ["user"], "us", TIES, "gone_us", 1 << 62)


def keys_without_baseline(log: DataFrame, baseline: DataFrame) -> DataFrame:
    """R-AUTH-008: public-key successes of users that ``baseline`` (column ``user``) doesn't have."""
    keyed = successes(log).where(_msg().contains("publickey") & (blank(F.col("user")) != ""))
    return keyed.join(baseline.select("user").distinct(), "user", "left_anti")


def sudo_bursts(log: DataFrame, window_us: int = SUDO_WINDOW, at_least: int = SUDO_ROWS) -> DataFrame:
    """R-AUTH-005: an actor's first command with ``at_least`` commands in the window."""
    used = timed(log).where(_msg().contains("sudo") & _msg().contains("COMMAND="))
    actor = F.coalesce(F.nullif(F.col("user"), F.lit("")), F.lit("unknown"))
    return burst(used.withColumn("actor", actor), ["actor"], "us", TIES, window_us, at_least)


def new_accounts(log: DataFrame) -> DataFrame:
    """R-AUTH-004: records that make an account, with its name."""
    named = F.regexp_extract(_msg(), NEW_NAME, 1)
    name = F.when(named != "", named).otherwise(F.col("user"))
    return hits(timed(log), [Branch("R-AUTH-004", _msg().rlike(NEW_ACCOUNT), {"new_user": name})])


def detect(log: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Records of LOG (``log_type`` linux-auth) to (record, ``ordinal, rule_id, severity, extra``)."""
    log = timed(log)
    parts = [
        one_rule(brute_force(log), "R-AUTH-001", 0, {"fail_count_5min": F.col("n")}),
        one_rule(success_after_failures(log), "R-AUTH-002", 1, {"brute_start": F.timestamp_micros("brute_us"), "fails": F.col("fails")}),
        one_rule(new_root_subnets(log), "R-AUTH-003", 2, {"new_subnet": F.col("subnet")}),
        one_rule(first_logins(log), "R-AUTH-006", 3),
        one_rule(deleted_users_back(log), "R-AUTH-007", 4),
        new_accounts(log).withColumn("ordinal", F.lit(6)),
        one_rule(sudo_bursts(log), "R-AUTH-005", 7, {"sudo_count_5min": F.col("n"), "actor": F.col("actor")}),
    ]
    if baseline is not None:
        parts.append(one_rule(keys_without_baseline(log, baseline), "R-AUTH-008", 5))
    names = [*log.columns, "ordinal", "rule_id", "severity", "extra"]
    out = parts[0].select(*names)
    for p in parts[1:]:
        out = out.unionByName(p.select(*names))
    return out


def findings(log: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """The same as findings ``AUTH-001``, ``AUTH-002``, ..."""
    evidence = {c: F.col(c) for c in ("ts", "src_ip", "user", "src_file", "line_no")} | {"msg": F.substring(_msg(), 1, 240)}
    place = F.concat_ws(":", "src_file", "line_no")
    address = F.when(blank(F.col("src_ip")) != "", ioc("ip", F.col("src_ip"), "medium", F.col("ts"), place, F.lit("auth")))
    return as_findings(detect(log, baseline), "AUTH", evidence, F.array_compact(F.array(address)))
