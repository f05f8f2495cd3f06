"""Rules on Windows events: R-WIN-001 to 024.  Input is WINEVT with ``line_no`` (and ``src_file``) for ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.net import is_global
from huntframe.functions.text import basename, blank, first_match, has_any
from huntframe.operators.findings import Branch, as_findings, hits, ioc, one_rule
from huntframe.operators.windows import MINUTE, burst, looking_back, trailing
from huntframe.rules.libraries import PERSISTENCE
from huntframe.sources.store import settled

# Fixed values.
BRUTE_WINDOW, BRUTE_ROWS, BRUTE_GRACE = 60_000_000, 20, 30 * MINUTE
TICKET_WINDOW, TICKET_ROWS = 10 * MINUTE, 20
PREAUTH_WINDOW, PREAUTH_ROWS = 10 * MINUTE, 15
REPLICATION = (
    "{1131f6aa-9c07-11d1-f79f-00c04fc2dcd2}",
    "{1131f6ad-9c07-11d1-f79f-00c04fc2dcd2}",
    "{89e95b76-444d-4c62-991a-0facbeda640c}",
)
MACRO_PARENTS = ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "mshta.exe", "wscript.exe", "cscript.exe", "acrord32.exe")
WEB_PARENTS = ("w3wp.exe", "httpd.exe", "nginx.exe", "tomcat.exe", "java.exe", "phpcgi.exe", "php-cgi.exe", "node.exe")
SHELLS = (
    "cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "rundll32.exe", "regsvr32.exe", "mshta.exe",
    "certutil.exe", "bitsadmin.exe",
)
LSASS_READERS = (
    "svchost.exe", "wmiprvse.exe", "csrss.exe", "services.exe", "lsass.exe", "msmpeng.exe", "searchindexer.exe", "smss.exe", "wininit.exe",
)
ADMIN_GROUPS = ("administrators", "administrateurs", "administratoren")
SERVICE_USERS = ("system", "local service", "network service", "administrator")
WEAK_TICKETS = ("0x17", "0x18", "0x1")
SERVICE_WORDS = (
    "cmd.exe", "powershell", "pwsh", "rundll32", "regsvr32", "mshta.exe", "wscript", "cscript", "-encodedcommand", "frombase64string",
)
AMSI_WORDS = ("amsiutils", "amsiinitfailed", "'amsi'", "amsi.dll")
DOWNLOAD_WORDS = ("net.webclient", "downloadstring", "invoke-webrequest -uri", "iwr -uri", "start-bitstransfer -source", "wget http")
TEMP_PROGRAM = r"(?i)C:\\Users\\[^\\]+\\AppData\\Local\\Temp\\.*\.(exe|dll|ps1|bat|vbs|hta)$"
SIGNATURE_LEVELS = {"high": "P1", "medium": "P2", "low": "P3"}
COVERED_SIGNATURE = "SIG-SYSMON-001"

#: Our own small table of (id, event, field, pattern, severity, description) on process telemetry.
SYSMON_RULES = (
    ("HF-SYS-001", 1, "CommandLine", r"(?i)certutil(\.exe)?\s.*-(urlcache|decode)", "high", "certutil used to fetch or decode"),
    ("HF-SYS-002", 1, "CommandLine", r"(?i)\bvssadmin(\.exe)?\s+delete\s+shadows", "high", "shadow copies deleted"),
    ("HF-SYS-003", 1, "CommandLine", r"(?i)\brundll32(\.exe)?\s.*comsvcs(\.dll)?.*minidump", "high", "memory of a process dumped"),
    ("HF-SYS-004", 1, "CommandLine", r"(?i)\bregsvr32(\.exe)?\s.*/i:https?:", "medium", "script component from the network"),
    ("HF-SYS-005", 1, "CommandLine", r"(?i)\bwmic(\.exe)?\s+.*process\s+call\s+create", "medium", "process made by WMI"),
    ("HF-SYS-006", 3, "DestinationHostname", r"(?i)\.(onion|ngrok\.io)$", "medium", "connection to an anonymous host"),
    ("HF-SYS-007", 22, "QueryName", r"(?i)\.(dnslog\.cn|ceye\.io|interact\.sh)$", "medium", "query of an out-of-band domain"),
    ("HF-SYS-008", 7, "Image", r"(?i)\\temp\\[^\\]+\.dll$", "low", "library loaded from a temporary folder"),
)

TIES = ("src_file", "line_no")


def timed(events: DataFrame) -> DataFrame:
    """Adds ``us`` and a ``src_file`` where they are missing."""
    events = events if "src_file" in events.columns else events.withColumn("src_file", F.lit(None).cast("string"))
    return events if "us" in events.columns else events.withColumn("us", F.unix_micros("ts"))


def field(name: str, *others: str) -> Column:
    """The first non-empty of the event's own fields."""
    return F.coalesce(*[F.nullif(F.try_element_at("data", F.lit(n)), F.lit("")) for n in (name, *others)])


def matched_persistence(target: Column, places: Sequence[tuple] = PERSISTENCE) -> Column:
    """``id, category, location`` of the first place that the target contains, whatever the case."""
    low = F.lower(target)
    value = lambda p: F.struct(F.lit(p[0]).alias("id"), F.lit(p[1]).alias("category"), F.lit(p[2]).alias("location"))
    return first_match((low.contains(p[2].lower()), value(p)) for p in places if p[2])


def brute_state(events: DataFrame, window_us: int = BRUTE_WINDOW, at_least: int = BRUTE_ROWS, grace_us: int = BRUTE_GRACE) -> tuple[DataFrame, DataFrame]:
    """R-WIN-001 and R-WIN-002.

    An address is armed by its first failure at which ``at_least`` lie in the window, reports
    that once, and is disarmed by a success within ``grace_us``, which reports too; then it can be
    armed again.  A success after more than ``grace_us`` leaves it armed for good.

    Of the failures over the threshold and the successes only those matter that follow one of
    the other kind, which one look at the row before tells.  They alternate: pairs of an arming
    and a success, of which all up to the first late one count.
    """
    events = timed(events).where("event_id IN (4624, 4625) AND src_ip <> ''")
    counted = trailing(events, ["src_ip"], "us", TIES, window_us, {"n": (F.col("event_id") == 4625).cast("bigint")})
    turning = settled(counted.where((F.col("event_id") == 4624) | (F.col("n") >= at_least)), "turning")
    turning = looking_back(turning, ["src_ip"], "us", TIES, 1, lambda w: {"was": F.lag("event_id").over(w)})
    turning = turning.where(F.coalesce(F.col("was") != F.col("event_id"), F.col("event_id") == 4625))
    turning = settled(turning, "turning")
    paired = settled(looking_back(turning, ["src_ip"], "us", TIES, 1, lambda w: {"armed_us": F.lag("us").over(w)}), "paired")
    won = paired.where("event_id = 4624")
    late = won.where(F.col("us") - F.col("armed_us") > grace_us).groupBy("src_ip").agg(F.min("us").alias("late_us"))
    late = settled(late, "late")
    until = F.coalesce(F.col("late_us"), F.lit((1 << 63) - 1))
    armed = paired.where("event_id = 4625").join(late, "src_ip", "left").where(F.col("us") <= until)
    won = won.join(late, "src_ip", "left").where(F.col("us") < until)
    return armed.drop("was", "armed_us", "late_us"), won.drop("was", "late_us", "n")


def many_tickets(events: DataFrame, window_us: int = TICKET_WINDOW, at_least: int = TICKET_ROWS) -> DataFrame:
    """R-WIN-013: an account's first 4769 with ``at_least`` in the window."""
    asked = timed(events).where("event_id = 4769").withColumn("account", F.coalesce(F.nullif("user", F.lit("")), F.lit("?")))
    return burst(asked, ["account"], "us", TIES, window_us, at_least)


def many_preauth_failures(events: DataFrame, window_us: int = PREAUTH_WINDOW, at_least: int = PREAUTH_ROWS) -> DataFrame:
    """R-WIN-014: a source's first 4771 with ``at_least`` in the window."""
    source = F.coalesce(F.nullif("src_ip", F.lit("")), F.nullif("user", F.lit("")), F.lit("?"))
    return burst(timed(events).where("event_id = 4771").withColumn("source", source), ["source"], "us", TIES, window_us, at_least)


def branches(places: Sequence[tuple] = PERSISTENCE) -> list[Branch]:
    """The rules that look at one event, in the order in which they report."""
    eid, ip, user = F.col("event_id"), F.col("src_ip"), F.col("user")
    sysmon = F.lower(blank(F.col("channel"))).contains("sysmon")
    logon = blank(field("LogonType"))
    new, parent = basename(field("NewProcessName", "Image")), basename(field("ParentProcessName", "ParentImage"))
    command = F.substring(blank(field("CommandLine", "ProcessCommandLine")), 1, 500)
    script = F.coalesce(field("ScriptBlockText"), blank(F.col("message")))
    snippet = {"snippet": F.substring(script, 1, 400)}
    properties = F.lower(blank(field("Properties")))
    ticket = F.lower(blank(field("TicketEncryptionType")))
    child = {"parent": parent, "child": new, "cmdline": command}
    target = blank(field("TargetObject", "TargetFilename"))
    source = basename(field("SourceImage"))
    low_user = F.lower(blank(user))
    place = matched_persistence(target, places)
    return [
        Branch("R-WIN-003", (eid == 4624) & (logon == "10") & is_global(ip), {"logon_type": logon}),
        Branch("R-WIN-016", (eid == 4624) & (logon == "3") & (F.trim(blank(field("WorkstationName"))) != "") & is_global(ip), {"workstation": field("WorkstationName")}),
        Branch("R-WIN-004", eid == 4720, {"new_user": F.coalesce(field("TargetUserName"), user)}),
        Branch("R-WIN-005", (eid == 4732) & F.lower(blank(field("TargetUserName"))).isin(*ADMIN_GROUPS), {"group": field("TargetUserName"), "member_sid": field("MemberSid")}),
        Branch("R-WIN-006", (eid == 4672) & (low_user != "") & ~low_user.isin(*SERVICE_USERS) & ~low_user.endswith("$"), {"privileged_user": user}),
        Branch("R-WIN-007", eid == 1102, {"cleared_by": field("SubjectUserName")}),
        Branch("R-WIN-008", eid == 4698, {"task": field("TaskName", "SubjectUserName"), "author_hint": field("ClientProcessId", "TaskAuthor")}),
        Branch("R-WIN-015", (eid == 4662) & has_any(properties, REPLICATION), {"dcsync_guid": first_match((properties.contains(g), g) for g in REPLICATION)}),
        Branch("R-WIN-012", eid.isin(4768, 4769) & ticket.isin(*WEAK_TICKETS), {"enc_type": ticket, "service": field("ServiceName")}),
        Branch("R-WIN-009", (eid == 7045) & has_any(field("ImagePath", "ImageName"), SERVICE_WORDS), {"image_path": field("ImagePath"), "service": field("ServiceName")}),
        Branch("R-WIN-010", (eid == 4688) & parent.isin(*MACRO_PARENTS) & new.isin(*SHELLS), child),
        Branch("R-WIN-011", (eid == 4688) & parent.isin(*WEB_PARENTS) & new.isin(*SHELLS), child),
        Branch("R-WIN-017", (eid == 4104) & has_any(script, ["frombase64string"]) & has_any(script, ["iex", "invoke-expression"]), snippet),
        Branch("R-WIN-018", (eid == 4104) & has_any(script, AMSI_WORDS), snippet),
        Branch("R-WIN-019", (eid == 4104) & has_any(script, DOWNLOAD_WORDS), snippet),
        Branch("R-WIN-020", sysmon & (eid == 10) & (basename(field("TargetImage")) == "lsass.exe") & ~source.isin(*LSASS_READERS), {"source_image": source, "granted_access": field("GrantedAccess")}),
        Branch("R-WIN-021", sysmon & (eid == 11) & blank(field("TargetFilename")).rlike(TEMP_PROGRAM), {"file": field("TargetFilename")}),
        Branch("R-WIN-022", sysmon & eid.isin(19, 20, 21), {"operation": field("Operation"), "consumer": field("Consumer", "Destination")}),
        Branch("R-WIN-024", sysmon & eid.isin(11, 12, 13) & place.isNotNull(), {"persist_id": place["id"], "category": place["category"], "location": place["location"], "matched_target": F.substring(target, 1, 200)}),
    ]


def telemetry_rules(events: DataFrame, rules: Sequence[tuple] = SYSMON_RULES) -> DataFrame:
    """R-WIN-023: process telemetry against a rule table; each rule that matches reports, with its own severity."""
    branches = []
    for rule_id, event, name, pattern, level, what in rules:
        if rule_id == COVERED_SIGNATURE:
            continue
        value = blank(F.try_element_at("data", F.lit(name or "CommandLine")))
        extra = {"sig_id": F.lit(rule_id), "field": F.lit(name), "matched": F.substring(value, 1, 160), "sig_severity": F.lit(level), "description": F.lit(what)}
        pattern = pattern if pattern.startswith("(?i)") else f"(?i){pattern}"
        severity = F.lit(SIGNATURE_LEVELS[level]) if level in SIGNATURE_LEVELS else None
        branches.append(Branch("R-WIN-023", (F.col("event_id") == event) & (value != "") & value.rlike(pattern), extra, severity))
    sysmon = timed(events).where(F.lower(blank(F.col("channel"))).contains("sysmon"))
    return hits(sysmon, branches).withColumn("ordinal", F.lit(40) + F.col("ordinal"))


def detect(events: DataFrame, rules: Sequence[tuple] = SYSMON_RULES, places: Sequence[tuple] = PERSISTENCE) -> DataFrame:
    """Events of WINEVT to (event, ``ordinal, rule_id, severity, extra``)."""
    events = timed(events)
    plain = hits(events, branches(places))
    last = len(branches(places)) - 1
    # The persistence rule reports last, after the rule table.
    plain = plain.withColumn("ordinal", F.when(F.col("ordinal") == last, F.lit(4000)).otherwise(F.col("ordinal") + 2))
    armed, won = brute_state(events)
    parts = [
        one_rule(armed, "R-WIN-001", 0, {"fail_count_60s": F.col("n")}),
        one_rule(won, "R-WIN-002", 1, {"brute_start": F.timestamp_micros("armed_us"), "logon_type": field("LogonType")}),
        one_rule(many_tickets(events), "R-WIN-013", 11, {"tgs_count_10min": F.col("n"), "account": F.col("account")}),
        one_rule(many_preauth_failures(events), "R-WIN-014", 12, {"preauth_fail_count_10min": F.col("n"), "source": F.col("source")}),
        telemetry_rules(events, rules),
    ]
    for p in parts:
        plain = plain.unionByName(p.select(*plain.columns))
    return plain


def findings(events: DataFrame, **options) -> DataFrame:
    """The same as findings ``IR-WIN-001``, ``IR-WIN-002``, ..."""
    evidence = {c: F.col(c) for c in ("ts", "channel", "event_id", "record_id", "computer", "user", "src_ip")}
    evidence |= {"message": F.substring(blank(F.col("message")), 1, 600), "event_data": F.map_filter("data", lambda k, v: v.isNotNull())}
    place, ts = F.concat_ws(":", "channel", "record_id"), F.col("ts").cast("string")
    address = F.when(F.col("src_ip").rlike("^[0-9.]+$|:"), ioc("ip", F.col("src_ip"), "medium", ts, place, F.lit("evtx")))
    known = blank(F.col("user")).isin("", "-", "SYSTEM", "ANONYMOUS LOGON")
    user = F.when(~known, ioc("user", F.col("user"), "medium", ts, place, F.lit("evtx")))
    return as_findings(detect(events, **options), "IR-WIN", evidence, F.array_compact(F.array(address, user)))
