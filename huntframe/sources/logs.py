"""Text and JSON logs to LOG: scan, type detection, parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe import schemas
from huntframe.functions.text import blank
from huntframe.functions.time import access_time, syslog_time
from huntframe.sources.store import settled

# Line formats, aliases and wrapper keys.
ACCESS_LINE = (
    r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(.*?)\s+HTTP/[\d.]+"\s+(\d{3})\s+(\S+)\s+"([^"]*)"\s+"([^"]*)"'
)
_STAMP = r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
SSH_FAILED = _STAMP + r".*sshd\[\d+\]:\s+Failed (password|publickey)\s+for\s+(?:invalid user\s+)?(\S+)\s+from\s+(\S+)\s+port\s+\d+"
SSH_ACCEPTED = _STAMP + r".*sshd\[\d+\]:\s+Accepted (password|publickey)\s+for\s+(\S+)\s+from\s+(\S+)\s+port\s+\d+"
SYSLOG_LINE = "^" + _STAMP + r"\s+(\S+)\s+([^:]+):\s*(.*)$"
#: What a first line has by which its file's type is told.
ACCESS_SIGN, LOG_IN_SIGN = r'\] "(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH) ', r"sshd\[\d+\]:"
SUDO_ACTOR = r"^\s*(\S+)\s+:\s"
ALIASES = {
    "ts": ("ts", "time", "@timestamp", "timestamp", "event_time", "createTime", "create_time"),
    "src_ip": ("src_ip", "srcip", "source_ip", "clientip", "client_ip", "remote_addr", "remote_ip", "src", "ip"),
    "dst_ip": ("dst_ip", "dstip", "dest_ip", "destination_ip", "dst", "server_ip"),
    "user": ("user", "username", "user_name", "account", "uid"),
    "uri": ("uri", "url", "request_uri", "path"),
    "method": ("method", "http_method", "request_method"),
    "ua": ("ua", "user_agent", "http_user_agent", "useragent"),
    "status": ("status", "http_status", "response_code", "resp_code"),
    "msg": ("msg", "message", "description", "alert", "title", "name"),
}
ACCESS_ALIASES = {
    "ts": ("time", "ts", "@timestamp"),
    "src_ip": ("remote_addr", "client_ip", "src_ip"),
    "method": ("request_method", "method"),
    "uri": ("request_uri", "uri"),
    "ua": ("http_user_agent", "user_agent"),
}
WRAPPERS = ("alerts", "data", "events", "results", "items", "records", "logs")
LINE_CUT, TEXT_CUT = 2000, 500
#: Tables of files' pieces, and of files, are broadcast up to this many rows.
MOST_PIECES = 100_000

_FIELDS = [f.split(" ")[0] for f in schemas.LOG.split(", ")]
_KINDS = dict(f.split(" ") for f in schemas.LOG.split(", "))
MAP = "map<string,string>"


def read_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Lines of a file or of all files below a folder: ``src_file, line_no, value``.

    ``.gz`` is read as it is, by one task a file, since it can't be cut.  Lines are numbered from 1 in
    each file.  Other large files are read in pieces; only a row a piece (its first line's place and
    its number of lines) is shuffled, never a line.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("__piece"),
        F.monotonically_increasing_id().alias("__at"),
    )
    # A piece is one task's, in order: a line's number in it is its place less that of the piece's first.
    pieces = lines.groupBy("src_file", "__piece").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("src_file").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("src_file", "__piece", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__start"))
    starts = settled(starts, "pieces")
    starts = F.broadcast(starts) if starts.count() <= MOST_PIECES else starts
    # Both readings cut files in the same way, or this fails: a cluster that changes its default parallelism meanwhile should set spark.sql.files.minPartitionNum.
    start = F.coalesce("__start", F.raise_error(F.lit("files were cut into other pieces than those that were counted")).cast("bigint"))
    return lines.join(starts, ["src_file", "__piece"], "left").select("src_file", (F.col("__at") + start).alias("line_no"), "value")


def log_type(src_file: Column, first_line: Column) -> Column:
    """From a file's name and its first line; the first that fits."""
    name = F.lower(F.substring_index(src_file, "/", -1))
    start = F.ltrim(blank(first_line))
    json = start.startswith("{") | start.startswith("[")
    return (
        F.when(json, F.lit("json-alert"))
        .when(name.endswith(".csv"), F.lit("csv-alert"))
        .when(name.contains("auth.log") | name.contains("secure"), F.lit("linux-auth"))
        .when(name.contains("access"), F.lit("nginx-access"))
        .when(name.contains("apache"), F.lit("apache-access"))
        .when(name.contains("syslog") | name.contains("messages"), F.lit("syslog"))
        .when(start.rlike(ACCESS_SIGN), F.lit("nginx-access"))
        .when(start.rlike(LOG_IN_SIGN), F.lit("linux-auth"))
        .otherwise(F.lit("syslog"))
    )


def with_log_type(lines: DataFrame) -> DataFrame:
    """Adds ``log_type`` to lines, by their files' first lines; only those are shuffled."""
    firsts = lines.groupBy("src_file").agg(F.min_by("value", "line_no").alias("__first"))
    types = settled(firsts.select("src_file", log_type(F.col("src_file"), F.col("__first")).alias("log_type")), "log-types")
    return lines.join(F.broadcast(types) if types.count() <= MOST_PIECES else types, "src_file")


def _record(**fields: Column) -> Column:
    """A struct of LOG's parsed fields; what isn't given is null."""
    names = [n for n in _FIELDS if n not in ("raw_line", "line_no", "src_file")]
    return F.struct(*[fields.get(n, F.lit(None)).cast(_KINDS[n]).alias(n) for n in names])


def _group(text: Column, rx: str, k: int) -> Column:
    return F.regexp_extract(text, rx, k)


def first_of(record: Column, keys: Sequence[str]) -> Column:
    """The first value of a map that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(record, F.lit(k)), F.lit("")) for k in keys])


def access_record(line: Column, kind: str = "nginx-access", obj: Column | None = None) -> Column:
    """A combined-format line, or a JSON line, as a struct of LOG; null if it is neither.  ``obj`` is the JSON line's map, where the caller has it."""
    part = lambda k: _group(line, ACCESS_LINE, k)
    user = F.when(~part(2).isin("-", ""), part(2))
    combined = _record(
        ts=access_time(part(3)), log_type=F.lit(kind), src_ip=part(1), user=user, method=part(4), uri=part(5),
        status=part(6).try_cast("int"), ua=part(9), msg=F.concat_ws(" ", part(4), part(5), part(6)),
    )
    obj = F.from_json(line, MAP) if obj is None else obj
    found = {n: first_of(obj, keys) for n, keys in ACCESS_ALIASES.items()}
    status = F.nullif(F.try_element_at(obj, F.lit("status")).try_cast("int"), F.lit(0))
    told = F.to_json(F.struct(found["method"].alias("method"), found["uri"].alias("uri"), status.alias("status")), {"ignoreNullFields": "false"})
    json = _record(log_type=F.lit(kind), status=status, msg=told, **found)
    return F.when(line.rlike(ACCESS_LINE), combined).when(F.ltrim(line).startswith("{") & obj.isNotNull(), json)


def auth_record(line: Column, year: int) -> Column:
    """sshd results as ``ssh-fail`` and ``ssh-success``, else any syslog line; null for anything else.

    ``auth_method`` is not a field of LOG: the method is kept in ``msg`` after the result, so
    that rules on public keys can see it.  The actor of ``sudo`` becomes the user.
    """

    failed, accepted = line.rlike(SSH_FAILED), line.rlike(SSH_ACCEPTED)
    body, process = _group(line, SYSLOG_LINE, 4), _group(line, SYSLOG_LINE, 3)
    empty = lambda c: F.nullif(c, F.lit(""))

    def either(k: int, other: Column) -> Column:
        return F.when(failed, _group(line, SSH_FAILED, k)).when(accepted, _group(line, SSH_ACCEPTED, k)).otherwise(other)

    actor = F.when(process.startswith("sudo"), empty(_group(body, SUDO_ACTOR, 1)))
    msg = F.when(failed, F.concat(F.lit("ssh-fail "), _group(line, SSH_FAILED, 2))).when(accepted, F.concat(F.lit("ssh-success "), _group(line, SSH_ACCEPTED, 2)))
    record = _record(
        ts=syslog_time(_group(line, _STAMP, 1), year),
        log_type=F.lit("linux-auth"),
        src_ip=either(4, empty(_group(body, r"\bfrom\s+([\d\.:a-fA-F]+)", 1))),
        user=either(3, F.coalesce(actor, empty(_group(body, r"\b(?:user|by)\s+(\S+)", 1)))),
        msg=msg.otherwise(F.concat(process, F.lit(": "), body)),
    )
    return F.when(failed | accepted | line.rlike(SYSLOG_LINE), record)


def syslog_record(line: Column, year: int) -> Column:
    """``process: message`` with the line's first dotted quad as the source."""
    msg = F.concat(_group(line, SYSLOG_LINE, 3), F.lit(": "), _group(line, SYSLOG_LINE, 4))
    address = F.nullif(_group(line, r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", 1), F.lit(""))
    record = _record(ts=syslog_time(_group(line, SYSLOG_LINE, 1), year), log_type=F.lit("syslog"), src_ip=address, msg=msg)
    return F.when(line.rlike(SYSLOG_LINE), record)


def alert_record(obj: Column, kind: str = "json-alert") -> Column:
    """A map of any alert's fields, by their usual names; without a message, the JSON text is the message."""
    found = {n: first_of(obj, keys) for n, keys in ALIASES.items()}
    found["status"] = found["status"].try_cast("int")
    found["msg"] = F.coalesce(found["msg"], F.substring(F.to_json(obj), 1, TEXT_CUT))
    return F.when(obj.isNotNull(), _record(log_type=F.lit(kind), **found))


def _as_log(rows: DataFrame, record: Column, raw_line: Column) -> DataFrame:
    # exploded, the record is made once a row: a filter on a plain column is pushed down and makes it a second time
    found = rows.withColumn("__r", F.explode(F.array(record))).where("__r IS NOT NULL")
    rest = {"raw_line": F.substring(raw_line, 1, LINE_CUT), "line_no": F.col("line_no").cast("bigint"), "src_file": F.col("src_file")}
    return found.select(*[rest[n].alias(n) if n in rest else F.col(f"__r.{n}").alias(n) for n in _FIELDS])


def parse_lines(lines: DataFrame, year: int) -> DataFrame:
    """Lines with ``log_type`` to LOG.  Blank lines and lines that don't parse are dropped; ``year`` is that of syslog times."""
    value, kind, obj = F.col("value"), F.col("log_type"), F.col("__obj")
    may_be_json = (kind == "json-alert") | (kind.isin("nginx-access", "apache-access") & F.ltrim("value").startswith("{"))
    record = (
        F.when(kind == "nginx-access", access_record(value, obj=obj))
        .when(kind == "apache-access", access_record(value, "apache-access", obj))
        .when(kind == "linux-auth", auth_record(value, year))
        .when(kind == "syslog", syslog_record(value, year))
        .when(kind == "json-alert", alert_record(obj))
    )
    # exploded too: JSON is read once a line, not for each of its fields
    told = lines.where(F.trim("value") != "").withColumn("__obj", F.explode(F.array(F.when(may_be_json, F.from_json("value", MAP)))))
    return _as_log(told, record, value)


def read_json_files(spark: SparkSession, path: str | Sequence[str], glob: str = "*.json", wrappers: Sequence[str] = WRAPPERS) -> DataFrame:
    """Whole JSON files to maps: ``src_file, line_no, obj``.

    A file is an array of objects, an object with an array under one of ``wrappers``, or one
    object.  Files that aren't JSON give nothing.  Each file is read by one task.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return json_objects(text.select("value", F.col("_metadata.file_path").alias("src_file")), wrappers)


def json_objects(texts: DataFrame, wrappers: Sequence[str] = WRAPPERS) -> DataFrame:
    """The same from a table of ``src_file, value``."""
    value = F.regexp_replace(F.ltrim("value"), "^\\ufeff", "")
    one = F.from_json(value, MAP)
    wrapped = F.coalesce(*[F.when(F.ltrim(F.try_element_at(one, F.lit(w))).startswith("["), F.try_element_at(one, F.lit(w))) for w in wrappers])
    many = F.from_json(F.when(value.startswith("["), value).otherwise(wrapped), f"array<{MAP}>")
    objects = F.when(F.size(many) > 0, many).when(value.startswith("{") & (F.size(one) > 0), F.array(one))
    rows = texts.select("src_file", F.posexplode(objects).alias("at", "obj")).where("obj IS NOT NULL")
    return rows.select("src_file", (F.col("at") + 1).cast("bigint").alias("line_no"), "obj")


def read_csv_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV files with one header to maps: ``src_file, line_no, obj``; the first row is line 2."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    pairs = [x for c in rows.columns for x in (F.lit(c.lstrip("﻿")), F.col(f"`{c}`").cast("string"))]
    made = rows.select(
        F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("obj"),
        F.col("_metadata.file_path").alias("src_file"),
        F.monotonically_increasing_id().alias("at"),
    )
    inside = Window.partitionBy("src_file").orderBy("at")  # with multiLine a file is one task anyway
    return made.select("src_file", (F.row_number().over(inside) + 1).cast("bigint").alias("line_no"), "obj")


def alerts(objects: DataFrame, kind: str = "json-alert") -> DataFrame:
    """Maps (``src_file, line_no, obj``) to LOG."""
    return _as_log(objects, alert_record(F.col("obj"), kind), F.to_json("obj"))


def read_ndjson(spark: SparkSession, path: str | Sequence[str], schema: str = schemas.LOG, log_types: Sequence[str] | None = None) -> DataFrame:
    """One JSON object a line; blank and broken lines are dropped.  ``log_types`` keeps only those."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("log_type").isin(*log_types)) if log_types else rows


def read_logs(spark: SparkSession, path: str | Sequence[str], year: int) -> DataFrame:
    """Everything below ``path`` as LOG, by the detected type of each file."""
    return parse_lines(with_log_type(read_lines(spark, path)), year)
