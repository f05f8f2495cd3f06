"""Packet views to FLOWREC: rows of a dissector's fields, one view each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe import schemas
from huntframe.functions.text import truncated
from huntframe.functions.time import epoch_time

# A dissector's fields in the order of its columns.
FIELDS = {
    "http": ("t", "src_ip", "dst_ip", "src_port", "dst_port", "stream_id", "method", "host", "uri", "status", "ua", "referer", "content_type", "content_length", "request_line_excerpt"),
    "dns": ("t", "src_ip", "dst_ip", "src_port", "dst_port", "qname", "qtype", "rcode", "response_ip"),
    "tls": ("t", "src_ip", "dst_ip", "src_port", "dst_port", "stream_id", "sni", "version", "cipher", "ja3", "ja3s"),
    "certificates": ("t", "stream_id", "utf8_name", "printable_name", "dns_name"),
    "payloads": ("src_ip", "src_port", "dst_ip", "dst_port", "payload"),
    "creds": ("t", "src_ip", "dst_ip", "src_port", "dst_port", "auth_type", "credential"),
    "conn": ("t", "src_ip", "dst_ip", "src_port", "dst_port", "stream_id", "seq", "ack", "flags", "length"),
}
CONVERSATION = (
    r"^\s*(\S+):(\d+)\s+<->\s+(\S+):(\d+)\s+(\d+)\s+(\d+)\s+bytes?\s+(\d+)\s+(\d+)\s+bytes?\s+(\d+)\s+(\d+)\s+bytes?\s+([\d.]+)\s+([\d.]+)"
)
DEFAULT_VIEWS, ALL_VIEWS = ("http", "dns", "tls", "flow", "creds"), ("http", "dns", "tls", "flow", "creds", "conn")
EXCERPT = 300

_RAW = [f.split(" ") for f in schemas.RAW.split(", ")]


def whole(text: Column) -> Column:
    """A whole number from text such as ``80`` or ``80.0``; else null."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def raw_struct(**fields: Column) -> Column:
    return F.struct(*[fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in _RAW])


def flow_record(view: str, raw: Column, proto: str | Column, ts: Column | None = None) -> list[Column]:
    """The envelope's columns; a row must have addresses, ports, ``src_file`` and ``line_no``."""
    proto = F.lit(proto) if isinstance(proto, str) else proto
    stamp = epoch_time(F.col("t")) if ts is None else ts
    return [
        stamp.alias("ts"), F.lit(view).alias("view"), F.nullif("src_ip", F.lit("")).alias("src_ip"), F.nullif("dst_ip", F.lit("")).alias("dst_ip"),
        whole(F.col("src_port")).cast("int").alias("src_port"), whole(F.col("dst_port")).cast("int").alias("dst_port"), proto.alias("proto"),
        whole(F.col("stream_id")).alias("stream_id"), raw.alias("raw"), F.col("src_file"), F.col("line_no").cast("bigint").alias("line_no"),
    ]


def split_rows(lines: DataFrame, fields: Sequence[str], separator: str = "|") -> DataFrame:
    """Lines of separated fields as columns; missing ones are empty, further ones are left out."""
    parts = F.split(F.col("value"), f"\\Q{separator}\\E", -1)
    return lines.select("src_file", "line_no", *[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(f) for i, f in enumerate(fields)])


def _full(name: str) -> Column:
    return F.nullif(name, F.lit(""))


def http_view(rows: DataFrame) -> DataFrame:
    raw = raw_struct(
        host=_full("host"), method=F.upper(_full("method")), uri=_full("uri"), status=whole(F.col("status")), ua=_full("ua"), referer=_full("referer"),
        content_type=_full("content_type"), content_length=whole(F.col("content_length")), request_line_excerpt=truncated(F.col("request_line_excerpt"), EXCERPT),
    )
    return rows.select(*flow_record("http", raw, "tcp"))


def dns_view(rows: DataFrame) -> DataFrame:
    raw = raw_struct(qname=_full("qname"), qtype=_full("qtype"), rcode=whole(F.col("rcode")), response_ip=_full("response_ip"))
    return rows.withColumn("stream_id", F.lit(None).cast("string")).select(*flow_record("dns", raw, "udp"))


def tls_view(hellos: DataFrame, certificates: DataFrame | None = None) -> DataFrame:
    """Client hellos with the name of the first certificate of their stream."""
    hellos = hellos.withColumn("cert_cn", F.lit(None).cast("string"))
    if certificates is not None:
        name = F.coalesce(_full("utf8_name"), _full("printable_name"), _full("dns_name"))
        first = certificates.where((F.col("stream_id") != "") & name.isNotNull()).groupBy("stream_id").agg(F.min_by(name, "line_no").alias("cert_cn"))
        hellos = hellos.drop("cert_cn").join(first, "stream_id", "left")
    raw = raw_struct(sni=_full("sni"), cert_cn=F.col("cert_cn"), version=_full("version"), cipher=_full("cipher"), ja3=_full("ja3"), ja3s=_full("ja3s"))
    return hellos.select(*flow_record("tls", raw, "tcp"))


def pair_key(prefix: str = "") -> Column:
    """The same for both directions of a connection."""
    a = F.concat_ws(":", f"{prefix}src_ip", f"{prefix}src_port")
    b = F.concat_ws(":", f"{prefix}dst_ip", f"{prefix}dst_port")
    return F.concat_ws("<->", F.least(a, b), F.greatest(a, b))


def flow_view(lines: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """Conversation summaries; frames and bytes of each direction under their right names.

    ``payloads`` gives each conversation the first 16 bytes that it sent, as Latin-1 text.
    """
    part = lambda k: F.regexp_extract("value", CONVERSATION, k)
    names = ("src_ip", "src_port", "dst_ip", "dst_port", "packets_b2a", "bytes_b2a", "packets_a2b", "bytes_a2b", "packets_total", "bytes_total", "rel_start", "duration_s")
    rows = lines.where(F.col("value").rlike(CONVERSATION)).select("src_file", "line_no", *[part(k).alias(n) for k, n in enumerate(names, 1)])
    rows = rows.withColumns({"pair": pair_key(), "payload_first_bytes": F.lit(None).cast("string")})
    if payloads is not None:
        data = F.decode(F.unhex(F.substring("payload", 1, 32)), "ISO-8859-1")
        first = payloads.where(F.col("payload").rlike("^(?:[0-9A-Fa-f]{2})+$")).withColumn("pair", pair_key())
        first = first.groupBy("pair").agg(F.min_by(data, "line_no").alias("payload_first_bytes"))
        rows = rows.drop("payload_first_bytes").join(first, "pair", "left")
    numbers = {n: F.col(n) for n in names[4:]} | {"payload_first_bytes": F.col("payload_first_bytes")}
    rows = rows.withColumn("stream_id", F.lit(None).cast("string"))
    return rows.select(*flow_record("flow", raw_struct(**numbers), "tcp", F.lit(None).cast("string")))


def masked_secret(text: Column) -> Column:
    """``***<n>``: a password's length only."""
    return F.when(text.isNotNull(), F.concat(F.lit("***<"), F.length(text).cast("string"), F.lit(">")))


def creds_view(rows: DataFrame) -> DataFrame:
    """Credentials in the clear, ``user:password`` with the password masked."""
    secret = F.when(F.col("credential").contains(":"), F.regexp_replace("credential", "^[^:]*:", ""))
    raw = raw_struct(auth_type=F.col("auth_type"), username=F.nullif(F.substring_index("credential", ":", 1), F.lit("")), password_masked=masked_secret(secret))
    return rows.withColumn("stream_id", F.lit(None).cast("string")).select(*flow_record("creds", raw, "tcp"))


def conn_view(rows: DataFrame) -> DataFrame:
    raw = raw_struct(seq=whole(F.col("seq")), ack=whole(F.col("ack")), flags=_full("flags"), length=whole(F.col("length")))
    return rows.select(*flow_record("conn", raw, "tcp"))


def read_flows(spark: SparkSession, path: str | Sequence[str], views: Sequence[str] = DEFAULT_VIEWS) -> DataFrame:
    """FLOWREC as JSON lines, only the wanted views; broken lines are dropped."""
    rows = spark.read.schema(schemas.FLOWREC).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("view").isin(*views))
