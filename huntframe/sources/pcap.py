"""Packet captures to packets, and packets to conn, dns and flow views.

``read_packets`` decodes classic captures where Spark has them, a file a task and up to the 2 GB
that a binary cell holds; ``captures.read_packets`` reads files of any size, also next-generation
ones, in byte ranges.  Everything above the table of packet headers - conversations, directions,
first payloads - is grouping in Spark; ``reassembly`` puts the payloads together.  Links of other
types than ``LINKS`` and fragments after the first give no rows; ``unread`` names the files that
give none for that reason.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from socket import AF_INET6, inet_ntoa, inet_ntop

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.sources.views import dns_view, flow_record, raw_struct

# Fixed values of the file and protocol formats.
MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1e-6), b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\x3c\x4d": (">", 1e-9), b"\x4d\x3c\xb2\xa1": ("<", 1e-9)}
ETHERNET, RAW_IP, IPV4, IPV6, VLAN, TCP, UDP, DNS_PORT = 1, 101, 0x0800, 0x86DD, (0x8100, 0x88A8), 6, 17, 53
COOKED, COOKED_2, ONLY_4, ONLY_6 = 113, 276, 228, 229
LINKS = (ETHERNET, RAW_IP, COOKED, COOKED_2, ONLY_4, ONLY_6)
EXTENSIONS, FRAGMENT, AUTHENTICATION = (0, 43, 60), 44, 51
HEAD = 16  # bytes of payload that are kept

PACKET = (
    "src_file string, line_no long, t double, src_ip string, dst_ip string, src_port int, dst_port int, proto string, seq long, ack long, flags string, "
    "length int, payload string, qname string, qtype string, rcode int, response_ip string"
)
_KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
_FIELDS = [tuple(f.split(" ")) for f in PACKET.split(", ")]


def frames(data: bytes) -> Iterator[tuple[float, bytes]]:
    """(time, IP packet) of a classic capture, whatever its byte order; a cut last packet is left out."""
    order, unit = MAGIC.get(data[:4], ("", 0.0))
    if not order or len(data) < 24:
        return
    link, at = struct.unpack(order + "I", data[20:24])[0], 24
    while at + 16 <= len(data):
        seconds, fraction, size, _ = struct.unpack(order + "IIII", data[at : at + 16])
        frame, at = data[at + 16 : at + 16 + size], at + 16 + size
        if len(frame) < size:
            return
        ip = ip_of(link, frame)
        if ip is not None:
            yield seconds + fraction * unit, ip


def ip_of(link: int, frame: bytes) -> bytes | None:
    """The IP packet in a frame of a known link type; None for others."""
    if link == ETHERNET:
        start = 14
        while start <= 22 and int.from_bytes(frame[start - 2 : start], "big") in VLAN:
            start += 4
        kind = int.from_bytes(frame[start - 2 : start], "big")
    elif link == COOKED:
        start, kind = 16, int.from_bytes(frame[14:16], "big")
    elif link == COOKED_2:
        start, kind = 20, int.from_bytes(frame[:2], "big")
    elif link in (RAW_IP, ONLY_4, ONLY_6):
        start, kind = 0, {4: IPV4, 6: IPV6}.get(frame[0] >> 4 if frame else 0, 0)
    else:
        return None
    return frame[start:] if kind in (IPV4, IPV6) and len(frame) > start else None


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A DNS name and where it ends; follows at most a few pointers."""
    labels, end = [], -1
    for _ in range(128):
        if at >= len(data):
            break
        n = data[at]
        if n >= 0xC0 and at + 1 < len(data):
            end = at + 2 if end < 0 else end
            at = (n & 0x3F) << 8 | data[at + 1]
            continue
        if n == 0:
            at += 1
            break
        labels.append(data[at + 1 : at + 1 + n].decode("latin-1"))
        at += 1 + n
    return ".".join(labels), at if end < 0 else end


def dns_fields(data: bytes) -> dict:
    """The first question, the result code and the first address of a DNS message."""
    if len(data) < 17:
        return {}
    flags, questions, answers = struct.unpack(">HHH", data[2:8])
    if not questions:
        return {}
    name, at = _name(data, 12)
    out = {"qname": name, "qtype": str(int.from_bytes(data[at : at + 2], "big")), "rcode": flags & 0xF}
    at += 4
    for _ in range(answers):
        _, at = _name(data, at)
        if at + 10 > len(data):
            break
        kind, _, _, size = struct.unpack(">HHIH", data[at : at + 10])
        if kind == 1 and size == 4 and at + 14 <= len(data):
            return out | {"response_ip": inet_ntoa(data[at + 10 : at + 14])}
        at += 10 + size
    return out


def _network(ip: bytes) -> tuple[str, str, int, bytes] | None:
    """(source, destination, protocol, body) of an IP packet; None for later fragments and what is cut in its header."""
    if len(ip) < 20:
        return None
    if ip[0] >> 4 == 4:
        if int.from_bytes(ip[6:8], "big") & 0x1FFF:
            return None
        head, size = (ip[0] & 0xF) * 4, int.from_bytes(ip[2:4], "big")
        return inet_ntoa(ip[12:16]), inet_ntoa(ip[16:20]), ip[9], ip[head : size or len(ip)]
    if ip[0] >> 4 != 6 or len(ip) < 40:
        return None
    kind, at, end = ip[6], 40, 40 + int.from_bytes(ip[4:6], "big")
    end = end if end > 40 else len(ip)
    while kind in (*EXTENSIONS, FRAGMENT, AUTHENTICATION) and at + 8 <= len(ip):
        if kind == FRAGMENT and int.from_bytes(ip[at + 2 : at + 4], "big") >> 3:
            return None
        size = 8 if kind == FRAGMENT else 4 * (ip[at + 1] + 2) if kind == AUTHENTICATION else 8 * (ip[at + 1] + 1)
        kind, at = ip[at], at + size
    return inet_ntop(AF_INET6, ip[8:24]), inet_ntop(AF_INET6, ip[24:40]), kind, ip[at:end]


def packet(ip: bytes, whole: bool = False) -> dict | None:
    """The header fields of one IP packet, and its payload as ``data`` if ``whole``; None for anything but TCP and UDP."""
    network = _network(ip)
    if network is None:
        return None
    source, destination, kind, body = network
    if kind == TCP and len(body) >= 20:
        ports = struct.unpack(">HHII", body[:12])
        data = body[(body[12] >> 4) * 4 :]
        row = {"proto": "tcp", "seq": ports[2], "ack": ports[3], "flags": f"0x{int.from_bytes(body[12:14], 'big') & 0xFFF:04x}"}
    elif kind == UDP and len(body) >= 8:
        ports, data, row = struct.unpack(">HH", body[:4]), body[8:], {"proto": "udp"}
        if DNS_PORT in ports:
            row |= dns_fields(data)
    else:
        return None
    row |= {"src_ip": source, "dst_ip": destination, "src_port": ports[0], "dst_port": ports[1], "length": len(ip), "payload": data[:HEAD].hex() or None}
    return row | {"data": data} if whole else row


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows: list[dict] = []
            for n, (t, ip) in enumerate(frames(content.as_py() or b""), 1):
                if (found := packet(ip)) is not None:
                    rows.append(found | {"src_file": path.as_py(), "line_no": n, "t": t})
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(n) for r in rows], _KINDS[k]) for n, k in _FIELDS], [n for n, _ in _FIELDS])


def packets(files: DataFrame) -> DataFrame:
    """A table of (``path, content``) to one row a TCP or UDP packet."""
    return files.select("path", "content").mapInArrow(_decoded, PACKET)


def unread(files: DataFrame) -> DataFrame:
    """(``path, reason``) of files that no packet can come from: other formats, and other links."""
    first = F.substring("content", 1, 4)
    big = first.isin(*[F.lit(m) for m, (order, _) in MAGIC.items() if order == ">"])
    known = first.isin(*[F.lit(m) for m in MAGIC])
    digits = F.hex(F.substring("content", 21, 4))
    turned = F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)])
    link = F.conv(F.when(big, digits).otherwise(turned), 16, 10).cast("bigint")
    reason = F.when(~known | (F.length("content") < 24), F.lit("no classic capture")).when(~link.isin(*LINKS), F.concat(F.lit("link type "), link.cast("string")))
    return files.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def read_packets(spark: SparkSession, path: str, glob: str = "*.pcap") -> DataFrame:
    return packets(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path))


def _text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("t", F.format_string("%.6f", "t"))


def conn(rows: DataFrame) -> DataFrame:
    """Every TCP packet as a record of the conn view."""
    raw = raw_struct(seq=F.col("seq"), ack=F.col("ack"), flags=F.col("flags"), length=F.col("length"))
    tcp = _text(rows.where("proto = 'tcp'")).withColumn("stream_id", F.lit(None).cast("string"))
    return tcp.select(*flow_record("conn", raw, "tcp", _iso()))


def dns(rows: DataFrame) -> DataFrame:
    """DNS messages as records of the dns view."""
    return dns_view(_text(rows.where("qname IS NOT NULL")))


def _iso():
    return F.date_format(F.timestamp_micros((F.col("t").cast("double") * 1e6).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def flows(rows: DataFrame) -> DataFrame:
    """Conversations by both ends: the side that sent first is the source.

    Packets are first summed by direction, then the two directions meet: a busy pair of hosts is
    two rows when it is shuffled the second time.
    """
    ends = ["src_file", "proto", "src_ip", "src_port", "dst_ip", "dst_port"]
    ways = rows.groupBy(*ends).agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.min("t").alias("first"), F.max("t").alias("last"),
        F.min_by("payload", F.when(F.col("payload").isNotNull(), F.struct("t", "line_no"))).alias("payload"), F.min(F.when(F.col("payload").isNotNull(), F.col("t"))).alias("payload_t"),
        F.min("line_no").alias("line_no"),
    )
    a, b = F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")
    ways = ways.withColumn("pair", F.concat_ws("<->", F.least(a, b), F.greatest(a, b)))
    begin = F.struct("first", "line_no")
    side = lambda c: F.min_by(c, begin)
    both = ways.groupBy("src_file", "proto", "pair").agg(
        *[side(c).alias(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port")], F.min("line_no").alias("line_no"), F.min("first").alias("first"), F.max("last").alias("last"),
        side("n").alias("n_a"), F.sum("n").alias("n_all"), side("size").alias("size_a"), F.sum("size").alias("size_all"),
        F.min_by("payload", "payload_t").alias("payload"),
    )
    start = both.groupBy("src_file").agg(F.min("first").alias("start"))
    both = both.join(start, "src_file").withColumn("stream_id", F.lit(None).cast("string"))
    raw = raw_struct(
        duration_s=F.round(F.col("last") - F.col("first"), 6), bytes_total=F.col("size_all"), packets_total=F.col("n_all"), bytes_a2b=F.col("size_a"), bytes_b2a=F.col("size_all") - F.col("size_a"),
        packets_a2b=F.col("n_a"), packets_b2a=F.col("n_all") - F.col("n_a"), rel_start=F.round(F.col("first") - F.col("start"), 6),
        payload_first_bytes=F.decode(F.unhex("payload"), "ISO-8859-1"),
    )
    return both.select(*flow_record("flow", raw, F.col("proto"), F.lit(None).cast("string")))
