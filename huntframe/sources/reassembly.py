"""TCP payloads put together again, and the http, tls and creds views that they give.

A segment's place in its direction's stream is its sequence number less that of the direction's
last SYN (an as-of join).  Streams are cut into blocks of ``BLOCK`` bytes, each with ``LOOK`` bytes
of what follows, so that a task never holds a long transfer: segments go to the blocks that they
touch, once each however often they were sent, and in a block the intervals that are covered are
merged.  What was sent first stays; what was lost is a gap, over which no message is read.

A message belongs to the block that it begins in.  It begins where a segment does, or behind the
empty line that ends another head.  Heads of more than ``LOOK`` bytes are cut there.  Positions
count modulo 2^32, and SYNs hold for a day; a stream caught without its SYN counts from its first
segment.  Packets come from ``captures.read_packets(..., whole=True)``.
"""

from __future__ import annotations

import re
import struct
from base64 import b64decode
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import md5
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.operators.windows import DAY, as_of
from huntframe.sources import views
from huntframe.sources.store import settled

BLOCK, LOOK = 1 << 16, 1 << 14
WAY = ["src_file", "src_ip", "src_port", "dst_ip", "dst_port"]
#: How far before the first segment caught an earlier one may lie, where there was no SYN.
SLACK = 1 << 20
FTP, TELNET = 21, 23
REQUEST = re.compile(rb"(GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH|TRACE|CONNECT|PROPFIND|MKCOL|MOVE|COPY|LOCK|UNLOCK) (\S+) HTTP/1\.[01]\r\n")
RESPONSE = re.compile(rb"HTTP/1\.[01] (\d{3})\b[^\r\n]*\r\n")
FTP_LINE = re.compile(rb"^(USER|PASS) +([^\r\n]*)\r?\n", re.M | re.I)
COMMON_NAME = b"\x06\x03\x55\x04\x03"
MESSAGE = "src_file string, line_no long, t string, src_ip string, src_port int, dst_ip string, dst_port int, stream_id string, kind string, fields map<string,string>"


def placed(packets: DataFrame) -> DataFrame:
    """Segments with data: the way's columns, ``conn`` (time of the SYN, or null), ``rel``, ``us``, ``line_no``, ``data``; each (place, length) once, as first sent."""
    tcp = packets.where("proto = 'tcp'").withColumn("us", F.round(F.col("t") * 1e6).cast("bigint"))
    some = tcp.where(F.length("data") > 0).select(*WAY, "us", "line_no", "seq", "data")
    syn = F.conv(F.substring("flags", 3, 8), 16, 10).cast("int").bitwiseAND(2) > 0
    # a SYN counts for data of the same time
    begun = tcp.where(syn).select(*WAY, (F.col("us") - 1).alias("us"), (F.col("seq") + 1).alias("isn"))
    known = as_of(some, begun, WAY, DAY, "isn", "isn", forward=False, outer=True)
    known = settled(known, "segments")
    first = settled(known.where("isn IS NULL").groupBy(*WAY).agg((F.min_by("seq", F.struct("us", "line_no")) - SLACK).alias("base")), "first-segments")
    whole = known.where("isn IS NOT NULL").withColumn("base", F.col("isn")).unionByName(known.where("isn IS NULL").join(first, WAY))
    rel = F.pmod(F.col("seq") - F.col("base"), F.lit(1 << 32))
    sent = F.struct("us", "line_no", "data")
    once = whole.withColumn("rel", rel).groupBy(*WAY, F.col("isn_us").alias("conn"), "rel", F.length("data").alias("size")).agg(F.min(sent).alias("sent"))
    return once.select(*WAY, "conn", "rel", "sent.us", "sent.line_no", "sent.data")


def messages(packets: DataFrame) -> DataFrame:
    """``MESSAGE``: HTTP requests and responses, TLS hellos and certificates, and credentials, with what they say as text."""
    rows = placed(packets)
    last = F.floor((F.col("rel") + F.length("data") - 1) / BLOCK).cast("bigint")
    first = F.greatest(F.lit(0), F.floor((F.col("rel") - LOOK) / BLOCK).cast("bigint"))
    cut = rows.withColumn("block", F.explode(F.sequence(first, last)))
    blocks = cut.groupBy(*WAY, "conn", "block").agg(F.collect_list(F.struct("rel", "us", "line_no", "data")).alias("parts"))
    pair = F.concat_ws("|", "src_file", views.pair_key())
    ready = blocks.select(*WAY, "block", "parts", F.abs(F.xxhash64(pair) % (1 << 53)).cast("string").alias("stream_id"))
    return ready.mapInArrow(_read, MESSAGE)


def runs(parts: list[tuple[int, int, int, bytes]], low: int, high: int) -> list[tuple[int, bytes]]:
    """(place, bytes) of what is covered without a gap between ``low`` and ``high``, from (place, time, line, data); what was sent first stays."""
    top = min(high, max(rel + len(data) for rel, _, _, data in parts))
    buffer = bytearray(max(0, top - low))
    for rel, _, _, data in sorted(parts, key=lambda p: (p[1], p[2]), reverse=True):
        data = data[max(0, low - rel) : max(0, top - rel)]
        at = max(rel, low) - low
        buffer[at : at + len(data)] = data
    out: list[list[int]] = []
    for start, end in sorted((max(rel, low), min(rel + len(data), top)) for rel, _, _, data in parts):
        if start >= end:
            continue
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, bytes(buffer[a - low : b - low])) for a, b in out]


def found(parts: list[tuple[int, int, int, bytes]], block: int, src_port: int, dst_port: int) -> Iterator[tuple[int, int, str, dict[str, str | None]]]:
    """(time, line, kind, fields) of the messages that begin in a block."""
    low = block * BLOCK
    starts: dict[int, tuple[int, int]] = {}
    for rel, us, line, _ in parts:
        starts[rel] = min(starts.get(rel, (us, line)), (us, line))
    order = sorted(starts)

    def sent(at: int) -> tuple[int, int]:
        """When the segment that a place lies in was sent, and its packet."""
        return starts[order[max(0, bisect_right(order, at) - 1)]]

    for start, data in runs(parts, low, low + BLOCK + LOOK):
        after = (m.end() + start for m in re.finditer(rb"\r\n\r\n", data))
        for at in sorted({a for a in (*order, *after) if start <= a < min(start + len(data), low + BLOCK)}):
            for kind, fields in begun(data, at - start):
                yield (*sent(at), kind, fields)
        if dst_port == FTP:
            for m in FTP_LINE.finditer(data):
                if start + m.start() < low + BLOCK:
                    text = m[2].decode("latin-1")
                    user = m[1].upper() == b"USER"
                    yield (*sent(start + m.start()), "creds", {"auth_type": "ftp-user" if user else "ftp-pass", "credential": text if user else ":" + text})
        if TELNET in (src_port, dst_port):
            for m in re.finditer(rb"login:|Password:", data):
                if start + m.start() < low + BLOCK:
                    yield (*sent(start + m.start()), "creds", {"auth_type": "telnet-prompt", "credential": None})


def begun(data: bytes, at: int) -> Iterator[tuple[str, dict[str, str | None]]]:
    """What begins at a place, if anything."""
    if data[at : at + 2] == b"\x16\x03":
        yield from handshakes(data, at)
        return
    m = REQUEST.match(data, at) or RESPONSE.match(data, at)
    if m is None:
        return
    end = data.find(b"\r\n\r\n", m.end() - 2)
    lines = data[m.end() : end if end >= 0 else at + LOOK].decode("latin-1").split("\r\n")
    lines = lines if end >= 0 else lines[:-1]  # the last line of a cut head may be a part of one
    head = {name.strip().lower(): value.strip() for name, _, value in reversed([x.partition(":") for x in lines if ":" in x])}
    fields = {"content_type": head.get("content-type"), "content_length": head.get("content-length"), "request_line_excerpt": None}
    if m.re is REQUEST:
        fields |= {"method": m[1].decode(), "uri": m[2].decode("latin-1"), "host": head.get("host"), "ua": head.get("user-agent"), "referer": head.get("referer")}
        fields["request_line_excerpt"] = ",".join(x + "\r\n" for x in lines if x)
    else:
        fields["status"] = m[1].decode()
    yield "http", fields
    kind, _, secret = head.get("authorization", "").partition(" ")
    if kind.lower() == "basic":
        try:
            yield "creds", {"auth_type": "http-basic", "credential": b64decode(secret, validate=True).decode("utf-8", "replace")}
        except ValueError:
            return


def handshakes(data: bytes, at: int) -> Iterator[tuple[str, dict[str, str | None]]]:
    """Hellos and the first certificate of the handshake records that begin here."""
    body = b""
    while data[at : at + 2] == b"\x16\x03" and at + 5 <= len(data):
        size = int.from_bytes(data[at + 3 : at + 5], "big")
        body += data[at + 5 : at + 5 + size]
        at += 5 + size
    place = 0
    while place + 4 <= len(body):
        kind, size = body[place], int.from_bytes(body[place + 1 : place + 4], "big")
        message = body[place + 4 : place + 4 + size]
        place += 4 + size
        try:
            if kind == 1:
                yield "client", client_hello(message)
            elif kind == 2:
                yield "server", server_hello(message)
            elif kind == 11:
                yield "certificate", {"utf8_name": common_name(message)}
        except (IndexError, struct.error):
            return


def _extensions(body: bytes, at: int) -> list[tuple[int, bytes]]:
    out, end = [], at + 2 + int.from_bytes(body[at : at + 2], "big")
    at += 2
    while at + 4 <= min(end, len(body)):
        kind, size = struct.unpack(">HH", body[at : at + 4])
        out.append((kind, body[at + 4 : at + 4 + size]))
        at += 4 + size
    return out


def _words(data: bytes) -> list[int]:
    return [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data) - 1, 2)]


def _grease(word: int) -> bool:
    return word & 0x0F0F == 0x0A0A and word >> 8 == word & 0xFF


def _digest(*lists: list[int]) -> str:
    return md5(",".join("-".join(map(str, x)) for x in lists).encode(), usedforsecurity=False).hexdigest()


def client_hello(body: bytes) -> dict[str, str | None]:
    """Name asked for, version, ciphers, and the digest of what the client offers."""
    version = int.from_bytes(body[:2], "big")
    at = 35 + body[34]
    size = int.from_bytes(body[at : at + 2], "big")
    ciphers = _words(body[at + 2 : at + 2 + size])
    at += 2 + size
    at += 1 + body[at]
    offered = _extensions(body, at) if at < len(body) else []
    of = dict(reversed(offered))
    name = of.get(0, b"")
    groups = [g for g in _words(of.get(10, b"")[2:]) if not _grease(g)]
    plain = [c for c in ciphers if not _grease(c)]
    return {
        "sni": name[5 : 5 + int.from_bytes(name[3:5], "big")].decode("latin-1") or None,
        "version": f"0x{version:04x}",
        "cipher": ",".join(f"0x{c:04x}" for c in ciphers),
        "ja3": _digest([version], plain, [k for k, _ in offered if not _grease(k)], groups, list(of.get(11, b"")[1:])),
    }


def server_hello(body: bytes) -> dict[str, str | None]:
    at = 35 + body[34]
    offered = _extensions(body, at + 3) if at + 3 < len(body) else []
    return {"ja3s": _digest([int.from_bytes(body[:2], "big")], [int.from_bytes(body[at : at + 2], "big")], [k for k, _ in offered])}


def common_name(body: bytes) -> str | None:
    """The subject's name in the first certificate: of the two names that come first, the issuer's is before it."""
    first = body[6 : 6 + int.from_bytes(body[3:6], "big")]
    names = [first[m.end() + 2 : m.end() + 2 + first[m.end() + 1]] for m in re.finditer(re.escape(COMMON_NAME), first) if m.end() + 1 < len(first)]
    return names[min(1, len(names) - 1)].decode("utf-8", "replace") if names else None


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[tuple]]]:
    """Blocks and their segments, column by column: a dictionary a segment costs more than reading it."""
    lists = batch.column("parts")
    flat = lists.flatten()
    parts = zip(*[flat.field(n).to_pylist() for n in ("rel", "us", "line_no", "data")], strict=True)
    for row, size in zip(batch.drop_columns(["parts"]).to_pylist(), lists.value_lengths().to_pylist(), strict=True):
        yield row, list(islice(parts, size))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string())}[k]) for n, k in (f.split(" ") for f in MESSAGE.split(", "))])
    for batch in batches:
        out = []
        for row, parts in (r for i in range(0, batch.num_rows, 100) for r in _rows(batch.slice(i, 100))):
            for us, line, kind, fields in found(parts, row["block"], row["src_port"], row["dst_port"]):
                said = [(k, v) for k, v in fields.items() if v is not None]
                out.append((row["src_file"], line, f"{us // 10**6}.{us % 10**6:06d}", row["src_ip"], row["src_port"], row["dst_ip"], row["dst_port"], row["stream_id"], kind, said))
        columns = zip(*out, strict=True) if out else [()] * len(schema)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)


def _of(rows: DataFrame, kinds: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds)).select("*", *[F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit("")).alias(n) for n in names]).drop("fields", "kind")


def http(rows: DataFrame) -> DataFrame:
    """Messages as records of the http view."""
    return views.http_view(_of(rows, ("http",), views.FIELDS["http"][6:]))


def tls(rows: DataFrame) -> DataFrame:
    """Client hellos as records of the tls view, with the name of their stream's first certificate and the server's digest."""
    server = _of(rows, ("server",), ("ja3s",)).groupBy("stream_id").agg(F.min_by("ja3s", "line_no").alias("ja3s"))
    hellos = _of(rows, ("client",), ("sni", "version", "cipher", "ja3")).join(settled(server, "server-hellos"), "stream_id", "left")
    certificates = _of(rows, ("certificate",), ("utf8_name", "printable_name", "dns_name"))
    return views.tls_view(hellos.withColumn("ja3s", F.coalesce("ja3s", F.lit(""))), certificates)


def creds(rows: DataFrame) -> DataFrame:
    """Credentials in the clear as records of the creds view."""
    return views.creds_view(_of(rows, ("creds",), ("auth_type", "credential")))
