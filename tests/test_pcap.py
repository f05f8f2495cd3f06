"""Captures made by hand."""

from __future__ import annotations

import random
import struct
from socket import AF_INET6, inet_aton, inet_pton

import pytest
from pyspark.sql import functions as F

from huntframe.rules import traffic
from huntframe.sources import pcap


def ip(src, dst, proto, body):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, inet_aton(src), inet_aton(dst)) + body


def tcp(src, sport, dst, dport, data=b"", seq=1):
    return ip(src, dst, 6, struct.pack(">HHIIHHHH", sport, dport, seq, 2, 0x5018, 100, 0, 0) + data)


def udp(src, sport, dst, dport, data):
    return ip(src, dst, 17, struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data)


def question(name, kind=16, answer=None):
    labels = b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0"
    head = struct.pack(">HHHHHH", 7, 0x8180 if answer else 0x0100, 1, 1 if answer else 0, 0, 0)
    body = head + labels + struct.pack(">HH", kind, 1)
    return body + (b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + inet_aton(answer) if answer else b"")


def capture(packets, order="<", link=1, cut=0):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    for t, data in packets:
        frame = b"\0" * 12 + b"\x08\x00" + data if link == 1 else data
        out += struct.pack(order + "IIII", int(t), int(round(t % 1 * 1e6)), len(frame), len(frame)) + frame
    return out[: len(out) - cut]


PACKETS = [
    (100.0, tcp("10.0.0.1", 5000, "10.0.0.2", 4444)), (100.5, tcp("10.0.0.2", 4444, "10.0.0.1", 5000, b"hello world, this is long")), (500.25, tcp("10.0.0.1", 5000, "10.0.0.2", 4444, b"x")),
    (101.0, udp("10.0.0.3", 999, "8.8.8.8", 53, question("a.example.com"))), (101.1, udp("8.8.8.8", 53, "10.0.0.3", 999, question("b.example.com", 1, "1.2.3.4"))),
    (102.0, ip("10.0.0.1", "10.0.0.2", 1, b"ping")),
]


@pytest.mark.parametrize("order,link", [("<", 1), (">", 1), ("<", 101)])
def test_packets(order, link):
    got = [pcap.packet(data) for _, data in pcap.frames(capture(PACKETS, order, link))]
    assert [g and g["proto"] for g in got] == ["tcp", "tcp", "tcp", "udp", "udp", None]
    assert (got[1]["src_ip"], got[1]["src_port"], got[1]["payload"], got[1]["flags"]) == ("10.0.0.2", 4444, b"hello world, thi".hex(), "0x0018")
    assert (got[3]["qname"], got[3]["qtype"], got[4]["response_ip"]) == ("a.example.com", "16", "1.2.3.4")


def test_odd_captures():
    assert list(pcap.frames(b"")) == list(pcap.frames(b"nothing at all here, no magic")) == []
    assert len(list(pcap.frames(capture(PACKETS, cut=3)))) == 5
    assert pcap.dns_fields(b"\0" * 40) == {} and pcap.dns_fields(b"\0\0\0\0\0\1" + b"\xc0\x0c" * 20)["qname"] == ""


def test_views(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture(PACKETS))
    (tmp_path / "bad.pcap").write_bytes(b"bad")
    packets = pcap.read_packets(spark, str(tmp_path))
    assert packets.count() == 5
    flow = {r.proto: r for r in pcap.flows(packets).collect()}
    raw = flow["tcp"].raw
    assert (flow["tcp"].src_ip, flow["tcp"].dst_port, raw.packets_a2b, raw.packets_b2a, raw.packets_total) == ("10.0.0.1", 4444, 2, 1, 3)
    assert (raw.duration_s, raw.rel_start, raw.payload_first_bytes, raw.bytes_a2b) == (400.25, 0.0, "hello world, thi", 81)
    names = pcap.dns(packets).orderBy("line_no").collect()
    assert [(r.raw.qname, r.raw.response_ip, r.ts) for r in names] == [("a.example.com", None, "1970-01-01T00:01:41+00:00"), ("b.example.com", "1.2.3.4", "1970-01-01T00:01:41.100000+00:00")]
    assert pcap.conn(packets).count() == 3
    found = traffic.detect(pcap.flows(packets), []).collect()
    assert [r.rule_id for r in found] == ["R-TRAF-008"]


def test_files_that_give_no_packets(spark):
    head = lambda order, magic, link: struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    files = [("a", head("<", 0xA1B2C3D4, 1)), ("b", head(">", 0xA1B23C4D, 101)), ("c", head("<", 0xA1B2C3D4, 147)), ("d", head(">", 0xA1B2C3D4, 189)), ("e", b"\x0a\x0d\x0d\x0a" + bytes(40)), ("f", b"")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    got = {r.path: r.reason for r in pcap.unread(df).collect()}
    assert got == {"c": "link type 147", "d": "link type 189", "e": "no classic capture", "f": "no classic capture"}


def ip6(src, dst, kind, body, extra=b""):
    return struct.pack(">IHBB", 6 << 28, len(extra) + len(body), kind, 64) + inet_pton(AF_INET6, src) + inet_pton(AF_INET6, dst) + extra + body


def tcp_body(sport, dport, data=b"", seq=1):
    return struct.pack(">HHIIHHHH", sport, dport, seq, 2, 0x5018, 100, 0, 0) + data


def blocks(packets, order="<", link=1, unit=None, late=None):
    """A next-generation capture; ``late`` describes a second interface before that packet and sends the rest through it."""
    block = lambda kind, body: struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))
    pad = lambda b: b + bytes(-len(b) % 4)
    option = struct.pack(order + "HH", 9, 1) + bytes([unit, 0, 0, 0]) + bytes(4) if unit is not None else b""
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(order + "HHI", link, 0, 0) + option)
    for n, (t, data) in enumerate(packets):
        if n == late:
            out += block(1, struct.pack(order + "HHI", 101, 0, 0))
        second = late is not None and n >= late
        frame = data if second or link == 101 else b"\0" * 12 + (b"\x86\xdd" if data[0] >> 4 == 6 else b"\x08\x00") + data
        ticks = round(t * (10**unit if unit is not None and not second else 10**6))
        out += block(6, struct.pack(order + "IIIII", int(second), ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + pad(frame))
        if n % 7 == 3:
            out += block(5, bytes(8))  # statistics
    return out


def test_ipv6():
    body = tcp_body(5000, 80, b"hello")
    plain = pcap.packet(ip6("2001:db8::1", "2001:db8::2", 6, body))
    assert (plain["src_ip"], plain["dst_ip"], plain["dst_port"], plain["payload"]) == ("2001:db8::1", "2001:db8::2", 80, b"hello".hex())
    hop = bytes([43, 0]) + bytes(6) + bytes([6, 1]) + bytes(14)
    assert pcap.packet(ip6("::1", "::2", 0, body, hop))["src_port"] == 5000
    first, later = (bytes([6, 0]) + struct.pack(">HI", offset, 7) for offset in (1, 8 << 3 | 1))
    assert pcap.packet(ip6("::1", "::2", 44, body, first))["proto"] == "tcp" and pcap.packet(ip6("::1", "::2", 44, body, later)) is None
    assert pcap.packet(ip6("::1", "::2", 6, body)[:50]) is None and pcap.packet(b"\x60" * 30) is None
    for link, frame in ((1, b"\0" * 12 + b"\x81\0\0\1\x86\xdd"), (113, b"\0" * 14 + b"\x86\xdd"), (276, b"\x86\xdd" + b"\0" * 18), (229, b"")):
        assert pcap.packet(pcap.ip_of(link, frame + ip6("::1", "::2", 6, body)))["dst_port"] == 80
    assert pcap.ip_of(147, b"x" * 60) is None and pcap.ip_of(1, b"") is None


def test_dns_answers_have_no_cap():
    labels = b"\x01a\0"
    aliases = b"".join(b"\xc0\x0c" + struct.pack(">HHIH", 5, 1, 60, 2) + b"\xc0\x0c" for _ in range(50))
    message = struct.pack(">HHHHHH", 7, 0x8180, 1, 51, 0, 0) + labels + struct.pack(">HH", 1, 1) + aliases + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + inet_aton("9.9.9.9")
    assert pcap.dns_fields(message)["response_ip"] == "9.9.9.9"


def long_capture(make, n=900, seed=1):
    """Packets of all sizes, some of which hold captures themselves."""
    rnd = random.Random(seed)
    inner = make([(5.0, tcp("1.1.1.1", 1, "2.2.2.2", 2, bytes(20))) for _ in range(12)])
    packets = []
    for i in range(n):
        data = rnd.choice([b"", rnd.randbytes(rnd.randint(1, 1400)), inner[: rnd.randint(0, len(inner))], inner * 3, bytes(rnd.randint(0, 3000))])
        kind = rnd.random()
        ip_packet = tcp(f"10.0.{i % 7}.1", 5000 + i % 5, "10.9.9.9", 80, data, i) if kind < 0.6 else ip6("2001:db8::1", "2001:db8::2", 6, tcp_body(1, 2, data, i)) if kind < 0.9 else ip("1.1.1.1", "2.2.2.2", 1, b"ping")
        packets.append((100.0 + i, ip_packet))
    return packets


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("size", [16_000, 100_000])
def test_ranges_give_the_rows_of_one_pass(spark, tmp_path, size):
    from huntframe.sources import captures

    classic = lambda order: lambda packets: capture([(t, d) for t, d in packets], order, 101)
    files = {
        "a.pcap": classic("<")(long_capture(classic("<"), 250)), "b.pcap": classic(">")(long_capture(classic(">"), 150, 2))[:-9], "c.pcapng": blocks(long_capture(blocks, 250, 3)),
        "d.pcapng": blocks(long_capture(blocks, 120, 4), ">", unit=9), "late.pcapng": blocks(long_capture(blocks, 90, 5), late=40), "empty.pcap": b"", "none.pcap": b"no capture at all", "head.pcap": classic("<")([]),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    whole = captures.read_packets(spark, str(tmp_path), size=1 << 30, whole=True)
    got = captures.read_packets(spark, str(tmp_path), size=size, whole=True)
    assert tuples(got) == tuples(whole)
    per_file = {r.src_file.rsplit("/", 1)[-1]: r["count"] for r in whole.groupBy("src_file").count().collect()}
    assert set(per_file) == {"a.pcap", "b.pcap", "c.pcapng", "d.pcapng", "late.pcapng"} and per_file["late.pcapng"] > 70
    assert captures.ranges(spark, str(tmp_path), size=size).count() > len(files)
    plain = pcap.read_packets(spark, str(tmp_path), "*.pcap")
    assert tuples(plain) == tuples(whole.where("src_file LIKE '%.pcap'").select(*plain.columns))


def test_a_range_inside_a_capture_in_a_packet_is_not_misled(spark, tmp_path):
    """A capture in a packet: its chain is cut by the outer header, or, if it ends with the packet, found out by the range before."""
    from huntframe.sources import captures

    inner = capture([(5.0, tcp("1.1.1.1", 1, "2.2.2.2", 2, bytes(20))) for _ in range(700)], link=101)
    rest = [(10.0 + i, tcp("10.0.0.1", 1, "10.0.0.2", 2, b"x" * 900)) for i in range(200)]
    data = capture([(9.0, tcp("10.0.0.1", 1, "10.0.0.2", 2, inner + b"tail")), *rest], link=101)
    read = captures.Bytes(lambda at, n: data[at : at + n], len(data))
    head = captures.head_of(read)
    first_end = captures.step(read, head, 24)
    assert all(captures.border(read, head, at) == first_end for at in range(25, first_end, 997))
    ending = capture([(9.0, tcp("10.0.0.1", 1, "10.0.0.2", 2, inner)), *rest], link=101)
    read = captures.Bytes(lambda at, n: ending[at : at + n], len(ending))
    assert captures.border(read, head, 20_000) < captures.step(read, head, 24)
    (tmp_path / "x.pcap").write_bytes(ending)
    got = captures.read_packets(spark, str(tmp_path), size=20_000)
    assert got.count() == 201 and got.where("src_ip = '1.1.1.1'").count() == 0 and got.agg(F.max("line_no")).first()[0] == 201


def test_names_of_stores():
    from huntframe.sources.store import file_system, translated

    assert translated("s3a://bucket/a/b.pcap") == "s3://bucket/a/b.pcap" and translated("s3n://b/a") == "s3://b/a"
    assert translated("dbfs:/a/b") == "/dbfs/a/b" and translated("hdfs://n:1/a") == "hdfs://n:1/a"
    assert file_system("file:///tmp/x")[1] == "/tmp/x"
