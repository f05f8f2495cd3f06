"""Conversations cut into segments that are lost, repeated, overlapping and out of order."""

from __future__ import annotations

import random
import struct
from base64 import b64encode
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from huntframe.sources import pcap
from huntframe.sources import reassembly as R
from tests.test_pcap import capture, tcp

PACKETS = f"{pcap.PACKET}, data binary"


def head(n, extra=""):
    return f"POST /p{n}?q=1 HTTP/1.1\r\nHost: h{n}.example\r\nUser-Agent: agent/{n}\r\n{extra}Content-Length: 7\r\n\r\n"


def record(kind, body):
    message = bytes([kind]) + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(message)) + message


def hello(name, grease=True):
    listed = lambda *x: struct.pack(f">{len(x)}H", *x)
    extension = lambda kind, body: struct.pack(">HH", kind, len(body)) + body
    ciphers = listed(*([0x1A1A] if grease else []), 0x1301, 0xC02F)
    server = extension(0, struct.pack(">HBH", len(name) + 3, 0, len(name)) + name.encode())
    more = (extension(0x2A2A, b"") if grease else b"") + server + extension(10, listed(4, 0x001D, 0x0017)) + extension(11, b"\x01\x00")
    return record(1, b"\x03\x03" + bytes(32) + b"\x04" + bytes(4) + struct.pack(">H", len(ciphers)) + ciphers + b"\x01\x00" + struct.pack(">H", len(more)) + more)


def certificate(*names):
    body = b"".join(R.COMMON_NAME + b"\x0c" + bytes([len(n)]) + n.encode() for n in names)
    return record(11, (len(body) + 3).to_bytes(3, "big") + len(body).to_bytes(3, "big") + body)


def rows_of(way, stream, rnd, isn=None, start=100.0, cuts=None, chaos=True):
    """Segments of a stream as packets; with chaos some are repeated, overlap or change places."""
    isn = rnd.randrange(1 << 32) if isn is None else isn
    cuts = sorted(cuts or rnd.sample(range(1, len(stream)), min(len(stream) - 1, 5)))
    spans = list(zip([0, *cuts], [*cuts, len(stream)], strict=True))
    if chaos:
        spans += [rnd.choice(spans) for _ in range(3)] + [(max(0, a - 3), b) for a, b in spans[1:2]]
        rnd.shuffle(spans)
    out = [(*way, start, isn, "0x0002", b"")]
    return out + [(*way, start + 0.001 * (k + 1), (isn + 1 + a) % (1 << 32), "0x0018", stream[a:b]) for k, (a, b) in enumerate(spans)]


def frame(spark, rows):
    made = [("f", n, t, src, dst, sp, dp, "tcp", seq, 0, flags, 40, None, None, None, None, None, bytearray(data)) for n, (src, sp, dst, dp, t, seq, flags, data) in enumerate(rows, 1)]
    return spark.createDataFrame(made, PACKETS).repartition(3)


def test_views_of_planted_conversations(spark):
    rnd = random.Random(2)
    rows, want = [], []
    for n in range(30):
        way = (f"10.0.0.{n}", 5000 + n, "10.9.9.9", 80)
        stream = (head(n) + "payload" + head(n + 100, f"Authorization: Basic {b64encode(f'u{n}:secret:x'.encode()).decode()}\r\n") + "payload").encode()
        second = len(head(n)) + 7
        rows += rows_of(way, stream, rnd, isn=(1 << 32) - 30 if n % 3 == 0 else None, cuts=[second, *rnd.sample(range(5, second), 3)])
        want += [(f"10.0.0.{n}", "POST", f"h{k}.example", f"/p{k}?q=1", f"agent/{k}") for k in (n, n + 100)]
        rows += rows_of((way[2], way[3], way[0], way[1]), b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\n", rnd)
    rnd.shuffle(rows)
    found = R.messages(frame(spark, rows)).cache()
    http = R.http(found)
    got = http.where("raw.method IS NOT NULL").select("src_ip", "raw.method", "raw.host", "raw.uri", "raw.ua").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert http.where("raw.status = 404 AND src_port = 80 AND raw.content_type = 'text/html'").count() == 30
    creds = [tuple(r) for r in R.creds(found).select("raw.auth_type", "raw.username", "raw.password_masked").collect()]
    assert sorted(creds) == sorted(("http-basic", f"u{n}", "***<8>") for n in range(30))
    assert http.where("raw.request_line_excerpt LIKE 'Host: h%,User-Agent: %'").count() == 60


def test_tls_and_its_digests(spark):
    rnd = random.Random(3)
    client, server = ("10.0.0.1", 5000, "10.0.0.2", 443), ("10.0.0.2", 443, "10.0.0.1", 5000)
    answer = record(2, b"\x03\x03" + bytes(32) + b"\x00" + b"\x13\x01\x00" + struct.pack(">HHH", 4, 43, 0)) + certificate("Issuer", "subject.example")
    rows = [*rows_of(client, hello("a.example"), rnd), *rows_of(server, answer, rnd), *rows_of(("10.0.0.3", 1, "10.0.0.2", 443), hello("b.example", False), rnd)]
    got = {r.src_ip: r.raw for r in R.tls(R.messages(frame(spark, rows))).collect()}
    ja3 = md5(b"771,4865-49199,0-10-11,29-23,0", usedforsecurity=False).hexdigest()
    assert (got["10.0.0.1"].sni, got["10.0.0.1"].ja3, got["10.0.0.1"].cert_cn, got["10.0.0.1"].cipher) == ("a.example", ja3, "subject.example", "0x1a1a,0x1301,0xc02f")
    assert got["10.0.0.1"].ja3s == md5(b"771,4865,43", usedforsecurity=False).hexdigest() and got["10.0.0.3"].ja3 == ja3 and got["10.0.0.3"].ja3s is None


def test_lost_segments_and_other_credentials(spark):
    rnd = random.Random(4)
    lost = rows_of(("10.0.0.1", 1, "10.9.9.9", 80), head(1).encode(), rnd, cuts=[30, 60], chaos=False)
    del lost[2]  # the middle of the head
    ftp = rows_of(("10.0.0.2", 2, "10.9.9.9", 21), b"USER bob\r\nPASS hunter2\r\nQUIT\r\n", rnd, cuts=[4, 15])
    telnet = rows_of(("10.9.9.9", 23, "10.0.0.3", 3), b"welcome\r\nlogin: ", rnd, cuts=[12])
    middle = rows_of(("10.0.0.4", 4, "10.9.9.9", 80), head(4).encode(), rnd, cuts=[10])[1:]  # no SYN
    again = rows_of(("10.0.0.4", 4, "10.9.9.9", 80), head(5).encode(), rnd, start=900.0)  # the same ports, later
    found = R.messages(frame(spark, [*lost, *ftp, *telnet, *middle, *again])).cache()
    http = sorted((r.src_ip, r.raw.uri, r.raw.host, r.raw.ua) for r in R.http(found).collect())
    assert http == [("10.0.0.1", "/p1?q=1", None, None), ("10.0.0.4", "/p4?q=1", "h4.example", "agent/4"), ("10.0.0.4", "/p5?q=1", "h5.example", "agent/5")]
    creds = sorted((r.raw.auth_type, r.raw.username, r.raw.password_masked) for r in R.creds(found).collect())
    assert creds == [("ftp-pass", None, "***<7>"), ("ftp-user", "bob", None), ("telnet-prompt", None, None)]
    assert R.messages(frame(spark, lost[:0] or [(*lost[0][:-1], b"")])).count() == 0


def test_a_long_stream_is_many_blocks(spark):
    """Heads at any place of a transfer, across the borders of blocks too, are found once."""
    rnd = random.Random(5)
    stream, places = b"", []
    for n in range(12):
        stream += rnd.randbytes(rnd.choice([R.BLOCK - 40, 30_000, R.BLOCK // 2 + 11])) if n else b""
        places.append(len(stream))
        stream += head(n).encode()
    cuts = sorted({*range(1400, len(stream), 1400), *places[1:]})
    rows = rows_of(("10.0.0.1", 1, "10.9.9.9", 80), stream, rnd, cuts=cuts)
    got = [r.raw.uri for r in R.http(R.messages(frame(spark, rows))).collect()]
    assert sorted(got) == sorted(f"/p{n}?q=1" for n in range(12))
    cut = R.placed(frame(spark, rows))
    assert cut.agg(F.sum(F.length("data"))).first()[0] <= len(stream) + 1403


def test_from_a_capture(spark, tmp_path):
    from huntframe.sources import captures

    data = head(1).encode()
    packets = [(1.0, tcp("10.0.0.1", 9, "10.0.0.2", 80, data[:20], 7)), (1.5, tcp("10.0.0.1", 9, "10.0.0.2", 80, data[20:], 27))]
    (tmp_path / "x.pcap").write_bytes(capture(packets))
    rows = R.http(R.messages(captures.read_packets(spark, str(tmp_path), whole=True))).collect()
    assert [(r.raw.uri, r.line_no, r.ts) for r in rows] == [("/p1?q=1", 1, "1970-01-01T00:00:01+00:00")]


@pytest.mark.parametrize("body", [b"", b"\x03\x03", bytes(34), b"\x03\x03" + bytes(32) + b"\xff", b"\xff" * 80])
def test_broken_hellos(body):
    assert all(k in ("client", "server", "certificate") for kind in (1, 2, 11) for k, _ in R.handshakes(record(kind, body), 0))
