"""Long captures, classic or next-generation, in byte ranges of any size.

A capture has no marks between its packets, so a range looks for its first one: the first place
from which a chain of plausible packet headers leads further than the longest packet is long.  A
capture inside a packet (a download of one, say) mostly can't do that, since the outer packet's
header cuts its chain; one that ends with its packet can.  So each range reads on to the first
packet that begins behind its end, and that must be the next range's first one: where it isn't,
the range is read again from there.  The rows are those of one pass over the file.

Files are opened with Arrow's file systems; where these can't, ``pcap.read_packets`` reads whole
files with Spark.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.sources import pcap
from huntframe.sources.store import file_system, settled

RANGE_BYTES = 64 << 20
#: The longest packet where a file doesn't say; block kinds and magic numbers of the next-generation format (fixed values).
LONGEST = 262_144
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
ORDERS = {b"\x1a\x2b\x3c\x4d": ">", b"\x4d\x3c\x2b\x1a": "<"}
CHUNK = 4 << 20
#: A table of ranges is broadcast up to this many rows.
MOST_RANGES = 100_000


class Bytes:
    """Random reads of a file through one buffer."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size, self.start, self.data = read_at, size, 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        if not self.start <= at <= at + n <= self.start + len(self.data):
            self.start, self.data = at, self.read_at(at, max(n, min(CHUNK, self.size - at))) if at < self.size else b""
        return self.data[at - self.start : at - self.start + n]


@dataclass
class Head:
    """What the start of a file says: how to read the rest of it."""

    kind: str  # classic, blocks, or empty for other files
    order: str = "<"
    first: int = 0
    longest: int = LONGEST
    links: list[tuple[int, float]] = field(default_factory=list)  # link type and unit of time of each interface


def head_of(read: Bytes) -> Head:
    data = read(0, 24)
    if data[:4] in pcap.MAGIC and len(data) == 24:
        order, unit = pcap.MAGIC[data[:4]]
        snap, link = struct.unpack(order + "II", data[16:24])
        return Head("classic", order, 24, snap if 0 < snap <= LONGEST else LONGEST, [(link & 0x0FFFFFFF, unit)])
    if int.from_bytes(data[:4], "big") != SECTION or data[8:12] not in ORDERS:
        return Head("")
    head = Head("blocks", ORDERS[data[8:12]])
    at = 0
    while (block := read(at, 8)) and len(block) == 8:
        kind, size = struct.unpack(head.order + "II", block)
        if size < 12 or kind in (OLD_PACKET, SIMPLE_PACKET, PACKET):
            break
        if kind == INTERFACE:
            head.links.append(interface(read(at + 8, size - 12), head.order))
        at += size
    head.first = at
    head.longest = LONGEST + 4096
    return head


def interface(body: bytes, order: str) -> tuple[int, float]:
    """Link type and unit of time of an interface's description."""
    unit, at = 1e-6, 8
    while at + 4 <= len(body):
        code, size = struct.unpack(order + "HH", body[at : at + 4])
        if code == 0:
            break
        if code == 9 and size == 1:
            power = body[at + 4]
            unit = 2.0 ** -(power & 0x7F) if power & 0x80 else 10.0**-power
        at += 4 + (size + 3) // 4 * 4
    return struct.unpack(order + "H", body[:2])[0], unit


def step(read: Bytes, head: Head, at: int) -> int:
    """Where the packet or block at ``at`` ends, if its header is plausible; else 0.  A cut last one ends with the file."""
    if head.kind == "classic":
        raw = read(at, 16)
        if len(raw) < 16:
            return read.size if at + len(raw) == read.size and raw else 0
        _, fraction, size, whole = struct.unpack(head.order + "IIII", raw)
        if size > head.longest or whole < size or fraction * head.links[0][1] >= 1 or whole > 1 << 20:
            return 0
        return min(at + 16 + size, read.size)
    raw = read(at, 8)
    if len(raw) < 8:
        return read.size if raw else 0
    size = struct.unpack(head.order + "I", raw[4:])[0]
    if size < 12 or size % 4 or size > head.longest or struct.unpack(head.order + "I", raw[:4])[0] > 0x0BFF and raw[:4] != b"\x0a\x0d\x0d\x0a":
        return 0
    if at + size > read.size:
        return read.size
    return at + size if read(at + size - 4, 4) == raw[4:] else 0


def plausible(read: Bytes, head: Head, at: int) -> bool:
    """Whether a chain of headers leads from here further than any packet is long, or to the end of the file."""
    far = at + head.longest + 16
    while at < min(far, read.size):
        if not (at := step(read, head, at)):
            return False
    return True


def border(read: Bytes, head: Head, begin: int) -> int:
    """The first packet or block at ``begin`` or later; the file's size if there is none."""
    if begin <= head.first:
        return head.first
    data = read(begin, min(2 * head.longest + 64, read.size - begin))
    starts = np.arange(max(0, len(data) - 16))
    if len(starts):
        # four-byte fields at every place at once: only sizes that can be are walked from
        raw = np.frombuffer(data, np.uint8).astype(np.uint32)
        order = (0, 1, 2, 3) if head.order == "<" else (3, 2, 1, 0)
        field_at = lambda k: sum(raw[k + i : k + i + len(starts)] << np.uint32(8 * o) for i, o in enumerate(order))
        if head.kind == "classic":
            size, whole = field_at(8), field_at(12)
            starts = starts[(size <= head.longest) & (whole >= size) & (whole <= 1 << 20) & (field_at(4) < round(1 / head.links[0][1]))]
        else:
            size = field_at(4)
            starts = starts[(size >= 12) & (size % 4 == 0) & (size <= head.longest) & ((starts + begin) % 4 == 0)]
    for at in starts.tolist():
        if plausible(read, head, begin + at):
            return begin + at
    return read.size


def walk(read: Bytes, head: Head, at: int, end: int) -> Iterator[tuple[int, float | None, int, bytes]]:
    """(where it ends, time, link type, frame) of the packets that begin in [at, end); interfaces on the way are learnt.  Other blocks have the link type -1."""
    while at < end:
        to = step(read, head, at)
        if not to:
            return
        if head.kind == "classic":
            raw = read(at, to - at)
            if len(raw) < 16:
                return
            seconds, fraction, size, _ = struct.unpack(head.order + "IIII", raw[:16])
            if len(raw) < 16 + size:
                return
            yield to, seconds + fraction * head.links[0][1], head.links[0][0], raw[16:]
        else:
            raw = read(at, to - at)
            kind = struct.unpack(head.order + "I", raw[:4])[0] if len(raw) > 11 else 0
            if kind == SECTION:
                head.order, head.links = ORDERS.get(raw[8:12], head.order), []
            elif kind == INTERFACE:
                head.links.append(interface(raw[8:-4], head.order))
            yield (to, *block_frame(kind, raw[8:-4], head))
        at = to


def block_frame(kind: int, body: bytes, head: Head) -> tuple[float | None, int, bytes]:
    if kind == SIMPLE_PACKET and len(body) >= 4 and head.links:
        return None, head.links[0][0], body[4 : 4 + struct.unpack(head.order + "I", body[:4])[0]]
    if kind not in (PACKET, OLD_PACKET) or len(body) < 20:
        return None, -1, b""
    which, high, low, size, _ = struct.unpack(head.order + "IIIII", body[:20])
    which = struct.unpack(head.order + "H", body[:2])[0] if kind == OLD_PACKET else which
    link, unit = head.links[which] if which < len(head.links) else (-1, 1.0)
    return (high << 32 | low) * unit, link, body[20 : 20 + size]


OUT = f"{pcap.PACKET}, data binary, begin long, found long, stop long, total long, described boolean"
_FIELDS = [tuple(f.split(" ")) for f in OUT.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(n) for r in rows], _TYPES[k]) for n, k in _FIELDS], [n for n, _ in _FIELDS])


def _read(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, begin, end, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = file_system(path)
                with fs.open_input_file(at) as f:
                    yield from _range(path, Bytes(lambda a, n, f=f: f.read_at(n, a), size), begin, end, known, whole)

    return run


def _range(path: str, read: Bytes, begin: int, end: int, known: int | None, whole: bool) -> Iterator[pa.RecordBatch]:
    head = head_of(read)
    found = known if known is not None else border(read, head, begin) if head.kind else read.size
    rows: list[dict] = []
    n, stop, links = 0, found, len(head.links)
    described = False
    for stop, t, link, frame in walk(read, head, found, end) if head.kind else ():
        described = described or (head.kind == "blocks" and len(head.links) != links)
        ip = pcap.ip_of(link, frame)
        if ip is None:
            continue
        n += 1
        row = pcap.packet(ip, whole)
        if row is not None:
            rows.append(row | {"src_file": path, "line_no": n, "t": t, "begin": begin})
        if len(rows) >= 5_000:
            yield _batch(rows)
            rows = []
    yield _batch([*rows, {"src_file": path, "begin": begin, "found": found, "stop": max(stop, found), "total": n, "described": described and end - begin < read.size}])


def ranges(spark: SparkSession, path: str, glob: str = "*.pcap*", size: int = RANGE_BYTES) -> DataFrame:
    """``path, length, begin, end, start`` of the byte ranges of all files; Spark lists them without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long")))
    cut = files.withColumn("begin", begin)
    return cut.select("path", "length", "begin", F.least(F.col("begin") + size, "length").alias("end"), F.lit(None).cast("long").alias("start"))


def _one_each(parts: DataFrame) -> DataFrame:
    return parts.repartition(max(1, min(parts.count(), 20_000)))


def read_packets(spark: SparkSession, path: str, glob: str = "*.pcap*", size: int = RANGE_BYTES, whole: bool = False) -> DataFrame:
    """``pcap.PACKET`` rows of all captures below ``path``; ``line_no`` is the IP packet's number in its file, ``whole`` adds the payload as ``data``.

    Files that are no captures, and links that aren't known, give no rows.  A file of blocks that
    describes interfaces later than at its start is read again as one range.
    """
    parts = ranges(spark, path, glob, size)
    rows = settled(_one_each(parts).mapInArrow(_read(whole), OUT), "packets")
    told = rows.where("total IS NOT NULL").select("src_file", "begin", "found", "stop", "total", "described")
    order = Window.partitionBy("src_file").orderBy("begin")
    while True:
        told = settled(told, "ranges")
        late = told.where("described").select(F.col("src_file").alias("path")).distinct()
        # a range whose predecessor ended elsewhere begins there; one that lies wholly inside a packet begins at its end
        before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
        wrong = told.withColumn("due", before).where("due <> found AND NOT described")
        wrong = wrong.join(late, wrong["src_file"] == late["path"], "left_anti").select(F.col("src_file").alias("path"), "begin", F.col("due").alias("start"))
        whole_files = parts.join(late, "path", "left_semi").where("begin = 0").select("path", "length", "begin", F.col("length").alias("end"), "start")
        again = parts.drop("start").join(wrong, ["path", "begin"]).select("path", "length", "begin", "end", "start").unionByName(whole_files)
        again = settled(again, "again")
        if again.isEmpty():
            break
        repeated = settled(_one_each(again).mapInArrow(_read(whole), OUT), "packets")
        keep = rows.join(F.broadcast(again.select(F.col("path").alias("src_file"), "begin")), ["src_file", "begin"], "left_anti")
        keep = keep.join(F.broadcast(late.withColumnRenamed("path", "src_file")), "src_file", "left_anti")
        rows = keep.select(*repeated.columns).unionByName(repeated)
        told = rows.where("total IS NOT NULL").select("src_file", "begin", "found", "stop", "total", "described")
    base = told.select("src_file", "begin", F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    base = settled(base, "bases")
    base = F.broadcast(base) if base.count() <= MOST_RANGES else base
    numbered = rows.where("total IS NULL").join(base, ["src_file", "begin"]).withColumn("line_no", F.col("line_no") + F.col("base"))
    names = [f.split(" ")[0] for f in pcap.PACKET.split(", ")]
    return numbered.select(*names, *(["data"] if whole else []))
