"""WARC archives with a two-level capture index.

``write_archives`` writes every page as a record, each its own gzip member, one file a task (and
a new one when a file is large).  ``build_index`` sorts the captures by reversed-host URL key,
cuts them into blocks of lines that are compressed one by one, and keeps for each shard a
sparse directory: the first key of each block and its place.  ``lookup`` sorts the wanted keys
into the same ranges; a task finds the shard and the block by binary search, reads that block
only, and searches it.  ``read_records`` then reads just the bytes of the records.

Files are written where ``spark.checkpoint.dir`` points, under names of their own; a table of
what was written goes through Spark's writers, so of a task that ran twice only the files of
the attempt that counted are ever looked at.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1
from uuid import UUID, uuid4, uuid5

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.llm.store import new_dir, partitions, written
from huntframe.sources.store import file_system

FILE_BYTES = 1 << 30
BLOCK_LINES = 1000
DATE = "2024-01-01T00:00:00Z"
RESPONSE, REVISIT = "response", "revisit"
_SPACE = UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a name that Spark reads, such as ``s3a://bucket/...``."""
    return file_system(path)


def _gzip(data: bytes) -> bytes:
    tool = zlib.compressobj(4, zlib.DEFLATED, 31)
    return tool.compress(data) + tool.flush()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(sha1(payload, usedforsecurity=False).digest()).decode()


def url_key(url: Column) -> Column:
    """``com,example,blog)/path?query``: the host reversed, in lower case, without scheme, user,
    leading ``www``, default port and fragment.  A null URL has the key ``)``."""
    plain = F.regexp_replace(F.trim(F.coalesce(url.cast("string"), F.lit(""))), "#.*$", "")
    authority = F.regexp_extract(plain, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, "^.*@", "")), "^www[0-9]*\\.|:(?:80|443)?$", "")
    rest = F.regexp_replace(plain, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*", "")
    name, port = F.regexp_replace(host, ":[0-9]*$", ""), F.regexp_extract(host, ":[0-9]+$", 0)
    return F.concat(F.array_join(F.reverse(F.split(name, "\\.")), ","), port, F.lit(")"), F.lower(rest))


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record of an HTTP response, or of a revisit without its payload."""
    uri = (url or "").encode("utf-8", "replace").decode().replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
    block = http + payload if kind == RESPONSE else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid5(_SPACE, f'page:{page_id}:{digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == REVISIT:
        head += [
            f"WARC-Profile: {_PROFILE}",
            f"WARC-Refers-To: <urn:uuid:{uuid5(_SPACE, f'page:{refers_to}:{digest}')}>",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and the HTTP body of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def with_record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, record_type, refers_to``.  Of pages with equal payloads of at least
    ``min_bytes`` the largest ``page_id`` is the response (rows repeated with that id too), the
    others revisit it; null ids are never the largest, and all are responses if there is no other.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    key = F.unhex(F.sha1(F.encode("html", "UTF-8")))
    # Written, so that the join is one of two tables: Spark splits a payload that a third of the pages share, as it can't
    # where the other side is still being aggregated.
    shared = written(
        rows.where(F.octet_length("html") >= min_bytes)
        .select("page_id", key.alias("sha"))
        .groupBy("sha")
        .agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND winner IS NOT NULL")
        .select("sha", "winner"),
        "payloads",
    )
    again = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return rows.withColumn("sha", key).join(shared, "sha", "left").select(
        "page_id",
        "url",
        "html",
        F.when(again, F.lit(REVISIT)).otherwise(F.lit(RESPONSE)).alias("record_type"),
        F.when(again, F.col("winner")).alias("refers_to"),
    )


@dataclass
class Archive:
    """Where an archive's files are, and the table of its captures."""

    path: str
    captures: DataFrame


def write_archives(pages: DataFrame, path: str | None = None, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> Archive:
    """Write all pages; ``captures`` has ``key, page_id, record_type, digest, file, offset, size``."""
    spark = pages.sparkSession
    path = path or new_dir(spark, "warc")
    fs, at = _open(path)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(path)
        out, name, offset = None, "", 0
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], [], []]
            for row in zip(*batch.columns, strict=True):
                key, page_id, url, html, kind, target = (v.as_py() for v in row)  # one page at a time as Python objects
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                payload = html.encode("utf-8", "replace")
                digest = digest_of(payload)
                data = _gzip(record(page_id, url, kind, payload, digest, target))
                out.write(data)
                for column, value in zip(rows, (key, page_id, kind, digest, name, offset, len(data)), strict=True):
                    column.append(value)
                offset += len(data)
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                ["key", "page_id", "record_type", "digest", "file", "offset", "size"],
            )
        if out is not None:
            out.close()

    rows = with_record_types(pages, min_bytes).select(url_key(F.col("url")).alias("key"), "page_id", "url", "html", "record_type", "refers_to")
    fields = "key string, page_id long, record_type string, digest string, file string, offset long, size long"
    return Archive(path, written(rows.mapInArrow(run, fields), "captures"))


@dataclass
class Index:
    """Shards in key order: (first key, first page, file).  One entry a shard, as many as partitions."""

    path: str
    shards: list[tuple[str, int, str]]


_NO_PAGE = -(1 << 63)


def build_index(archive: Archive, block_lines: int = BLOCK_LINES) -> Index:
    """Write the captures as sorted compressed blocks with a sparse directory for each shard."""
    spark = archive.captures.sparkSession
    path = archive.path + "/index"
    fs, at = _open(path)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(path)
        name, directory, lines, offset, out = f"{uuid4().hex}", [], [], 0, None

        def flush() -> int:
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            directory.append([lines[0][0], lines[0][1], offset, len(data)])
            out.write(data)
            lines.clear()
            return offset + len(data)

        for batch in batches:
            if out is None and batch.num_rows:
                out = fs.open_output_stream(f"{at}/{name}.cdx", compression=None)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(row)
                if len(lines) >= block_lines:
                    offset = flush()
        if out is not None:
            if lines:
                offset = flush()
            out.close()
            with fs.open_output_stream(f"{at}/{name}.idx", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode(), 6))
            first = directory[0]
            yield pa.record_batch([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([name])], ["key", "page", "shard"])

    rows = archive.captures.select("key", F.coalesce("page_id", F.lit(_NO_PAGE)).alias("page"), "record_type", "digest", "file", "offset", "size")
    shards = written(
        rows.repartitionByRange(partitions(spark), "key", "page")
        .sortWithinPartitions("key", "page", "digest", "file", "offset")
        .mapInArrow(run, "key string, page long, shard string"),
        "shards",
    )
    return Index(path, sorted((r.key, r.page, r.shard) for r in shards.collect()))


class _Reader:
    """Binary search in one index; keeps the last directory and the last block it read."""

    def __init__(self, index: Index):
        self.fs, self.at = _open(index.path)
        self.shards = index.shards
        self.tops = [(k, p) for k, p, _ in index.shards]
        self.shard = self.block = None

    def directory(self, i: int) -> list:
        if self.shard != i:
            with self.fs.open_input_file(f"{self.at}/{self.shards[i][2]}.idx") as f:
                self.blocks = json.loads(zlib.decompress(f.read()))
            self.starts, self.shard, self.block = [(k, p) for k, p, _, _ in self.blocks], i, None
        return self.starts

    def lines(self, j: int) -> list:
        if self.block != j:
            _, _, offset, size = self.blocks[j]
            with self.fs.open_input_file(f"{self.at}/{self.shards[self.shard][2]}.cdx") as f:
                data = zlib.decompress(f.read_at(size, offset))
            self.rows = [json.loads(x) for x in data.decode().split("\n")]
            self.places, self.block = [(k, p) for k, p, *_ in self.rows], j
        return self.rows

    def find(self, low: tuple[str, int], high: tuple[str, int]) -> Iterator[list]:
        """Lines from key ``low`` to key ``high``, both included."""
        for i in range(max(0, bisect_left(self.tops, low) - 1), bisect_right(self.tops, high)):
            starts = self.directory(i)
            for j in range(max(0, bisect_left(starts, low) - 1), bisect_right(starts, high)):
                rows = self.lines(j)
                yield from rows[bisect_left(self.places, low) : bisect_right(self.places, high)]


def lookup(index: Index, wanted: DataFrame) -> DataFrame:
    """Captures of the keys in ``wanted`` (``key``, and ``page_id``: null for every capture of the key).

    Returns ``key, page_id, record_type, digest, file, offset, size``, a row for each capture
    found; keys without any give no row.  Wanted rows that repeat are looked up once.
    """
    if not index.shards:
        return wanted.sparkSession.createDataFrame([], "key string, page_id long, record_type string, digest string, file string, offset long, size long")
    names = ["key", "page_id", "record_type", "digest", "file", "offset", "size"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(index)
        for batch in batches:
            found: list[list] = []
            for key, page, exact in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, p, *rest in reader.find((key, page), (key, page if exact else (1 << 63) - 1)):
                    found.append([k, None if p == _NO_PAGE else p, *rest])
                if len(found) >= 5000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)
                    found = []
            if found:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    rows = wanted.select("key", F.coalesce("page_id", F.lit(_NO_PAGE)).alias("page"), F.col("page_id").isNotNull().alias("exact")).distinct()
    return (
        rows.repartitionByRange(partitions(wanted.sparkSession), "key", "page")
        .sortWithinPartitions("key", "page")
        .mapInArrow(run, "key string, page_id long, record_type string, digest string, file string, offset long, size long")
    )


def read_records(archive: Archive, captures: DataFrame, with_html: bool = True) -> DataFrame:
    """Range reads of the records at (file, offset, size).

    Returns ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, stated_digest``
    and ``html`` if asked for: the digest and size are those of the bytes read, null for a
    revisit, which has none.
    """
    path = archive.path
    fields = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, stated_digest string"
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    if with_html:
        fields, types = fields + ", html string", [*types, pa.string()]
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(path)
        name, file = None, None
        for batch in batches:
            rows: list[list] = []
            held = 0
            for where, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if where != name:
                    if file is not None:
                        file.close()
                    name, file = where, fs.open_input_file(f"{at}/{where}")
                head, payload = parse_record(zlib.decompress(file.read_at(size, offset), 31))
                own = head["warc-type"] == RESPONSE
                page, target = head["x-page-id"], head.get("x-refers-to-page-id")
                row = [
                    int(page) if page else None,
                    head["warc-target-uri"],
                    head["warc-type"],
                    int(target) if target else None,
                    len(payload) if own else None,
                    digest_of(payload) if own else None,
                    head["warc-payload-digest"].removeprefix("sha1:"),
                ]
                rows.append([*row, payload.decode("utf-8", "replace") if own else None] if with_html else row)
                held += len(payload) if with_html else 0
                if held > 1 << 24:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        if file is not None:
            file.close()

    return (
        captures.select("file", "offset", "size")
        .repartitionByRange(partitions(captures.sparkSession), "file", "offset")
        .sortWithinPartitions("file", "offset")
        .mapInArrow(run, fields)
    )


def resolved(records: DataFrame) -> DataFrame:
    """Give revisits the size and digest of the payload they refer to."""
    records = written(records, "records")
    own = records.where(F.col("record_type") == RESPONSE)
    # One row a target, also if rows were repeated with its id.
    full = written(own.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest")).agg(F.max("payload_bytes").alias("target_bytes")), "targets")
    again = records.where(F.col("record_type") == REVISIT).join(full, ["refers_to", "stated_digest"], "left")
    return own.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to").union(
        again.select("page_id", "url", "target_bytes", "stated_digest", "record_type", "refers_to")
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, look every one of them up in the index, and read its record back."""
    archive = write_archives(pages)
    index = build_index(archive)
    wanted = pages.select(url_key(F.col("url")).alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_PAGE)).alias("page_id"))
    return resolved(read_records(archive, lookup(index, wanted), with_html=False))
