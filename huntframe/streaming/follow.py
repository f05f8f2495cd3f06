"""Growing and rotated text files as a stream: ``spark.readStream.format("follow").option("path", folder)``.

The offset of a stream is how far each file has been read.  A file is known by the digest of its
first line, not by its name, so one that was renamed is read on where it was, and a new file
under the old name from its start.  The driver only looks at names, sizes and first and last
lines; executors read the bytes, in ranges, each the lines that begin in it.  A line counts
once it is ended, so a half-written one waits for its rest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha1

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from huntframe.sources.store import file_system

RANGE_BYTES = 64 << 20
STEP = 1 << 16


@dataclass
class Span(InputPartition):
    """The lines of a file that begin in [start, end)."""

    path: str
    name: str
    start: int
    end: int


class Follow(DataSource):
    """Options: ``path`` (a folder), ``contains`` (what names of files must hold; default any), ``rangeBytes`` (bytes a task reads).

    Files whose first lines are the same count as one, the longest; a file that is gone before it was read is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "follow"

    def schema(self) -> str:
        return "src_file string, at long, value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Reader(self.options["path"], self.options.get("contains", ""), int(self.options.get("rangeBytes", RANGE_BYTES)))


class Reader(DataSourceStreamReader):
    def __init__(self, path: str, contains: str, size: int):
        self.path, self.contains, self.size = path, contains, size

    def _files(self) -> dict[str, tuple[str, int]]:
        """Path and end of the last whole line of each file, by the digest of its first line; of equal ones the longest."""
        fs, top = file_system(self.path)
        out: dict[str, tuple[str, int]] = {}
        for info in sorted(fs.get_file_info(pafs.FileSelector(top, recursive=True)), key=lambda i: i.path):
            if info.type != pafs.FileType.File or not info.size or self.contains not in info.base_name:
                continue
            with fs.open_input_file(info.path) as f:
                end, first = _last_end(f, info.size), _first_line(f, info.size)
            if end and first is not None and (first not in out or out[first][1] < end):
                out[first] = (info.path, end)
        return out

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {first: end for first, (_, end) in self._files().items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        files = self._files()
        out = []
        for first, to in sorted(end.items()):
            at = start.get(first, 0)
            if to <= at:
                continue
            if first not in files:
                raise ValueError(f"a file that the stream has yet to read is gone (its first line's digest: {first})")
            path = files[first][0]
            out += [Span(path, first, a, min(a + self.size, to)) for a in range(at, to, self.size)]
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.path) as f:
            yield from ((partition.path, at, line) for at, line in lines(f, partition.start, partition.end))

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _first_line(f: object, size: int) -> str | None:
    """Digest of the first line; None while it isn't ended."""
    data = b""
    while len(data) < size:
        part = f.read_at(STEP, len(data))
        data += part
        if b"\n" in part:
            return sha1(data[: data.index(b"\n")], usedforsecurity=False).hexdigest()
    return None


def _last_end(f: object, size: int) -> int:
    """Where the last whole line ends."""
    at = size
    while at > 0:
        low = max(0, at - STEP)
        found = f.read_at(at - low, low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def lines(f: object, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(place, line) of the lines that begin in [start, end); the last one may be read beyond it."""
    at, held = start, b""
    if start and f.read_at(1, start - 1) != b"\n":  # inside a line of the range before
        while True:
            part = f.read_at(STEP, at)
            if not part:
                return
            found = part.find(b"\n")
            at += len(part) if found < 0 else found + 1
            if found >= 0:
                break
    begin = at
    while begin < end:
        part = f.read_at(STEP, at)
        if not part:
            return
        at += len(part)
        *whole, held = (held + part).split(b"\n")
        for line in whole:
            if begin >= end:
                return
            yield begin, line.removesuffix(b"\r").decode("utf-8", "replace")
            begin += len(line) + 1
