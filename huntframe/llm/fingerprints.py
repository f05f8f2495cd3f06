"""Document fingerprints from prefix polynomial hashes.

For a text c_0 c_1 ... the array h[i] = sum of (c_j + 1) B^j over j < i, modulo a prime, is
kept for two primes.  It gives the hash of any span in constant time, so two spans are
compared without reading them, and the longest common extension from any two places is found
by binary search.

A fingerprint is what is kept of the arrays: the length, the hash of the whole text, and the
hashes of the prefixes and suffixes of s, 2s, 3s, ... characters, where s is the smallest power
of two that needs at most ``STEPS`` of them.  Strides of different texts divide each other, so
two fingerprints have common checkpoints, and binary search over these finds how far the texts
agree from the front and from the back.

Text that moved, or that stands between two changes, agrees at no checkpoint.  So the arrays are
also asked for the hash of every span of ``SPAN`` characters; the spans fall into ``BINS`` bins
by their hash, and a byte of each bin's smallest is kept.  The share of bins that agree is about
the share of spans that two texts have in common.  The likeness of two fingerprints is the larger
of the two shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huntframe.llm.store import partitions, written

PRIMES, BASES = (2147483647, 2147483629), (1000003791, 1389796177)
STEPS = 32
#: Characters of a span, and bins of the sketch of all spans.
SPAN, BINS = 16, 64
_CHUNK = 1 << 16


def _powers(base: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < _CHUNK:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out


_POWERS = [_powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]
_INVERSE = [pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True)]
_BACK = _powers(_INVERSE[1], PRIMES[1])


_NONE = np.uint64((1 << 64) - 1)


class Prefixes:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.h = []
        for base, prime, powers in zip(BASES, PRIMES, _POWERS, strict=True):
            h = np.zeros(self.n + 1, np.uint64)
            p = np.uint64(prime)
            for at in range(0, self.n, _CHUNK):
                part = codes[at : at + _CHUNK]
                terms = part * powers[: len(part)] % p
                if at:
                    terms = terms * np.uint64(pow(base, at, prime)) % p
                h[at + 1 : at + 1 + len(part)] = (np.cumsum(terms) + h[at]) % p
            self.h.append(h)

    @classmethod
    def joined(cls, a: Prefixes, i: int, b: Prefixes, k: int) -> Prefixes:
        """The arrays of a's first i characters followed by b's first k, without reading either text."""
        self = cls.__new__(cls)
        self.n = i + k
        self.h = []
        for base, prime, x, y in zip(BASES, PRIMES, a.h, b.h, strict=True):
            p = np.uint64(prime)
            self.h.append(np.concatenate([x[: i + 1], (x[i] + y[1 : k + 1] * np.uint64(pow(base, i, prime)) % p) % p]))
        return self

    def span(self, i: int, j: int, which: int = 0) -> int:
        """The hash of characters i to j - 1, the same wherever they stand."""
        p = PRIMES[which]
        return (int(self.h[which][j]) - int(self.h[which][i])) * pow(_INVERSE[which], i, p) % p

    def equal(self, i: int, other: Prefixes, k: int, size: int) -> bool:
        """Whether ``size`` characters from i here and from k there are the same."""
        if i == k:  # equally far from the start: the powers are the same
            pairs = zip(self.h, other.h, PRIMES, strict=True)
            return all((int(x[i + size]) - int(x[i]) - int(y[i + size]) + int(y[i])) % p == 0 for x, y, p in pairs)
        return all(self.span(i, i + size, w) == other.span(k, k + size, w) for w in (0, 1))

    def extension(self, i: int, other: Prefixes, k: int) -> int:
        """The longest common extension forward from i here and k there."""
        low, high = 0, min(self.n - i, other.n - k)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, k, mid) else (low, mid - 1)
        return low

    def spans(self, size: int = SPAN) -> Iterator[np.ndarray]:
        """The hashes of all spans of ``size`` characters (of the whole text if it is shorter), a chunk at a time."""
        p, h = np.uint64(PRIMES[1]), self.h[1]
        size = min(size, self.n)
        for at in range(0, self.n - size + 1 if size else 0, _CHUNK):
            part = (h[at + size : at + size + _CHUNK] + p - h[at : at + _CHUNK][: self.n - size + 1 - at]) % p
            part = part * _BACK[: len(part)] % p
            yield part * np.uint64(pow(_INVERSE[1], at, PRIMES[1])) % p if at else part

    def sketch(self) -> bytes:
        """A byte from 1 to 255 for the smallest span of each bin, 0 for an empty bin."""
        least = np.full(BINS, _NONE)
        for part in self.spans():
            mixed = part * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            np.minimum.at(least, (mixed & np.uint64(BINS - 1)).astype(np.intp), mixed >> np.uint64(6))
        return np.where(least == _NONE, 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()

    @cached_property
    def fingerprint(self) -> str:
        """length . whole hash . prefix checkpoints . suffix checkpoints . sketch of the spans, in hexadecimal."""
        step, p = stride(self.n), PRIMES[0]
        steps = self.n // step
        front = self.h[0][step :: step].tolist()
        whole, starts = int(self.h[0][-1]), self.h[0][self.n - steps * step : self.n : step].tolist()
        # Suffixes from the longest on: the power that moves each to the front is a step more than the one before.
        power, more, back = pow(_INVERSE[0], self.n - steps * step, p), pow(_INVERSE[0], step, p), []
        for h in starts:
            back.append((whole - h) * power % p)
            power = power * more % p
        front, back = ("".join(f"{h:08x}" for h in x) for x in (front, reversed(back)))
        return f"{self.n:x}.{int(self.h[0][-1]):08x}{int(self.h[1][-1]):08x}.{front}.{back}.{self.sketch().hex()}"


def stride(n: int) -> int:
    s = 1
    while n > STEPS * s:
        s *= 2
    return s


def likeness(a: str, b: str) -> float:
    """From two fingerprints, the share of the longer text that agrees from the front and the back, or
    that of the spans that both have, if it is larger."""
    if a == b:
        return 1.0
    (na, _, *xs, us), (nb, _, *ys, vs) = a.split("."), b.split(".")
    na, nb = int(na, 16), int(nb, 16)
    if not na or not nb:
        return 0.0
    u, v = bytes.fromhex(us), bytes.fromhex(vs)
    full = sum(i > 0 or j > 0 for i, j in zip(u, v, strict=True))
    # Of bins that differ one in 255 agrees by chance.
    moved = max(0.0, (sum(i == j > 0 for i, j in zip(u, v, strict=True)) / full - 1 / 255) / (1 - 1 / 255))
    step = max(stride(na), stride(nb))
    same = 0
    for x, y in zip(xs, ys, strict=True):
        ja, jb = step // stride(na), step // stride(nb)
        low, high = 0, min(na, nb) // step
        while low < high:  # agreement up to a checkpoint is agreement up to all before it
            mid = (low + high + 1) // 2
            u, v = 8 * (mid * ja - 1), 8 * (mid * jb - 1)
            low, high = (mid, high) if x[u : u + 8] == y[v : v + 8] else (low, mid - 1)
        same += low * step
    return max(min(same, min(na, nb)) / max(na, nb), moved)


#: Equal rows beyond this number are walked as one.
REPEATED = 1000
#: Counters of ids and texts, rows a task makes of one at a time, and rows that are broadcast at most.
BUCKETS, CHUNK, BROADCAST_ROWS = 1 << 20, 10_000, 100_000
FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, front_edited long, front_next long"
_NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]


def compare(text: str, here: Prefixes, after: str, there: Prefixes) -> tuple:
    """The row of a text and the text after it, but for its id."""
    k = here.n // 2
    size = min(k, there.n)
    edited = Prefixes.joined(here, here.n - k, there, size)
    words = text[: here.n - k] + after[:size]
    own, other, changed = here.fingerprint, there.fingerprint, edited.fingerprint
    digest = sha256(words.encode("utf-8", "surrogatepass")).hexdigest()
    return here.n, digest, own, changed, likeness(own, changed), likeness(own, other), here.extension(0, edited, 0), here.extension(0, there, 0)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: each is compared with the next.  kind 0: done; 1 and 2: the first and last text of partition ``part``.

    A row of ``n`` equal documents is compared with itself once, for ``times`` = n - 1 of them.
    """
    schema = pa.schema([*[pa.field(n, t) for n, t in zip(_NAMES, _TYPES, strict=True)], ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string()), ("times", pa.int64())])
    last, part, blank = None, TaskContext.get().partitionId(), [None] * (len(_NAMES) - 1)
    rows: list[tuple] = []
    for batch in batches:
        for doc_id, text, n in zip(*batch.columns, strict=True):  # one text at a time as a Python string
            doc_id, text, n = doc_id.as_py(), text.as_py(), n.as_py()
            arrays = Prefixes(text)
            if last is None:
                rows.append((doc_id, *blank, 1, part, text, 1))
            else:
                rows.append((last[0], *compare(last[1], last[2], text, arrays), 0, part, None, 1))
            if n > 1:
                rows.append((doc_id, *compare(text, arrays, text, arrays), 0, part, None, n - 1))
            last = (doc_id, text, arrays)
            if len(rows) >= 500:
                yield _batch(rows, schema)
                rows = []
    if last is not None:
        rows.append((last[0], *blank, 2, part, last[1], 1))
    if rows:
        yield _batch(rows, schema)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(list(zip(_NAMES, _TYPES, strict=True)))
    for batch in batches:
        rows = [(i, *compare(t, Prefixes(t), u, Prefixes(u))) for i, t, u in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            yield _batch(rows, schema)


def with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint and its likeness to its edited text and to the next document.

    Next is the next smaller ``doc_id`` (of equal ids, by a hash of the text, then by text; null ids
    come last), after the last the first; a single document is its own next.  Null texts are
    empty, and two empty texts are alike (1.0); an empty one and another are not (0.0).  The
    edited text has the last half of its characters (rounded down) replaced by as many of the
    next document's, or all it has.  ``front_edited`` and ``front_next`` are the characters from
    the start that are the same, found by binary search.  Other columns are ignored.

    One shuffle of the texts sorts them into ranges; each task walks its range with the text
    before in hand.  The first and last text of every range, two rows a partition, meet by the
    number of the partition; only those numbers are sorted in one task.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("text").desc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("doc_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    same = _repeated(rows)
    counted = rows.withColumn("n", F.lit(1).cast("long"))
    if same is not None:
        once = rows.join(same, ["doc_key", "h"], "left_semi").groupBy("doc_key", "doc_id", "h", "text").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.join(same, ["doc_key", "h"], "left_anti").unionByName(once)
    walked = written(
        counted.repartitionByRange(partitions(spark), *order[:2])
        .sortWithinPartitions(*order)
        .select("doc_id", "text", "n")
        .mapInArrow(_walk, f"{FIELDS}, kind int, part int, text string, times long"),
        "fingerprints",
    )
    lasts, firsts = (walked.where(F.col("kind") == k).select("doc_id", "part", "text") for k in (2, 1))
    line = Window.orderBy("part")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = lasts.select("part", F.coalesce(F.lead("part").over(line), F.first("part").over(whole)).alias("next"))
    after = firsts.select(F.col("part").alias("next"), F.col("text").alias("after"))
    pairs = lasts.join(follows, "part").join(after, "next").select("doc_id", "text", "after")
    done = walked.where("kind = 0")
    if same is not None:
        done = done.where("times = 1").unionByName(_spread(done.where("times > 1"), partitions(spark)))
    return done.select(*_NAMES).union(pairs.mapInArrow(_ends, FIELDS))


def _repeated(rows: DataFrame) -> DataFrame | None:
    """(doc_key, h) of documents that are repeated more than ``REPEATED`` times with id and text; None if there are none.

    Counts by a few bits of the hash come first, so that where nothing is repeated only these are shuffled.
    """
    bucket = F.pmod(F.xxhash64("doc_key", "h"), F.lit(BUCKETS))
    buckets = written(rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "id-buckets")
    mean = (buckets.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    full = buckets.where(F.col("n") > REPEATED + 2 * mean).select("bucket")
    if full.isEmpty():
        return None
    suspect = rows.withColumn("bucket", bucket).join(F.broadcast(full), "bucket")
    same = written(suspect.groupBy("doc_key", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REPEATED).select("doc_key", "h"), "same-rows")
    n = same.count()
    return None if not n else F.broadcast(same) if n <= BROADCAST_ROWS else same.hint("merge")


def _spread(copies: DataFrame, n_tasks: int) -> DataFrame:
    """Each row ``times`` times, made by all tasks."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / CHUNK).cast("long")))
    dealt = copies.withColumn("chunk", chunk).repartition(n_tasks)
    return dealt.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col("times") - F.col("chunk") * CHUNK)))).drop("chunk", "nth")
