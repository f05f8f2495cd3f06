"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments A (23), B (23) and C (18).  Two fingerprints that
differ in at most two bits have one segment in common, and differ in at most two bits in any
other.  A 23-bit segment is hashed by the perfect binary Golay code: every word is within
three bits of exactly one codeword, and a word that is three away from it has five more
codewords four away.  Words within two bits of each other share one of these codewords, so a
key is (one segment as it is, the index of a codeword near another one):

    (A, near B)   (B, near A)   (C, near A)

about 16 keys of 30 to 35 bits a fingerprint, which lose no link.  Fingerprints that share a
key are joined and verified.  A key with more than ``CROWD`` fingerprints is not joined with
itself: its fingerprints are linked through the words within one bit of them.  Two that share
such a word differ in two bits at most, and two that differ in two bits at most share one, so
a star from each such word's smallest fingerprint gives the same components with 65 rows a
fingerprint, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.llm.components import components
from huntframe.llm.store import written

SHINGLE, SEED, NEAR = 3, 42, 2
#: Up to this many fingerprints with one key are compared with each other.
CROWD = 32
#: The Golay code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value).
GENERATOR = 0b110001110101
_CHUNK = 1 << 15


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text; 0 for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):  # bounded memory for very long texts
        part = words[at : min(n, at + _CHUNK) + size - 1]
        grams = zip(*(part[i:] for i in range(size)), strict=False)
        h = np.array([digest(b" ".join(g), SEED) for g in grams], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.record_batch([batch.column(0), pa.array(prints), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, digest: Column | None = None, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed number) and a text ``digest`` if one is given, one row per row of ``docs``."""
    more = [] if digest is None else [digest.cast("string").alias("digest")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more).mapInArrow(
        partial(_fingerprint_batches, size), "doc_id long, fp long" + ", digest string" * len(more)
    )


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and per syndrome up to 6 error patterns, -1 where fewer."""
    one = []
    for bit in range(23):
        x = 1 << bit
        for shift in range(11, -1, -1):
            if x >> (shift + 11) & 1:
                x ^= GENERATOR << shift
        one.append(x)

    def table(bits: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.int64)
        for i, s in enumerate(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ s
        return out

    near: list[list[int]] = [[] for _ in range(2048)]
    weight = [9] * 2048
    for k in range(5):
        for bits in combinations(range(23), k):
            s = 0
            for b in bits:
                s ^= one[b]
            if not near[s] or (k == 4 and weight[s] == 3):
                weight[s] = min(weight[s], k)
                near[s].append(sum(1 << b for b in bits))
    patterns = np.full((2048, 6), -1, np.int64)
    for s, errors in enumerate(near):
        patterns[s, : len(errors)] = errors
    return table(one[:12]), table(one[12:]), patterns


def near_codewords(words: np.ndarray) -> np.ndarray:
    """For 23-bit words: the indices (12 bits) of their one or six nearest codewords; -1 fills up."""
    low, high, patterns = golay()
    errors = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) pairs."""
    x = prints.view(np.uint64)
    a, b, c = ((x >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((0, 0x7FFFFF), (23, 0x7FFFFF), (46, 0x3FFFF)))
    near_a, near_b = near_codewords(a), near_codewords(b)
    at, keys = [], []
    for role, (exact, near) in enumerate(((a, near_b), (b, near_a), (c, near_a))):
        row, col = np.nonzero(near >= 0)
        at.append(row)
        keys.append((role << 35) | (exact[row] << 12) | near[row, col])
    return np.concatenate(at), np.concatenate(keys)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        at, keys = keys_of(prints)
        yield pa.record_batch([pa.array(keys), pa.array(prints[at])], ["key", "fp"])


def _ball_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.array([0] + [1 << i for i in range(64)], np.uint64)
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096].view(np.uint64)
            points = (part[:, None] ^ flips).view(np.int64).ravel()
            yield pa.record_batch([pa.array(points), pa.array(np.repeat(part.view(np.int64), 65))], ["point", "fp"])


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp``, enough for all components at 2 bits."""
    keys = prints.select("fp").mapInArrow(_key_batches, "key long, fp long")
    keys = written(keys, "simhash-keys")
    # Written, as what a hot key is joined with must be a table for Spark to split the key's rows.
    sizes = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")
    shared = keys.join(sizes, "key")
    few = shared.where(F.col("n") <= CROWD).select("key", "fp")
    other = few.select("key", F.col("fp").alias("v"))
    pairs = few.select("key", F.col("fp").alias("u")).join(
        other, (few["key"] == other["key"]) & (F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= NEAR)
    ).select("u", "v")
    many = shared.where(F.col("n") > CROWD).select("fp").distinct()
    balls = many.mapInArrow(_ball_batches, "point long, fp long")
    lowest = balls.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = balls.join(written(lowest, "simhash-lowest"), "point").where("fp != v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars)


def near_components(docs: DataFrame, digest: Column | None = None, size: int = SHINGLE) -> DataFrame:
    """``near_groups`` with each row's ``digest`` and ``label``, which names its component whatever ids its rows have."""
    prints = written(fingerprints(docs, digest, size), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labels = components(links(distinct))
    # A component and a fingerprint may have a third of all rows: each join is one of two written tables.
    placed = written(
        distinct.join(labels, distinct["fp"] == labels["u"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "simhash-placed"
    )
    smallest = written(placed.groupBy("label").agg(F.min("first").alias("component_id")), "simhash-smallest")
    named = written(placed.join(smallest, "label").select("fp", "label", "component_id"), "simhash-named")
    return prints.join(named, "fp", "left")


def near_groups(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id``: one row per row of ``docs``, whatever its other columns.

    Shingles have ``size`` words.  ``component_id`` is the smallest ``doc_id`` reachable over links of 2 bits or fewer.  Null
    and wordless texts have fingerprint 0, linked like any other; null ids are never the
    smallest, and a component of null ids only has a null ``component_id``.
    """
    return near_components(docs, size=size).select("doc_id", "fp", "component_id")
