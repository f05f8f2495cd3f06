"""Language-model scores by stupid backoff, as count tables joined to the documents' n-grams.

A word's score is count(n-gram) / count(its first n - 1 words) for the longest n-gram that
ends at it and occurs elsewhere, times ``ALPHA`` for each word by which the context was cut;
a word that occurs nowhere else scores as one of the corpus's words at random, once more
discounted.  When a corpus is scored by itself, a document's own n-grams are taken off the
counts (leave one out): else whatever is unique would be certain.

Rows would be several times the size of the text if each n-gram of each document were one, so
they travel packed:

1. Documents are gathered into blocks of ``BLOCK_CHARS`` characters.  A block explodes its
   n-grams of all orders, hashes them to ``BITS`` bits, sums equal ones, and sends each range
   of hashes to that range's partition of the count tables.
2. A partition of the count tables adds up the counts of its hashes over all blocks and joins
   them to each block's hashes: it answers every block with the totals, in the block's order.
3. Blocks meet their answers, own counts are taken off, and scores are summed per document.

The number of hash ranges follows the corpus, so each stays at some ``RANGE_WORDS`` words; a
frequent n-gram is one entry a block, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.llm.store import letting_go, write

ORDER, ALPHA = 3, 0.4
BLOCK_CHARS, RANGE_WORDS = 10_000_000, 400_000
#: Of g distinct n-grams of one order a share of g / 2^54 meets another with its hash.
BITS = 54
BLOCK = "block long, words long, ids array<long>, sizes array<int>, texts binary, asks boolean"


def _blocks(asks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        sizes: list[int] = []
        texts: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            data = zstandard.compress(b"\n".join(texts), 6)
            values = [uuid4().int >> 65, sum(sizes), list(ids), list(sizes), data, asks]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.bool_()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [f.split(" ")[0] for f in BLOCK.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "replace").lower().split()
                ids.append(doc_id.as_py())
                sizes.append(len(words))
                texts.append(b" ".join(words))
                held += len(texts[-1])
                if held >= BLOCK_CHARS:
                    yield row()
                    ids, sizes, texts, held = [], [], [], 0
        if ids:
            yield row()

    return run


def blocks(docs: DataFrame, asks: bool = True) -> DataFrame:
    """Documents as rows of ``BLOCK``: their words, lower-cased in ASCII, between single spaces."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_blocks(asks), BLOCK)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash pairs of hashes; the order of the two counts."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def exploded(data: bytes, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order n: (positions at which an n-gram ends, its key), positions counted through the block.

    A key is the hash with the order above it, so the keys of an order stand together.
    """
    n = int(sizes.sum())
    if not n:
        yield from ((np.zeros(0, np.int64), np.zeros(0, np.uint64)) for _ in range(order))
        return
    whole = pa.array([zstandard.decompress(data).replace(b"\n", b" ").strip().decode("utf-8")], pa.large_string())
    words = pc.split_pattern(whole, " ").values
    words = words.filter(pc.not_equal(words, "")).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    h = hashes[words.indices.to_numpy()]
    del whole, words, hashes
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = h
    for k in range(order):
        if k:
            ends = np.concatenate([np.zeros(1, np.uint64), _mix(ends[:-1], h[1:])])
        at = np.flatnonzero(place >= k)
        yield at, (ends[at] >> np.uint64(64 - BITS)) | np.uint64(k << BITS)


def width_of(order: int, ranges: int) -> int:
    """Keys in one range."""
    return (order << BITS) // ranges + 1


def packed(keys: np.ndarray, start: int) -> bytes:
    """Ascending distinct numbers from ``start`` on as differences of as many bytes as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(start))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, start: int) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(planes), 8), np.uint8)
    steps[:, :width] = planes
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(start)


def packed_counts(counts: np.ndarray) -> bytes:
    """Their number, a byte for each count under 255, and eight bytes for each of the others."""
    return len(counts).to_bytes(4, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def _entries(data: bytes) -> int:
    return int.from_bytes(data[:4], "little")


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n, offset=4).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=4 + n)
    return out


def _asked(order: int, ranges: int):
    """Blocks to rows (part, block, keys, counts, asks): what each range of hashes gets from a block."""
    width = width_of(order, ranges)
    borders = np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = exploded(row["texts"], np.array(row["sizes"], np.int64), order)
                keys, counts = map(np.concatenate, zip(*(np.unique(h, return_counts=True) for _, h in grams), strict=True))
                if not len(keys):
                    continue
                cuts = np.searchsorted(keys, borders)
                full = np.flatnonzero(np.diff(cuts))
                for some in np.array_split(full, max(1, len(full) // 256)):
                    parts = [(int(p), slice(cuts[p], cuts[p + 1])) for p in some]
                    yield pa.record_batch(
                        [
                            pa.array([p for p, _ in parts], pa.int32()),
                            pa.array([row["block"]] * len(parts), pa.int64()),
                            pa.array([packed(keys[s], p * width) for p, s in parts], pa.binary()),
                            pa.array([packed_counts(counts[s]) for _, s in parts], pa.binary()),
                            pa.array([row["asks"]] * len(parts), pa.bool_()),
                        ],
                        ["part", "block", "keys", "counts", "asks"],
                    )

    return run


def _answered(order: int, ranges: int, own: bool):
    """One range of the count tables: adds the counts up and joins them to each block's keys."""
    width = width_of(order, ranges)

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        lists = [unpacked(k.as_py(), part * width) for k in table["keys"]]
        asks = table["asks"].to_pylist()
        counts = [
            unpacked_counts(c.as_py(), len(k)) if own or not a else np.zeros(len(k), np.int64)
            for c, k, a in zip(table["counts"], lists, asks, strict=True)
        ]
        keys, place = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.bincount(place, np.concatenate(counts), len(keys)).astype(np.int64)[place]
        ends = np.cumsum([len(k) for k in lists])
        found = [(b, packed_counts(totals[e - len(k) : e])) for b, k, e, a in zip(table["block"].to_pylist(), lists, ends, asks, strict=True) if a]
        return pa.table(
            {
                "block": pa.array([b for b, _ in found], pa.int64()),
                "part": pa.array([part] * len(found), pa.int32()),
                "totals": pa.array([t for _, t in found], pa.binary()),
            }
        )

    return run


def backed_off(counts: list[np.ndarray], place: np.ndarray, alpha: float, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position the logarithm of its score and the order that gave it (0: none).

    ``counts[n - 1]`` has the count of the n-gram that ends at each position, 0 where there is
    none; ``place`` is the position in its document; ``words`` is the size of the corpus that
    each position is scored by.
    """
    above = np.maximum(words, 1).astype(np.float64)
    share, order = 1 / above, np.zeros(len(place), np.int64)
    for k, c in enumerate(counts):
        context = above if k == 0 else np.concatenate([np.zeros(1), counts[k - 1][:-1]])
        seen = c > 0
        share[seen] = c[seen] / context[seen]
        order[seen] = k + 1
    return np.log(share) + (np.minimum(place + 1, len(counts)) - order) * np.log(alpha), order


def _counted(at: np.ndarray, starts: np.ndarray, doc: np.ndarray, totals: np.ndarray, own: bool, n: int) -> np.ndarray:
    """Per position the total of its n-gram, less what its own document has of it.

    ``at`` are the positions sorted by n-gram, a document's next to each other; ``starts`` marks
    where another n-gram begins, ``totals`` has one number for each.
    """
    out = np.zeros(n, np.int64)
    if not len(at):
        return out
    found = totals[np.cumsum(starts) - 1]
    if own:
        doc = doc[at]
        runs = np.flatnonzero(starts | np.concatenate([np.ones(1, bool), doc[1:] != doc[:-1]]))
        lengths = np.diff(runs, append=len(at))
        found -= np.repeat(lengths, lengths)
    out[at] = found
    return out


def _scored(order: int, alpha: float, total: int, own: bool):
    ranges = ranges_of(total)
    borders = np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width_of(order, ranges))
    names = ["doc_id", "n_words", "log_score", "by_order"]

    def run(replies: pa.Table, texts: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        answers = dict(zip(replies["part"].to_pylist(), replies["totals"], strict=True))
        for row in texts.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            n = int(sizes.sum())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            counts, left = [], np.zeros(0, np.int64)
            for at, keys in exploded(row["texts"], sizes, order):
                # Stable, so that an n-gram's positions stay in the order of the documents.
                by_key = np.argsort(keys, kind="stable")
                at, keys = at[by_key], keys[by_key]
                starts = np.concatenate([np.ones(1, bool), keys[1:] != keys[:-1]])[: len(keys)]
                totals, left = _totals(keys[starts], borders, answers, left)
                counts.append(_counted(at, starts, doc, totals, own, n))
            logs, by = backed_off(counts, place, alpha, total - (sizes[doc] if own else np.zeros(n, np.int64)))
            sums = np.bincount(doc, logs, len(sizes))
            hits = np.bincount(doc * (order + 1) + by, minlength=len(sizes) * (order + 1)).reshape(-1, order + 1)
            mean = [round(s / m, 6) if m else None for s, m in zip(sums.tolist(), sizes.tolist(), strict=True)]
            columns = [pa.array(row["ids"], pa.int64()), pa.array(sizes), pa.array(mean, pa.float64()), pa.array(hits.tolist(), pa.list_(pa.int64()))]
            out.append(pa.record_batch(columns, names))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
        return pa.Table.from_batches(out, pa.schema(list(zip(names, kinds, strict=True))))

    return run


def _totals(keys: np.ndarray, borders: np.ndarray, answers: dict[int, pa.Scalar], left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The totals of ascending keys from the answers of their ranges.

    A range may hold the last keys of one order and the first of the next: what one order
    leaves of its last range is returned for the next.
    """
    out = [left]
    for p in np.flatnonzero(np.diff(np.searchsorted(keys, borders))).tolist():
        if p in answers:
            data = answers.pop(p).as_py()
            out.append(unpacked_counts(data, _entries(data)))
    found = np.concatenate(out)
    return found[: len(keys)], found[len(keys) :]


def ranges_of(words: int) -> int:
    """Ranges of hashes, and so partitions of the count tables, for a corpus of so many words."""
    return words // RANGE_WORDS + 1


def score(docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, n_words, log_score, by_order``, a row for each row of ``docs``.

    ``log_score`` is the mean natural logarithm of the words' scores, rounded to 6 digits, null
    for a text without words (null and empty texts among them).  ``by_order[k]`` counts the
    words scored by a k-gram, ``by_order[0]`` those that occur nowhere else.  Without
    ``corpus`` the documents score each other, each without its own counts; rows repeated with
    one id are documents of their own.  ``corpus`` needs a ``text`` (and ``doc_id``) column.
    Other columns are ignored; empty tables give an empty result, an empty corpus scores
    every word as unseen.
    """
    spark = docs.sparkSession
    own = corpus is None
    made = blocks(docs)
    path = write(made if own else made.union(blocks(corpus, asks=False)), "lm-blocks")
    made = spark.read.schema(BLOCK).parquet(path)
    total = made.where("asks" if own else "NOT asks").agg(F.sum("words")).first()[0] or 0
    ranges = ranges_of(total)
    # The n-grams' shuffle files are larger than the text: the session of this query deletes them when it is done.
    grams = letting_go(spark).read.schema(BLOCK).parquet(path).select("block", "sizes", "texts", "asks")
    asked = grams.mapInArrow(_asked(order, ranges), "part int, block long, keys binary, counts binary, asks boolean")
    totals = "block long, part int, totals binary"
    answers = spark.read.schema(totals).parquet(write(asked.groupBy("part").applyInArrow(_answered(order, ranges, own), totals), "lm-answers"))
    texts = made.where("asks").select("block", "ids", "sizes", "texts")
    return (
        answers.groupBy("block")
        .cogroup(texts.groupBy("block"))
        .applyInArrow(_scored(order, alpha, total, own), "doc_id long, n_words long, log_score double, by_order array<long>")
    )
