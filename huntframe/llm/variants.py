"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers (modulo a prime), so words of the same
letters have the same key, and one letter more, less or exchanged changes the key by one
letter's value or the difference of two.  Words meet under the key without one of their
letters: two words that share it there can differ by an exchange, and a word whose whole key it
is lacks that letter.  Keys that meet no other are dropped first, letters uncompared.

What is left is verified for the order of its letters: a row for each letter of a word has the
polynomial hashes of the word without it, so words are compared by an equi-join on key, place
and order.  A group of that join has at most one word for each letter that can stand in the
place, however many anagrams share the key, and no pairs are made: the group's count, best and
second-best word say all that each of its words needs.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huntframe.llm import bpe, store
from huntframe.operators.windows import ranked

#: Words need so many letters and occurrences; a form has so many times the word's.
LEAST_LETTERS, LEAST_N, TIMES = 6, 5, 5
#: One in so many different words of a document loses a letter (its hash says which).
TYPO_EVERY = 199
#: Different words that a task counts before it passes them on.
COUNTED = 200_000
#: Tables grow with the vocabulary: joined by sorting, none is sent through the driver, however small its compressed files look.
BY_MERGE = "merge"
PRIME = (1 << 31) - 1
#: Bases of the polynomial hashes.
BASES = (911_382_323, 972_663_749, 1_315_423_911, 1_803_455_867)
LETTERS = bytes([*range(0x61, 0x7B), *range(0xC0, 0x100)])  # of words in Latin-1, A to Z in lower case
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in LETTERS else 32 for c in range(256))
_VALUE = np.array([pow(c, 5, PRIME) for c in range(256)], np.int64)


def words_of(doc_id: int | None, text: str) -> Counter[bytes]:
    """The words of a text in Latin-1, with typos put in: of a run whose hash with the document's id is divisible by ``TYPO_EVERY``."""
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    out: Counter[bytes] = Counter()
    for word, n in Counter(text.encode("latin-1", "replace").translate(_TABLE).split()).items():
        if len(word) >= LEAST_LETTERS:
            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
            if h % TYPO_EVERY == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= LEAST_LETTERS:
                out[word] += n
    return out


def vocabulary(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``word, n``: every word with at least ``LEAST_N`` occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in found], pa.string())
            out = pa.record_batch([words, pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            at = 0
            for part in bpe._slices(batch.column(1)):
                for doc_id, text in zip(batch.column(0).slice(at, len(part)).to_pylist(), part, strict=True):
                    found.update(words_of(doc_id, text))
                at += len(part)
                if len(found) > COUNTED:
                    yield counted()
        yield counted()

    pieces = docs.select(F.col(key).cast("long"), F.col(column).cast("string")).mapInArrow(run, "word string, n long")
    return pieces.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


def places(words: list[bytes]) -> dict[str, np.ndarray]:
    """A row for each word without the letter at each place, and one for each whole word.

    ``which`` word, ``key`` and ``h1, h2`` (order) of what is left, ``place`` (-1: whole), ``whole``
    the word's own key, ``first`` whether the letter before is another (else the same is left).
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer(b"".join(words), np.uint8)
    starts, which = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[which]

    def summed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of each word, and of its letters before each place."""
        total = np.concatenate([[0], np.cumsum(x)])
        return total[starts + sizes] - total[starts], total[:-1] - total[starts][which]

    key = summed(_VALUE[codes])[0]
    cut, whole = [], []
    for base in BASES:
        powers = np.empty(int(sizes.max(initial=0)) + 1, np.int64)
        powers[0] = 1
        for j in range(1, len(powers)):
            powers[j] = powers[j - 1] * base % PRIME
        term = codes.astype(np.int64) * powers[place] % PRIME
        all_of, before = summed(term)
        behind = (all_of[which] - before - term) % PRIME
        cut.append((before + behind * pow(base, -1, PRIME)) % PRIME)
        whole.append(all_of % PRIME)
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)
    n = len(words)
    return {
        "which": np.concatenate([which, np.arange(n)]),
        "key": np.concatenate([key[which] - _VALUE[codes], key]),
        "whole": np.concatenate([key[which], key]),
        "h1": np.concatenate([cut[0] << 31 | cut[1], whole[0] << 31 | whole[1]]),
        "h2": np.concatenate([cut[2] << 31 | cut[3], whole[2] << 31 | whole[3]]),
        "place": np.concatenate([place, np.full(n, -1)]),
        "first": np.concatenate([first, np.ones(n, bool)]),
    }


def _slices(words: pa.Array, most: int = 100_000) -> Iterator[tuple[int, list[bytes]]]:
    part: list[bytes] = []
    size = at = 0
    for w in words:
        part.append(w.as_py().encode("latin-1"))
        size += len(part[-1])
        if size >= most:
            yield at, part
            at, part, size = at + len(part), [], 0
    if part:
        yield at, part


def placed(words: DataFrame) -> DataFrame:
    """``places`` of a table of ``word, rank``: ``rank, key, whole, h1, h2, place, first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "whole", "h1", "h2", "place", "first"]
        for batch in batches:
            ranks = batch.column(1).to_numpy()
            for at, part in _slices(batch.column(0)):
                rows = places(part)
                yield pa.record_batch([pa.array(ranks[at + rows["which"]]), *(pa.array(rows[c]) for c in names)], ["rank", *names])

    return words.select("word", "rank").mapInArrow(run, "rank long, key long, whole long, h1 long, h2 long, place long, first boolean")


def near(words: DataFrame) -> DataFrame:
    """``rank, n_near, best``: how many words are near each of ``word, rank``, and the smallest rank among them; words with none are left out."""
    rows = placed(words)
    cut = F.col("place") >= 0
    meeting = rows.where(F.col("first")).groupBy("key").agg(
        F.min(F.when(cut, F.col("whole"))).alias("least"), F.max(F.when(cut, F.col("whole"))).alias("most"), F.max(~cut).alias("is_key")
    )
    meeting = meeting.where((F.col("least") != F.col("most")) | F.col("is_key") & F.col("least").isNotNull())
    exchange, other = F.col("least") != F.col("most"), F.col("is_key")
    # in an exchange the place is the same; a word without a letter meets the whole word, whatever the place
    uses = F.filter(
        F.array(F.when(cut & exchange, F.col("place")), F.when(other & F.col("first"), F.lit(-1))), lambda p: p.isNotNull()
    )
    kept = rows.join(meeting.hint(BY_MERGE), "key").select("key", "h1", "h2", F.explode(uses).alias("at"), "rank", (~cut).alias("is_whole"))
    group = Window.partitionBy("key", "h1", "h2", "at").orderBy("rank")
    all_of = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = kept.withColumns(
        {
            "n": F.count(F.when(~F.col("is_whole"), 1)).over(all_of),
            "best": F.min(F.when(~F.col("is_whole"), F.col("rank"))).over(all_of),
            "following": F.lead("rank").over(group),
            "word": F.min(F.when(F.col("is_whole"), F.col("rank"))).over(all_of),
        }
    )
    exchanged = F.col("at") >= 0
    count = F.when(exchanged, F.col("n") - 1).when(F.col("is_whole"), F.col("n")).otherwise(F.col("word").isNotNull().cast("long"))
    best = (
        F.when(exchanged, F.when(F.col("rank") == F.col("best"), F.col("following")).otherwise(F.col("best")))
        .when(F.col("is_whole"), F.col("best"))
        .otherwise(F.col("word"))
    )
    found = seen.select("rank", count.alias("n"), best.alias("best")).where(F.col("n") > 0)
    return found.groupBy("rank").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame, steps: int) -> DataFrame:
    """``rank, root`` of ``rank, form``: where following forms ends, after at most ``steps`` steps.  Each round doubles what has been followed."""
    links = store.written(links.select("rank", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        further = links.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        before, links = links, store.written(links.join(further.hint(BY_MERGE), "root", "left").select("rank", F.coalesce("further", "root").alias("root")), "roots")
        store.drop(links.sparkSession, before)
    return links


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word of ``docs`` (``doc_id, text``), the word that it is taken for a variant of, and where that leads.

    Null texts have no words; a null id counts as an empty one where typos are put in; repeated
    rows count each time; an empty table gives no rows; other columns are ignored.  Of near words
    that are as frequent, the one whose code points come first is the form.
    """
    counted = ranked(vocabulary(docs).select("word", "n", (-F.col("n")).alias("minus_n")), ["minus_n", "word"], "rank")
    words = store.written(counted.select("word", "n", "rank"), "words")
    other = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = words.join(near(words).hint(BY_MERGE), "rank", "left").join(other.hint(BY_MERGE), "best", "left")
    taken = F.col("form_n") >= TIMES * F.col("n")
    table = store.written(found.select("word", "n", "rank", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(taken, F.col(c)).alias(c) for c in ("best", "form", "form_n"))), "near")
    # each step multiplies the occurrences by TIMES at least
    most = table.agg(F.max("n")).first()[0] or LEAST_N
    ends = roots(table.where(F.col("best").isNotNull()).select("rank", F.col("best").alias("form")), int(math.log(most / LEAST_N, TIMES)) + 1)
    last = words.select(F.col("rank").alias("root"), F.col("word").alias("last"))
    ends = ends.hint(BY_MERGE).join(last.hint(BY_MERGE), "root").select("rank", "last")
    out = table.join(ends.hint(BY_MERGE), "rank", "left")
    return out.select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
