"""Alignment of two tokenizers' tokens, and how often pairs of their ids meet in a corpus.

Tokens of both cover the same bytes.  B's tokens are a static interval index: sorted ends that
each token of A stabs by bisection, which lists the B tokens it overlaps.  A gap that no token
of either spans is a border between groups; an A and a B token of one group are linked.

Texts are cut where both tokenizers begin a new token whatever stands around: before a single
space between two visible characters.  The piece behind such a cut is aligned once and
remembered, and all new pieces of some texts are laid end to end on one line of bytes, so the
bisections are two calls.  What is remembered has a bound in characters.

Counts of pairs come from a written table, a row a document with its distinct pairs.  The pairs
that most documents hold are broadcast - ``most_frequent`` at most, by their threshold - and the
rest, none of which is in more documents than that threshold, are joined.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.llm import bpe, store

#: Pairs of ids whose counts are broadcast.
MOST_FREQUENT = 1_000_000
#: Characters of pieces that a Python worker remembers.
CHARS_KEPT = 4_000_000
#: Characters of the texts that are aligned together.
SLICE = 1_000_000
#: Bits of a B id in a pair's number.
B_BITS = 20
CUT = re.compile(r"(?<=\S) (?=\S)")


def overlaps(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the range (first, behind the last) of the B tokens that it overlaps; both sides sorted, neither overlaps itself."""
    return np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and each B token, for two token lists over the same bytes.

    A border lies behind an A token whose last overlapped B token no later A token overlaps.
    """
    a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    first, behind = overlaps(a_starts, a_ends, b_starts, b_ends)
    new = np.concatenate([[False], first[1:] >= behind[:-1]])  # the next stab begins behind what the last one reached
    of_a = np.cumsum(new)
    of_b = np.empty(len(b_ends), np.int64)
    of_b[:] = of_a[np.minimum(np.searchsorted(a_ends, b_starts, "right"), len(a_ends) - 1)]
    return of_a, of_b


@dataclass
class Aligned:
    """What some texts come to: a row of ``numbers`` each, and their distinct pairs one text after the other."""

    numbers: np.ndarray  # tokens of A and of B, groups, links; and whether both tokenizers' bytes are the text's
    texts: list[bytes]  # the groups as decimal ids
    ends: np.ndarray  # of each text's pairs
    pairs: np.ndarray
    links: np.ndarray

    def __add__(self, other: Aligned) -> Aligned:
        joined = (np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("numbers", "pairs", "links"))
        numbers, pairs, links = joined
        return Aligned(numbers, self.texts + other.texts, np.concatenate([self.ends, other.ends + len(self.pairs)]), pairs, links)


def nothing(n: int = 0) -> Aligned:
    return Aligned(np.zeros((n, 5), np.int64), [b""] * n, np.zeros(n, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))


class Aligner:
    """Two vocabularies: A byte-level BPE (JSON), B pieces with byte fallback that add a space in front."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = bpe.byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if set(token) <= alphabet.keys() else token.encode()
        self.bytes_b = [self._bytes_of(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        # every id with the sign behind it: a comma, or what ends its side of a group
        self.signed = [b"%d" % i + sign for n, end in ((len(self.bytes_a), b"|"), (len(self.bytes_b), b";")) for i in range(n) for sign in (b",", end)]
        # a piece with a space behind another character could cross a cut
        self.cut = CUT if not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())) else None
        self.known: dict[str, int] = {}
        self.pieces, self.chars = nothing(), 0

    def _bytes_of(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _covered(self, want: list[bytes], ids_a: list, ids_b: list, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Which texts both tokenizers' tokens give back byte by byte: all at once, and one by one only if not."""
        whole, sizes = b"".join(want), np.fromiter(map(len, want), np.int64, len(want))

        def all_right(of: list[bytes], size: np.ndarray, ids: np.ndarray, n: np.ndarray) -> bool:
            total = np.concatenate([[0], np.cumsum(size[ids])])
            ends = np.cumsum(n)
            return bool((total[ends] - total[ends - n] == sizes).all()) and b"".join(map(of.__getitem__, ids.tolist())) == whole

        if all_right(self.bytes_a, self.size_a, a, n_a) and all_right(self.bytes_b, self.size_b, b, n_b):
            return np.ones(len(want), bool)
        right = (b"".join(map(self.bytes_a.__getitem__, x)) == w == b"".join(map(self.bytes_b.__getitem__, y)) for w, x, y in zip(want, ids_a, ids_b, strict=True))
        return np.fromiter(right, bool, len(want))

    def align(self, texts: list[str]) -> Aligned:
        """Each text with a space before it; none is empty."""
        ids_a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1)
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(texts)) for ids in (ids_a, ids_b))
        fine = self._covered([(" " + t).encode("utf-8", "replace") for t in texts], ids_a, ids_b, a, b, n_a, n_b)
        if not fine.all():  # only what covers its bytes goes on the line
            a, b = a[np.repeat(fine, n_a)], b[np.repeat(fine, n_b)]
            n_a, n_b = n_a * fine, n_b * fine
        if not len(a):
            return nothing(len(texts))
        of_a, of_b = groups(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        in_a, in_b = np.bincount(of_a), np.bincount(of_b)
        owner = np.repeat(np.arange(len(texts)), n_a)[np.cumsum(in_a) - 1]  # of each group
        pairs, links, of_pair = linked(a, b, in_a, in_b, owner)
        each = np.arange(1, len(texts) + 1)
        numbers = np.stack([n_a, n_b, np.bincount(owner, minlength=len(texts)), np.bincount(owner, in_a * in_b, len(texts)).astype(np.int64), fine], axis=1)
        # one text after the other, group by group: A's ids, then B's, each with the sign behind it
        last = np.concatenate([of_a[1:] != of_a[:-1], [True], of_b[1:] != of_b[:-1], [True]])
        code = np.concatenate([a, len(self.size_a) + b]) * 2 + last
        code = code[np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")].tolist()
        stops = np.cumsum(n_a + n_b).tolist()
        sign = self.signed.__getitem__
        of_text = [b"".join(map(sign, code[i:j]))[:-1] for i, j in pairwise([0, *stops])]
        return Aligned(numbers, of_text, np.searchsorted(of_pair, each), pairs, links)

    def learn(self, pieces: set[str]) -> None:
        """Align pieces not met before and remember them."""
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        if self.chars + sum(map(len, new)) > CHARS_KEPT:  # all that these texts ask for is learnt anew
            self.known, self.pieces, self.chars = {}, nothing(), 0
            new = list(pieces)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.pieces += self.align(new)
        self.chars += sum(map(len, new))

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its numbers and groups' text; and all distinct pairs: ``pairs, links, owner``."""
        split = [(self.cut.split(t) if self.cut else [t]) if t else [] for t in texts]
        self.learn(set().union(*split))
        n = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        owner = np.repeat(np.arange(len(texts)), n)
        fine = np.bincount(owner, self.pieces.numbers[ids, 4] == 0, len(texts)) == 0
        ids, owner = ids[fine[owner]], owner[fine[owner]]
        n = n * fine
        numbers = np.stack([np.bincount(owner, self.pieces.numbers[ids, c], len(texts)) for c in range(4)], axis=1).astype(np.int64)
        ends, names = np.cumsum(n).tolist(), ids.tolist()
        text = self.pieces.texts.__getitem__
        written = [b";".join(map(text, names[i:j])) for i, j in pairwise([0, *ends])]
        # each document's distinct pieces with their numbers, then the pairs of these
        piece, times, owner = summed(ids, np.ones(len(ids), np.int64), owner)
        stop = self.pieces.ends[piece]
        size = stop - np.where(piece > 0, self.pieces.ends[piece - 1], 0)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - stop, size)
        return numbers, written, *summed(self.pieces.pairs[at], self.pieces.links[at] * np.repeat(times, size), np.repeat(owner, size))


def summed(pair: np.ndarray, links: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each distinct (owner, pair), in that order: ``pair, links, owner``."""
    if not len(pair):
        return pair, links, owner
    order = np.lexsort((pair, owner)) if (pair.max() + 1) * float(owner.max() + 1) >= 2**63 else np.argsort(owner * (pair.max() + 1) + pair, kind="stable")
    pair, links, owner = pair[order], links[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])]))
    return pair[first], np.add.reduceat(links, first), owner[first]


def linked(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, owner: np.ndarray, most: int = 5_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ids of each owner (of groups) with their numbers of links.

    A group of n and m tokens has at most n * m pairs; ids that repeat in it are counted first,
    so a run of one character in a million places is one pair, and long lists of groups are
    taken in parts of about ``most`` links.
    """
    group_a, group_b = (np.repeat(np.arange(len(x)), x) for x in (in_a, in_b))
    ids_a, times_a, group_a = summed(a, np.ones(len(a), np.int64), group_a)
    ids_b, times_b, group_b = summed(b, np.ones(len(b), np.int64), group_b)
    n_a, n_b = (np.bincount(g, minlength=len(in_a)) for g in (group_a, group_b))
    start_b = np.cumsum(n_b) - n_b
    cost = np.cumsum(n_b[group_a])
    found = [np.empty((3, 0), np.int64)]
    at = 0
    while at < len(ids_a):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + most, "right")))
        g, reps = group_a[at:to], n_b[group_a[at:to]]
        which = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(start_b[g], reps)
        pair = np.repeat(ids_a[at:to], reps) << B_BITS | ids_b[which]
        found.append(np.stack(summed(pair, np.repeat(times_a[at:to], reps) * times_b[which], np.repeat(owner[g], reps))))
        at = to
    return summed(*np.concatenate(found, axis=1)) if len(found) > 2 else tuple(found[-1])


@lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker and pair of vocabularies."""
    return Aligner(path_a, path_b)


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """A row for each row: numbers of tokens, groups and links, the groups' digest, and the distinct pairs of ids with their links.

    ``row`` tells repeated and null ids apart once the result is written.  Texts that are null or
    empty, or that a tokenizer doesn't cover byte by byte, have zeros, no pairs and the digest ''.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool = aligner(path_a, path_b)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for part in bpe._slices(batch.column(1), SLICE):
                numbers, written, pair, links, owner = tool.documents(part)
                ends = pa.array(np.searchsorted(owner, np.arange(len(part) + 1)), pa.int32())
                yield pa.record_batch(
                    [
                        pa.array(np.arange(row, row + len(part))),
                        batch.column(0).slice(at, len(part)),
                        *(pa.array(x) for x in numbers.T.copy()),
                        pa.array([sha256(x).hexdigest() if x else "" for x in written]),
                        pa.ListArray.from_arrays(ends, pa.array(pair)),
                        pa.ListArray.from_arrays(ends, pa.array(links)),
                    ],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"],
                )
                at += len(part)
                row += len(part)
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(column).cast("string")).mapInArrow(run, ALIGNED)


def pair_counts(table: DataFrame) -> DataFrame:
    """``pair, n, best``: documents that hold the pair linked, and whether none of its A id's pairs is in more."""
    counts = store.written(table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    best = counts.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("n").alias("most"))
    # at most a row for each id of A's vocabulary
    found = counts.withColumn("a", F.shiftright("pair", B_BITS)).join(F.broadcast(best), "a")
    return found.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(table: DataFrame, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """A written ``aligned`` table with ``n_best`` and ``count_sum`` instead of its pairs.

    If the corpus has N pairs in documents, fewer than ``most_frequent`` + 1 of them are in
    N / most_frequent documents or more: those are broadcast.
    """
    counts = store.written(pair_counts(table), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = -(-total // most_frequent)
    often, seldom = F.broadcast(counts.where(F.col("n") >= least)), counts.where(F.col("n") < least)
    held = table.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    sums = (F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    by_row = held.join(often, "pair").groupBy("row").agg(*sums)
    if least > 1:  # else every pair is among the broadcast ones
        rest = held.join(often, "pair", "left_anti").join(seldom, "pair").groupBy("row").agg(*sums)
        by_row = by_row.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return table.drop("pairs", "links").join(by_row, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def align(docs: DataFrame, path_a: str, path_b: str, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``docs`` (``doc_id, text``).

    Repeated rows, and rows without id, are documents of their own; an empty table gives no
    rows; other columns are ignored.
    """
    return scored(store.written(aligned(docs, path_a, path_b), "aligned"), most_frequent)
