"""Byte-level BPE by speculation and verification.

A text is cut into words by the tokenizer's pattern.  For the words not met before, a
longest-match automaton over the vocabulary proposes tokens.  A proposal is right if and only
if every adjacent pair of tokens is compatible, that is, no merge would cross the border
between them; all pairs of a batch are tested together, and their verdicts kept.  Only words
with an incompatible pair are merged rank by rank.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary's word pattern (a fixed value of the file format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered by one Python worker; beyond it, it starts afresh.
WORDS_KEPT = 150_000
NEVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The file's printable stand-in for each byte: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one vocabulary file (JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = {t: bytes(alphabet[c] for c in t) for t in spec["model"]["vocab"]}
        ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.specials.values()]) + 1
        self.bytes_of = [b""] * size
        for b, i in ids.items():
            self.bytes_of[i] = b
        for text, i in self.specials.items():
            self.bytes_of[i] = text.encode()
        self.byte_id = [ids.get(bytes([b]), -1) for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank_of: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # the token that the merge of each rank makes
        self.born = np.full(size, -1, np.int64)  # the rank of the merge that makes a token
        self.left, self.right = np.arange(size), np.arange(size)
        for rank, (x, y) in enumerate(merges):
            a, b = ids[raw[x]], ids[raw[y]]
            new = ids[raw[x] + raw[y]]
            self.rank_of[a, b] = rank
            self.made.append(new)
            if self.born[new] < 0:
                self.born[new], self.left[new], self.right[new] = rank, a, b
        order = sorted((a << 32 | b, r) for (a, b), r in self.rank_of.items())
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*order, strict=True))
        self.longest = ahocorasick.Automaton()
        for b, i in ids.items():
            self.longest.add_word(b.decode("latin-1"), (len(b), i))
        self.longest.make_automaton()
        self.words = regex.compile(PATTERN)
        names = sorted(self.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.known: dict[str, bytes] = {}
        self.checked = np.empty(0, np.int64), np.empty(0, bool)
        self.merged = 0

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border between tokens a and b, for arrays of pairs.

        Goes back in time: the younger of the two tokens at the border is taken apart until
        two single bytes face each other.  A merge of the two facing tokens would have come
        about if it ranks before the merges that used them (at the same rank, the pair
        further left comes first).
        """
        a, b = a.copy(), b.copy()
        fine = np.ones(len(a), bool)
        used_a, used_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            crossed = (rank < used_a[todo]) & (rank <= used_b[todo]) & (rank < NEVER)
            fine[todo[crossed]] = False
            go = ~crossed & ((self.born[x] >= 0) | (self.born[y] >= 0))
            todo, x, y = todo[go], x[go], y[go]
            first = self.born[x] > self.born[y]
            used_a[todo[first]], a[todo[first]] = self.born[x[first]], self.right[x[first]]
            used_b[todo[~first]], b[todo[~first]] = self.born[y[~first]], self.left[y[~first]]
        return fine

    def verdicts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible``, remembering the verdict on each pair."""
        keys = a.astype(np.int64) << 32 | b
        asked, back = np.unique(keys, return_inverse=True)
        known, said = self.checked
        new = np.setdiff1d(asked, known, assume_unique=True)
        if len(new):
            known = np.concatenate([known, new])
            said = np.concatenate([said, self.compatible(new >> 32, new & 0xFFFFFFFF)])
            order = np.argsort(known)
            known, said = known[order], said[order]
            self.checked = (known, said) if len(known) < 4 * WORDS_KEPT else (known[:0], said[:0])
        return said[np.searchsorted(known, asked)][back]

    def merged_exactly(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first, in n log n."""
        self.merged += 1
        ids = [self.byte_id[c] for c in word]
        if len(ids) <= 60:
            rank_of, made = self.rank_of.get, self.made
            ranks = [rank_of(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
            while ranks and (rank := min(ranks)) < NEVER:
                at = ranks.index(rank)
                ids[at : at + 2] = [made[rank]]
                del ranks[at]
                if at:
                    ranks[at - 1] = rank_of((ids[at - 1], made[rank]), NEVER)
                if at < len(ranks):
                    ranks[at] = rank_of((made[rank], ids[at + 1]), NEVER)
            return ids
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.rank_of[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank_of]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[rank], -1
            k = after[i] = after[j]
            if k < len(ids):
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < len(ids) and (p := (ids[x], ids[y])) in self.rank_of:
                    heapq.heappush(heap, (self.rank_of[p], x, *p))
        return [i for i in ids if i >= 0]

    def learn(self, words: Iterable[str]) -> None:
        """Encode words not met before and remember their ids' bytes."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        raw = [w.encode("utf-8", "replace") for w in new]
        sizes = np.array([len(r) for r in raw])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text = "Ā".join([r.decode("latin-1") for r in raw])  # the divider stands for no byte
        found = [(end - n + 1, n, i) for end, (n, i) in self.longest.iter_long(text)]
        at, length, ids = (np.array(x, np.int64) for x in zip(*found, strict=True))
        word = np.searchsorted(starts, at, "right") - 1
        good = np.bincount(word, length, len(new)) == sizes
        same = word[1:] == word[:-1]
        ok = self.verdicts(ids[:-1][same], ids[1:][same])
        good[word[1:][same][~ok]] = False
        ends = np.searchsorted(word, np.arange(len(new) + 1))
        buffer = ids.astype("<u4").tobytes()
        for k, w in enumerate(new):
            if good[k]:
                self.known[w] = buffer[4 * ends[k] : 4 * ends[k + 1]]
            else:
                self.known[w] = np.array(self.merged_exactly(raw[k]), "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit numbers."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        split: list[list[str]] = []
        for text in texts:
            parts: list[str] = []
            for piece in self.special.split(text) if self.special else [text]:
                parts += [piece] if piece in self.specials else self.words.findall(piece)
            split.append(parts)
        for name, i in self.specials.items():
            self.known[name] = int(i).to_bytes(4, "little")
        self.learn({w for parts in split for w in parts})
        return [b"".join(map(self.known.__getitem__, parts)) for parts in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    return Codec(path)


def _slices(texts: pa.Array, most: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters, a longer text by itself; the others stay in Arrow meanwhile."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded``, a row for each row.

    Null texts are empty and have no ids; strings of the vocabulary's special tokens become
    those tokens, as in the tokenizer's default.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            at = 0
            for part in _slices(batch.column(1)):
                ids = tool.encode_batch(part)
                out = [batch.column(0).slice(at, len(part)), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                yield pa.record_batch([*out, pa.array([tool.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])
                at += len(part)
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(column).cast("string")).mapInArrow(
        run, "doc_id long, ids binary, n_tokens long, decoded string"
    )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: what ``encode`` gives, digested where it is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            at = 0
            for part in _slices(batch.column(1)):
                ids = tool.encode_batch(part)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(at, len(part)),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([sha256(x).hexdigest() for x in ids]),
                        pa.array([sha256(tool.decode(x).encode()).hexdigest() for x in ids]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(part)
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
