"""Rules on URLs, asked of a cascade of Bloom filters.

A rule names a host (with its subdomains) and the start of a path.  Every URL has candidate
keys - its host's ends of whole labels, with its path's beginnings, in the shapes that rules
have - and the candidates of all URLs are the corpus's key universe.  Level 0 of a cascade
encodes the listed keys; level 1 the universe's keys that level 0 takes for listed; level 2 the
listed keys that level 1 takes for one of those, and so on until a level makes no mistake.  On
the universe it was built for, the cascade's answers are exact, so judging a URL needs no join.

The filters are small (about ``1.44 * n * (log2(universe / n) + 3)`` bits) and broadcast; their size is
known before they are built, and beyond ``MOST_BYTES`` the same answers come from a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.llm import store

#: What the filters of one judgement may take in each process.
MOST_BYTES = 256 << 20
#: Levels after which two keys must have equal 128-bit hashes.
MOST_LEVELS = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both are empty for null and for what has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``host, path, verdict`` of a few rules."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def listed(rules: DataFrame) -> DataFrame:
    """``key, block``, a row a key; rules without host or path count as empty there, and of a key with both verdicts the block holds."""
    key = F.concat(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit("")))
    return rules.where(F.col("verdict").isin(*VERDICTS)).groupBy(key.alias("key")).agg(F.max(F.col("verdict") == "block").alias("block"))


def shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """Numbers of labels and lengths of paths that rules have, longest key first comes later, by key.  As many as the longest host and path allow."""
    host, path = F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))
    found = rules.select(F.size(F.split(host, r"\.", -1)).alias("labels"), F.length(path).alias("length")).distinct()
    return sorted((r.labels, r.length) for r in found.collect())


def candidates(host: Column, path: Column, of: list[tuple[int, int]]) -> Column:
    """The keys of a URL that rules of these shapes could have, the longest first, of equal ones that with the longer host."""
    by_labels: dict[int, list[int]] = {}
    for labels, length in of:
        by_labels.setdefault(labels, []).append(length)

    def keys(labels: int, lengths: list[int]) -> Column:
        end = F.substring_index(host, ".", -labels)

        def key(n: Column) -> Column:
            return F.struct((-(F.length(end) + n)).alias("size"), (-F.length(end)).alias("host"), F.concat(end, F.substring(path, F.lit(1), n)).alias("key"))

        return F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), key)

    ends = [keys(*x) for x in by_labels.items()]
    # a host of fewer labels is whole for each of the larger numbers
    return F.transform(F.array_sort(F.array_distinct(F.flatten(F.array(*ends)))), lambda c: c["key"])


def hashes(key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a key."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    """Another hash for each level (the finaliser of splitmix64; its constants are fixed values)."""
    with np.errstate(over="ignore"):
        x = x.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


@dataclass(frozen=True)
class Shape:
    """Size of one level: its bits and how many a key sets."""

    level: int
    n_bits: int
    n_hashes: int

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The bits of each key, a row a key."""
        a, b = _mixed(h1, self.level), _mixed(h2, self.level) | np.uint64(1)
        with np.errstate(over="ignore"):
            return ((a[:, None] + np.arange(self.n_hashes, dtype=np.uint64) * b[:, None]) >> np.uint64(8)) % np.uint64(self.n_bits)


def shape_for(level: int, n_keys: int, n_others: int) -> Shape:
    """Level 0 lets few of the others through, the later ones half."""
    share = min(0.5, math.sqrt(0.5) * n_keys / max(1, n_others)) if level == 0 else 0.5
    share = max(share, 2.0**-40)
    n_bits = max(64, math.ceil(-n_keys * math.log(share) / math.log(2) ** 2))
    return Shape(level, -(-n_bits // 64) * 64, max(1, round(-math.log2(share))))


@dataclass(frozen=True)
class Cascade:
    """Exact membership on the universe it was built for."""

    levels: tuple[tuple[Shape, np.ndarray], ...]

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which keys are listed: the first level that rejects a key decides, or the last one."""
        out = np.zeros(len(h1), bool)
        left = np.arange(len(h1))
        for shape, words in self.levels:
            passed = passes(shape, words, h1[left], h2[left])
            out[left] = passed == (shape.level % 2 == 0)
            left = left[passed]
        return out

    @property
    def n_bytes(self) -> int:
        return sum(words.nbytes for _, words in self.levels)


def passes(shape: Shape, words: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    if not len(h1):
        return np.zeros(0, bool)
    at = shape.places(h1, h2)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _filter(keys: DataFrame, shape: Shape) -> np.ndarray:
    """The level's bits: each task sets those of its keys, equal words are or-ed, at most ``n_bits / 64`` come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(shape.places(*(c.to_numpy() for c in batch.columns)))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(at):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    found = keys.select(*hashes(F.col("key"))).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(shape.n_bits // 64, np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return words.view(np.uint64)


def _passing(keys: DataFrame, shape: Shape, words: np.ndarray) -> DataFrame:
    """The rows (``key, h1, h2`` and others) whose key the level takes."""
    sent = keys.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(shape, sent.value, batch["h1"].to_numpy(), batch["h2"].to_numpy())))

    h1, h2 = hashes(F.col("key"))
    return keys.withColumns({"h1": h1, "h2": h2}).mapInArrow(run, keys.withColumns({"h1": h1, "h2": h2}).schema).drop("h1", "h2")


def build(keys: DataFrame, universe: DataFrame, n_keys: int, n_universe: int) -> Cascade:
    """A cascade for the listed ``keys`` (``key``, each once) over ``universe`` (``key``, any number of times)."""
    if not n_keys:
        return Cascade(())
    shape = shape_for(0, n_keys, n_universe - n_keys)
    levels = [(shape, _filter(keys, shape))]
    taken = _passing(universe, *levels[0]).distinct()
    taken = store.written(taken.join(keys.withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "taken")
    alive = {side: store.written(taken.where(F.col("listed") == side).select("key"), "alive") for side in (True, False)}
    made = [taken, *alive.values()]
    n_alive = {side: df.count() for side, df in alive.items()}
    while n_alive[side := len(levels) % 2 == 0]:  # whom the next level encodes: those that the last one takes wrongly
        if len(levels) == MOST_LEVELS:
            raise ValueError("a listed and another key have equal 128-bit hashes")
        shape = shape_for(len(levels), n_alive[side], n_alive[not side])
        levels.append((shape, _filter(alive[side], shape)))
        alive[not side] = store.written(_passing(alive[not side], *levels[-1]), "alive")
        n_alive[not side] = alive[not side].count()
        made.append(alive[not side])
    store.drop(keys.sparkSession, *made)
    return Cascade(tuple(levels))


def _urls(pages: DataFrame) -> DataFrame:
    host, path = parts(F.col("url").cast("string"))
    return pages.select("page_id", host.alias("host"), path.alias("path"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id, url``); ``rules`` has ``host, path, verdict``.

    The rule with the longest host and path together holds, of equally long ones that with the
    longer host.  A URL that no rule fits has no rule and the verdict ``default``: it is none of
    the listed keys.  Rows are judged one by one, so repeated and null ids stay as they are; a
    null URL has an empty host and path; an empty table gives no rows; without rules all get the
    default; other columns are ignored.
    """
    spark = pages.sparkSession
    urls = _urls(pages)
    table = listed(rules)
    if not (of := shapes(rules)):
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    table = store.written(table, "rules")
    asked = candidates(F.col("host"), F.col("path"), of)
    universe = urls.select(F.explode(asked).alias("key"))
    n = {r.block: r["count"] for r in table.groupBy("block").count().collect()}
    n_universe = universe.agg(F.approx_count_distinct("key")).first()[0]
    # the later levels encode 0.71, 0.5, 0.35, ... times as many keys as are listed, at 1.44 bits each
    if sum((shape_for(0, k, n_universe - k).n_bits + 4 * k) // 8 for k in n.values()) > most_bytes:
        return by_join(urls, table, of, default)
    lists = [build(table.where(F.col("block") == block).select("key"), universe, n.get(block, 0), n_universe) for block in (False, True)]
    store.drop(spark, table)
    sent = spark.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, h1, h2 = (batch.column(name) for name in ("keys", "h1", "h2"))
            one, two = (np.ascontiguousarray(h.flatten().to_numpy(zero_copy_only=False)) for h in (h1, h2))
            found = [c.has(one, two) for c in sent.value]
            row = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
            at = np.flatnonzero(found[0] | found[1])
            rows, first = np.unique(row[at], return_index=True)
            rule, verdict = np.full(len(keys), -1), np.full(len(keys), default, object)
            rule[rows] = at[first]
            verdict[rows] = np.where(found[1][at[first]], *reversed(VERDICTS))
            taken = keys.flatten().take(pa.array(rule, mask=rule < 0))
            yield pa.record_batch([*(batch.column(c) for c in ("page_id", "host", "path")), taken, pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    one, two = F.transform("keys", lambda k: hashes(k)[0]), F.transform("keys", lambda k: hashes(k)[1])
    ready = urls.withColumn("keys", asked).withColumns({"h1": one, "h2": two})
    kind = pages.schema["page_id"].dataType.simpleString()
    return ready.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def by_join(urls: DataFrame, table: DataFrame, of: list[tuple[int, int]], default: str) -> DataFrame:
    """The same for a list too large to broadcast: each distinct host and path asks the list for its candidates in one join."""
    distinct = urls.select("host", "path").distinct()
    asked = distinct.select("host", "path", F.posexplode(candidates(F.col("host"), F.col("path"), of)).alias("pos", "key"))
    best = asked.join(table, "key").groupBy("host", "path").agg(F.min(F.struct("pos", "key", "block")).alias("best"))
    best = store.written(best.select("host", "path", F.col("best.key").alias("rule"), F.col("best.block").alias("block")), "best")
    verdict = F.when(F.col("block"), "block").when(~F.col("block"), "allow").otherwise(default)
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
