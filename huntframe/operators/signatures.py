"""Many patterns at once: an automaton over the texts that they need, and each pattern only where its text is.

A pattern that can match only where some text stands has such texts as its literals (any of
them, in lower case).  One automaton for each field finds the literals of all signatures in one
walk over a value; the pattern is tried only then.  Patterns without a literal are always tried.
So a record's cost follows the literals it has, not the number of signatures.

Signatures are a table: ``sig_id, field, pattern`` and whatever else they say.  Up to ``MOST_HELD``
of them each Python worker holds once; a larger table stays one, and its literals are joined with
the parts of the different values (``joined``).  Patterns are Python's, with ASCII classes and cases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from re import _constants as C
from re import _parser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.operators.bloom import Bloom
from huntframe.sources.store import dealt, settled

#: Shorter literals are in too many values to tell anything.
LEAST_LITERAL = 3
#: Characters of values whose hits a worker remembers.
CHARS_KEPT = 4_000_000
#: Signatures that ``collected`` takes at most; more are an error, none are left out.
MOST_SIGNATURES = 2_000_000
#: Signatures that ``hits`` gives to a worker; more are joined.
MOST_HELD = 100_000
#: Characters of a literal that are joined on; the rest is compared after.
KEY_CHARS = 32
#: Patterns without a literal that are broadcast to all values; more are dealt over tasks.
MOST_ALWAYS = 10_000


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The choice whose shortest text is longer, of equal ones that with fewer texts."""
    rank = lambda x: (min(map(len, x)), -len(x))
    return max((x for x in (a, b) if x), key=rank, default=None)


def _needed(parts: Sequence) -> frozenset[str] | None:
    best, run = None, ""
    for op, value in [*parts, (None, None)]:
        if op is C.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if op is C.IN and {k for k, _ in value} == {C.LITERAL} and len({chr(v).lower() for _, v in value if v < 128} | {"" for _, v in value if v > 127}) == 1:
            run += chr(value[0][1]).lower()
            continue
        if run:
            best, run = _better(best, frozenset([run])), ""
        if op is C.SUBPATTERN:
            best = _better(best, _needed(value[3]))
        elif op is C.BRANCH:
            each = [_needed(p) for p in value[1]]
            best = _better(best, frozenset().union(*each) if all(each) else None)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            best = _better(best, _needed(value[2]))
        elif op is C.ATOMIC_GROUP:
            best = _better(best, _needed(value))
        elif op is C.ASSERT:
            best = _better(best, _needed(value[1]))
    return best


def literals(pattern: str) -> frozenset[str] | None:
    """Lower-case ASCII texts one of which every match's value contains; None if there are none of ``LEAST_LITERAL`` characters."""
    found = _needed(_parser.parse(pattern, re.ASCII))
    return found if found and min(map(len, found)) >= LEAST_LITERAL else None


class Matcher:
    """The signatures of one field: ``(number, pattern, literals)`` each; a pattern is compiled when it is first tried."""

    def __init__(self, signatures: Sequence[tuple[int, str, frozenset[str] | None]]):
        import ahocorasick

        self.patterns: dict[int, str | re.Pattern] = {n: p for n, p, _ in signatures}
        holders: dict[str, list[int]] = {}
        self.always = []
        for n, _, texts in signatures:
            for t in texts or ():
                holders.setdefault(t, []).append(n)
            if not texts:
                self.always.append(n)
        self.automaton = ahocorasick.Automaton()
        for t, numbers in holders.items():
            self.automaton.add_word(t, tuple(numbers))
        self.automaton.make_automaton()
        self.any = bool(holders)
        self.tried = 0

    def _pattern(self, n: int) -> re.Pattern:
        found = self.patterns[n]
        if isinstance(found, str):
            found = self.patterns[n] = re.compile(found, re.ASCII)
        return found

    def __call__(self, value: str) -> list[int]:
        """Numbers of the signatures that an (unempty) value matches, in order."""
        asked = set(self.always)
        if self.any:
            for _, numbers in self.automaton.iter(value.lower()):
                asked.update(numbers)
        self.tried += len(asked)
        return sorted(n for n in asked if self._pattern(n).search(value))


class Matchers:
    """One ``Matcher`` a field, and the hits of the values met last."""

    def __init__(self, signatures: Sequence[tuple[int, str, str, frozenset[str] | None]]):
        by_field: dict[str, list[tuple[int, str, frozenset[str] | None]]] = {}
        for n, field, pattern, texts in signatures:
            by_field.setdefault(field, []).append((n, pattern, texts))
        self.of = {f: Matcher(s) for f, s in by_field.items()}
        self.known: dict[tuple[str, str], list[int]] = {}
        self.chars = 0

    def __call__(self, field: str, value: str | None) -> list[int]:
        if not value or field not in self.of:
            return []
        found = self.known.get((field, value))
        if found is None:
            found = self.of[field](value)
            if self.chars > CHARS_KEPT:
                self.known.clear()
                self.chars = 0
            self.known[field, value] = found
            self.chars += len(value)
        return found


@lru_cache(4)
def _matchers(signatures: tuple) -> Matchers:
    return Matchers(signatures)


def valid(rows: Sequence[tuple]) -> list[tuple]:
    """Those of ``(sig_id, field, pattern, ...)`` whose pattern is one; empty and broken patterns are left out, as the rules' reader does."""
    out = []
    for r in rows:
        try:
            if r[2]:
                re.compile(r[2])
                out.append(r)
        except re.error:
            continue
    return out


def collected(table: DataFrame, names: Sequence[str] = ("sig_id", "field", "pattern")) -> list[tuple]:
    """The rows of a signature table, in the order of their ids and patterns."""
    rows = table.select(*names).limit(MOST_SIGNATURES + 1).collect()
    if len(rows) > MOST_SIGNATURES:
        raise ValueError(f"more than {MOST_SIGNATURES} signatures")
    return valid(sorted(map(tuple, rows), key=repr))


def matching(fields: Mapping[str, Column], signatures: Sequence[tuple[int, str, str]], spark: SparkSession) -> Column:
    """The numbers of all signatures ``(number, field, pattern)`` that a record's fields match, in order, as an array; null and empty fields match none.

    Only the fields that signatures look at go to Python.
    """
    names = [f for f in fields if f in {s[1] for s in signatures}]
    if not names:
        return F.array().cast("array<int>")
    # literals are read off the patterns once, here
    sent = spark.sparkContext.broadcast(tuple((n, f, p, literals(p)) for n, f, p in signatures))

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        match = _matchers(sent.value)
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)  # Spark hands a single column over bare
            yield pd.Series([sorted(n for f, v in zip(names, row, strict=True) for n in match(f, v)) for row in zip(*columns, strict=True)], dtype=object)

    return found(*[fields[f].cast("string") for f in names])


def keyed(table: DataFrame) -> DataFrame:
    """``field, pattern, text, key``: a row for each literal of each different pattern, with its first ``KEY_CHARS`` characters; empty ones where a pattern has none.

    Null, empty and broken patterns are left out, as ``valid`` does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, str]] = []
            for field, pattern in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    texts = literals(pattern)
                    if "(?<" in pattern:  # what parsing alone doesn't refuse
                        re.compile(pattern, re.ASCII)
                except re.error:
                    continue
                out += [(field, pattern, t) for t in texts or ("",)]
            yield pa.record_batch([pa.array([r[k] for r in out], pa.string()) for k in range(3)], ["field", "pattern", "text"])

    # few bytes, much work: a table of one small file is dealt to all tasks, and Spark doesn't put them together again
    some = dealt(table.where("field IS NOT NULL AND pattern <> ''").select("field", "pattern"), "field", "pattern").distinct()
    return some.mapInArrow(run, "field string, pattern string, text string").withColumn("key", F.substring("text", 1, KEY_CHARS))


def tried(candidates: DataFrame) -> DataFrame:
    """Those of ``field, value, pattern`` whose pattern matches, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield batch.filter(pa.array([re.compile(p, re.ASCII).search(v) is not None for p, v in pairs], pa.bool_()))

    return candidates.select("field", "value", "pattern").mapInArrow(run, "field string, value string, pattern string").distinct()


def joined(records: DataFrame, fields: Mapping[str, Column], table: DataFrame) -> DataFrame:
    """``hits`` for tables of any size, none of which comes to the driver.

    The different values' parts, of the lengths that the literals have, are joined with the literals;
    a Bloom filter of bounded size drops most of them before.  Values and signatures that meet
    become a table of their own, which the records are joined with.
    """
    asked = table.where(F.col("field").isin(*fields))
    known = settled(keyed(asked), "literals")
    pair = F.explode(F.array(*[F.struct(F.lit(f).alias("__field"), c.cast("string").alias("__value")) for f, c in fields.items()]))
    rows = records.withColumn("__pair", pair).withColumns({"__field": F.col("__pair.__field"), "__value": F.col("__pair.__value")}).drop("__pair").where("__value <> ''")
    values = settled(rows.select(F.col("__field").alias("field"), F.col("__value").alias("value")).distinct(), "values")
    keys = known.where("key <> ''")
    # at most KEY_CHARS lengths a field
    sizes = keys.select("field", F.length("key").alias("size")).distinct().collect()
    found = None
    if sizes:
        by_field = {f: sorted(r.size for r in sizes if r.field == f) for f in {r.field for r in sizes}}
        lengths = F.lit(None).cast("array<int>")
        for f, own in by_field.items():
            lengths = F.when(F.col("field") == f, F.array(*map(F.lit, own))).otherwise(lengths)
        cut = values.withColumn("low", F.lower("value")).withColumn("size", F.explode(lengths)).where(F.length("low") >= F.col("size"))
        places = F.sequence(F.lit(1), F.length("low") - F.col("size") + 1)
        parts = cut.select("field", "value", "low", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("low"), i, F.col("size"))))).alias("key"))
        bloom = Bloom.of(keys.select("key").distinct(), "key")
        if bloom is not None:
            parts = parts.where(bloom.may_hold(records, F.col("key")))
        found = parts.join(keys, ["field", "key"]).where(F.contains("low", "text")).select("field", "value", "pattern")
    always = known.where("key = ''").select("field", "pattern")
    n = always.count()
    if n or found is None:
        every = values.join(F.broadcast(always) if n <= MOST_ALWAYS else always.hint("shuffle_replicate_nl"), "field").select("field", "value", "pattern")
        found = every if found is None else found.unionByName(every)
    named = asked.select("sig_id", "field", "pattern").join(settled(tried(found), "matching"), ["field", "pattern"])
    met = settled(named.select(F.col("field").alias("__field"), F.col("value").alias("__value"), "sig_id", "field", "pattern"), "met")
    return rows.join(met, ["__field", "__value"]).drop("__field", "__value")


def hits(records: DataFrame, fields: Mapping[str, Column], table: DataFrame, most_held: int = MOST_HELD) -> DataFrame:
    """A row for each record and signature it matches: the record's columns, ``sig_id, field, pattern``.

    Rows of ``table`` with null or broken patterns match nothing; repeated signatures match each time;
    fields that aren't among ``fields`` are never looked at.  More than ``most_held`` signatures are ``joined``.
    """
    if table.select(F.lit(1)).limit(most_held + 1).count() > most_held:
        return joined(records, fields, table)
    rows = collected(table)
    spark = records.sparkSession
    named = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "__n int, sig_id string, field string, pattern string")
    seen = records.withColumn("__n", F.explode(matching(fields, [(n, r[1], r[2]) for n, r in enumerate(rows)], spark)))
    return seen.join(F.broadcast(named) if len(rows) <= 100_000 else named, "__n").drop("__n")
