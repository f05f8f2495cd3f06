"""Rules with timers on one key's state, and joins of two streams within a time.

``key_rules`` keeps a key's records until the watermark has passed them, and then takes them in
the order of their times: late records within the lateness allowed change nothing, and the rows
are those of a batch over the whole table, however the records were dealt over triggers.  A timer
wakes a key when its next record is final, and once more when it has been quiet for ``idle_us``:
then its state goes, and a later record begins afresh.  Records come and go as rows, since a data
frame a key costs more than its rules; what goes to the store is encoded entry by entry, so a
key's records of one trigger are one entry, and there are few calls a key however many they are.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUT = "key string, rule string, us bigint, nth bigint, value double"
#: So many records, at most, are one entry of a key's buffer: each entry is encoded on its own, at more than a record's rules cost.
APPENDED = 10_000
_BUFFER = "us array<bigint>, nth array<bigint>, kind array<string>, value array<string>"
_KEPT = "times array<bigint>, beaconed boolean, fails array<bigint>, armed_us bigint, dead boolean, n_values bigint, vals array<string>, seen_us bigint"


@dataclass(frozen=True)
class Rules:
    """Thresholds: a beacon's intervals, different values, and failures that arm a key for a success."""

    last: int = 20
    at_least: int = 15
    cv_under: float = 0.15
    mean_over: float = 5.0
    more_values_than: int = 25
    fails: int = 10
    fails_us: int = 60_000_000
    grace_us: int = 300_000_000
    idle_us: int = 30 * 86_400_000_000


def _entry(records: list[tuple]) -> tuple[list, ...]:
    """Records as one entry of a buffer: a list a column."""
    return tuple(list(column) for column in zip(*records, strict=True))


class KeyRules(StatefulProcessor):
    """One key's rules: ``beacon`` (once), ``values`` (once), ``armed`` and ``won`` (any number of times)."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", _BUFFER)
        self.kept = handle.getValueState("kept", _KEPT)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        due = None
        while part := [(r.us, r.nth, r.kind, r.value) for r in islice(rows, APPENDED)]:
            self.buffer.appendValue(_entry(part))
            first = min(r[0] for r in part)
            due = first if due is None else min(due, first)
        if due is not None:
            self._wake(due, timerValues)
        return iter(())

    def _wake(self, us: int, timers: TimerValues) -> None:
        """When the watermark has passed a record's time."""
        self.handle.registerTimer(max(us // 1000 + 1, timers.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((r for entry in self.buffer.get() for r in zip(*entry, strict=True)), key=lambda r: r[:2])
        final, later = [r for r in rows if r[0] < until], [r for r in rows if r[0] >= until]
        if later:
            self.buffer.put([_entry(later[i : i + APPENDED]) for i in range(0, len(later), APPENDED)])
            self._wake(later[0][0], timerValues)
        elif rows:
            self.buffer.clear()
        kept = list(self.kept.get() or ([], False, [], None, False, 0, [], None))
        if not final:
            if not later and kept[-1] is not None and until - kept[-1] > self.rules.idle_us:
                self.kept.clear()
            return
        for us, nth, kind, value in final:
            for rule, x in self._seen(kept, us, kind, value):
                yield Row(key=key[0], rule=rule, us=us, nth=nth, value=x)
        kept[-1] = final[-1][0]
        self.kept.update(tuple(kept))
        self.handle.registerTimer(max((kept[-1] + self.rules.idle_us) // 1000 + 2, timerValues.getCurrentWatermarkInMs() + 1))

    def _seen(self, kept: list, us: int, kind: str | None, value: str | None) -> Iterator[tuple[str, float]]:
        rules = self.rules
        times, beaconed, fails, armed_us, dead, n_values, values, _ = kept
        times = [*times, us][-(rules.last + 1) :]
        if not beaconed:
            gaps = [(b - a) / 1e6 for a, b in zip(times, times[1:], strict=False)]
            if len(gaps) >= rules.at_least and (mean := sum(gaps) / len(gaps)) > rules.mean_over:
                cv = math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) / mean
                if cv < rules.cv_under:
                    beaconed = True
                    yield "beacon", cv
        if value is not None and n_values <= rules.more_values_than and value not in values:
            values = [*values, value]
            n_values += 1
            if n_values > rules.more_values_than:
                values = []
                yield "values", float(n_values)
        if kind == "fail" and not dead:
            fails = list(fails)
            insort(fails, us)
            fails = fails[-rules.fails :]
            if armed_us is None and len(fails) == rules.fails and us - fails[0] <= rules.fails_us:
                armed_us = us
                yield "armed", float(rules.fails)
        elif kind == "success" and armed_us is not None and not dead:
            if us - armed_us <= rules.grace_us:
                yield "won", (us - armed_us) / 1e6
                armed_us = None
            else:  # too late: it stays armed for good
                dead = True
        kept[:7] = [times, beaconed, fails, armed_us, dead, n_values, values]

    def close(self) -> None:
        pass


def key_rules(stream: DataFrame, key: Column, kind: Column, value: Column, nth: Column, late: str, rules: Rules = Rules(), ts: str = "ts") -> DataFrame:  # noqa: B008
    """``OUT`` rows of a stream: ``kind`` is fail, success or anything else, ``value`` what is counted, ``nth`` orders records of one time.

    Records without key or time are left out, and those later than ``late`` are dropped by the watermark.
    The session must keep its state in RocksDB (``with_timers``).
    """
    timed = stream.withWatermark(ts, late).select(key.cast("string").alias("key"), ts, F.unix_micros(ts).alias("us"), nth.cast("bigint").alias("nth"), kind.cast("string").alias("kind"), value.cast("string").alias("value"))
    rows = timed.where("key IS NOT NULL AND us IS NOT NULL")
    return rows.groupBy("key").transformWithState(KeyRules(rules), OUT, "Append", "EventTime")


def with_timers(spark: SparkSession) -> SparkSession:
    """A session set up for ``key_rules``."""
    spark.conf.set(PROVIDER, ROCKS)
    return spark


def within(left: DataFrame, right: DataFrame, key: str, interval: str, late: str, ts: str = "ts", outer: bool = True) -> DataFrame:
    """Interval join of two streams: each record of ``left`` with every one of ``right`` (columns prefixed ``other_``) of its key that is later by at most ``interval``.

    ``left`` records that nothing follows come out with nulls, once the watermarks have passed their
    interval: until then both sides are state.  Records later than ``late`` are dropped on both sides.
    """
    one = left.withWatermark(ts, late)
    two = right.withWatermark(ts, late).select(*[F.col(c).alias(f"other_{c}") for c in right.columns])
    near = (F.col(key) == F.col(f"other_{key}")) & (F.col(f"other_{ts}") > F.col(ts)) & (F.col(f"other_{ts}") <= F.col(ts) + F.expr(f"INTERVAL {interval}"))
    return one.join(two, near, "leftOuter" if outer else "inner")
