"""The stateful detectors on streams: buckets, bursts, first sights and indicators.

A stream's state is bounded by its watermark: what is older than the window and the lateness
allowed is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BURST = "key string, ts timestamp, n bigint"
_STATE = "times array<bigint>, reported boolean"


def bucket_counts(stream: DataFrame, size: str, late: str, keys: tuple[str, ...] = ("src_ip",), ts: str = "ts") -> DataFrame:
    """Counts a key and bucket, given out when the bucket can't change any more."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("bucket"), *keys, "n")


def sessions(stream: DataFrame, gap: str, late: str, keys: tuple[str, ...] = ("src_ip",), ts: str = "ts") -> DataFrame:
    """Sessions of a key: its records with no longer pause than ``gap``."""
    made = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_sights(stream: DataFrame, keys: tuple[str, ...], late: str, ts: str = "ts") -> DataFrame:
    """The first record of each key, within the lateness allowed."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def with_indicators(stream: DataFrame, table: DataFrame, column: str = "src_ip") -> DataFrame:
    """Records whose ``column`` is in a static table of indicators (``value``)."""
    return stream.join(table, stream[column] == table["value"])


def bursts(stream: DataFrame, key: str, window_us: int, at_least: int, late: str, ts: str = "ts", ties: str | None = None) -> DataFrame:
    """A key's first record with ``at_least`` records within ``window_us``: ``key, ts, n``, once a key.

    The state of a key is the times in its window, ``at_least`` at most since it reports then,
    and that it has reported; it goes when the watermark passes the window.  Records of one
    trigger are taken in the order of their times.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, reported = state.get if state.exists else ([], False)
        # One trigger's records of one key: eight bytes each, sorted and compared as arrays.
        times = np.sort(np.concatenate([np.array(kept, np.int64), *(b["us"].to_numpy(np.int64) for b in batches)]))
        ends = times[at_least - 1 :]
        # A row completes a burst if the one at_least - 1 before it is in its window; rows of the state alone never did.
        full = np.flatnonzero(ends - times[: len(ends)] <= window_us) if not reported else ends[:0]
        reported = bool(reported or len(full))
        left = [] if reported else times[times >= times[-1] - window_us].tolist() if len(times) else []
        state.update((left, reported))
        if left:
            state.setTimeoutTimestamp(max(left[-1] // 1000 + window_us // 1000, state.getCurrentWatermarkMs() + 1))
        if len(full):
            yield pd.DataFrame([(k[0], pd.Timestamp(int(ends[full[0]]), unit="us"), at_least)], columns=["key", "ts", "n"])

    timed = stream.withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), ts, F.unix_micros(ts).alias("us"))
    return timed.where("key IS NOT NULL").groupBy("key").applyInPandasWithState(step, BURST, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(result: DataFrame, checkpoint: str, path: str) -> None:
    """Run a stream over all that is there now, and write what it gives as Parquet."""
    query = result.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
