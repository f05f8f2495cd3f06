"""Timelines: merged streams, filters, buckets with their busiest addresses, and masked or plain output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huntframe.functions.time import bucket_seconds, in_window, parsed

COLUMNS = ("ts", "log_type", "src_ip", "user", "method", "uri", "msg")
TOP = 5


def merged(streams: Sequence[DataFrame]) -> DataFrame:
    """All streams by time as text, records without one last; ties by stream, file and line.

    The order is total whether or not the streams were sorted.
    """
    marked = [s.withColumn("stream", F.lit(i)) for i, s in enumerate(streams)]
    out = marked[0]
    for s in marked[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    ties = [c for c in ("src_file", "line_no") if c in out.columns]
    return out.orderBy(F.nullif("ts", F.lit("")).asc_nulls_last(), "stream", *ties)


def filtered(
    log: DataFrame, since: str | None = None, until: str | None = None, ip: str | None = None, user: str | None = None, file: str | None = None
) -> DataFrame:
    """Records in a window of times, of an address, of a user, and from files whose name contains ``file``."""
    out = log.where(in_window(F.col("ts"), since, until))
    for column, value in (("src_ip", ip), ("user", user)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out if file is None else out.where(F.coalesce(F.col("src_file"), F.lit("")).contains(file))


def bucketed(log: DataFrame, size: str, top: int = TOP) -> DataFrame:
    """Per bucket of ``size`` (``5m``): ``bucket, total, top_ips`` with the busiest addresses and their counts.

    Addresses are counted first, so a bucket is no larger than its addresses; equal counts go
    by address.  Records without a time are left out.
    """
    seconds = bucket_seconds(size)
    us = F.unix_micros(F.col("ts").cast("timestamp") if dict(log.dtypes)["ts"] != "string" else parsed(F.col("ts")))
    slot = (F.floor(F.floor(us / 1_000_000) / seconds) * seconds).cast("bigint")
    counts = log.withColumn("slot", slot).where("slot IS NOT NULL").groupBy("slot", "src_ip").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("slot").orderBy(F.col("n").desc(), "src_ip")
    named = counts.where("src_ip <> ''").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    tops = named.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("rank", "src_ip", "n"))).alias("t"))
    totals = counts.groupBy("slot").agg(F.sum("n").alias("total"))
    text = F.transform("t", lambda x: F.concat_ws("=", x["src_ip"], x["n"].cast("string")))
    return totals.join(tops, "slot", "left").select(
        F.date_format(F.timestamp_seconds("slot"), "yyyy-MM-dd'T'HH:mm:ss").alias("bucket"), "total", F.coalesce(text, F.array().cast("array<string>")).alias("top_ips")
    )
