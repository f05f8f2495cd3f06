"""Ranges of addresses beside records: where an address lies, and how fast an account would have had to travel.

A range from any address to any other is cut into aligned blocks, two a size at most, so that
finding the ranges of an address is an equi-join on block size and number; only distinct
addresses are asked, with the sizes that the ranges have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.net import ip_number
from huntframe.operators.windows import looking_back
from huntframe.sources.store import settled

EARTH_KM = 6371.0
BITS = 32


def blocks(first: Column, last: Column) -> Column:
    """The aligned blocks that make up a range of numbers, as an array of ``(bits, block)``: the numbers from ``block << bits`` on, 2^bits of them.

    At each size the range, rounded inwards, has an odd block left over at its start, at its end, at both or at neither.
    """

    def of(k: Column) -> Column:
        low, high = F.call_function("shiftright", first + F.call_function("shiftleft", F.lit(1).cast("bigint"), k) - 1, k), F.call_function("shiftright", last + 1, k)
        block = lambda odd, number: F.when((low < high) & (F.pmod(odd, F.lit(2)) == 1), F.struct(k.alias("bits"), number.alias("block")))
        return F.array_compact(F.array(block(low, low), block(high, high - 1)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BITS)), of))


def in_ranges(records: DataFrame, column: str, ranges: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``records`` with the ``fields`` of the smallest range that holds their IPv4 address, of equal ones the first; null without one.

    ``ranges`` has ``first_ip, last_ip`` and the fields; ranges that end before they begin, or aren't of addresses, hold nothing.
    """
    first, last = ip_number(F.col("first_ip")), ip_number(F.col("last_ip"))
    known = ranges.select(first.alias("__first"), last.alias("__last"), *fields).where("__first <= __last")
    cut = known.select("__first", "__last", F.struct(*fields).alias("__what"), F.explode(blocks(F.col("__first"), F.col("__last"))).alias("__b"))
    cut = settled(cut.select("__first", "__last", "__what", "__b.bits", "__b.block"), "ranges")
    sizes = [r.bits for r in cut.select("bits").distinct().collect()]  # 33 at most
    asked = records.select(F.col(column).alias("__ip"), ip_number(F.col(column)).alias("__n")).where("__n IS NOT NULL").distinct()
    probes = F.array(*[F.struct(F.lit(k).alias("bits"), F.shiftright("__n", k).alias("block")) for k in sizes]) if sizes else F.array().cast("array<struct<bits:int,block:bigint>>")
    held = asked.select("__ip", F.explode(probes).alias("__b")).select("__ip", "__b.*").join(cut, ["bits", "block"])
    best = held.groupBy("__ip").agg(F.min(F.struct((F.col("__last") - F.col("__first")).alias("size"), "__first", "__what")).alias("__best"))
    best = settled(best.select("__ip", "__best.__what"), "places")
    return records.join(best, records[column] == best["__ip"], "left").select(*[records[c] for c in records.columns], *[F.col(f"__what.{f}").alias(f) for f in fields])


def distance_km(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """Along the surface (haversine)."""
    a, b = F.radians(lat), F.radians(other_lat)
    half = F.sin((b - a) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin((F.radians(other_lon) - F.radians(lon)) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def impossible_travel(log_ins: DataFrame, places: DataFrame, key: str = "user", us: str = "us", ties: Sequence[str] = ("src_file", "line_no"), column: str = "src_ip", over_kmh: float = 900.0, least_km: float = 100.0) -> DataFrame:
    """PLB-BF-014: log-ins further from the account's last one than anybody travels in between, with ``km`` and ``kmh``.

    ``places`` are ranges with ``lat, lon``; log-ins from nowhere known are passed over.  Times less than a second apart count as one.
    """
    placed = in_ranges(log_ins.where(F.col(key).isNotNull()), column, places, ("lat", "lon")).where("lat IS NOT NULL AND lon IS NOT NULL")
    before = looking_back(settled(placed, "placed"), [key], us, list(ties), 1, lambda w: {f"__{c}": F.lag(c).over(w) for c in ("lat", "lon", us)})
    km = distance_km(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon"))
    hours = F.greatest((F.col(us) - F.col(f"__{us}")) / F.lit(3.6e9), F.lit(1 / 3600))
    moved = before.where(F.col(f"__{us}").isNotNull()).withColumn("km", km).withColumn("kmh", F.col("km") / hours)
    return moved.where((F.col("km") >= least_km) & (F.col("kmh") > over_kmh)).drop("__lat", "__lon", f"__{us}")


def leaked_accounts(log_ins: DataFrame, leaked: DataFrame, at_least: int = 5) -> DataFrame:
    """PLB-BF-007: accounts of a table of leaked ones (``user``) that are tried from ``at_least`` addresses or more: ``user, sources, tries``."""
    known = settled(leaked.select("user").distinct(), "leaked")
    pairs = log_ins.groupBy("user", "src_ip").agg(F.count(F.lit(1)).alias("n")).join(known, "user")
    return pairs.groupBy("user").agg(F.count("src_ip").alias("sources"), F.sum("n").alias("tries")).where(F.col("sources") >= at_least)
