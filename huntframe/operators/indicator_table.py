"""Indicators as a table of any size: addresses, domains with what lies below them, hashes, mail addresses.

Nothing of the list comes to the driver but a Bloom filter of bounded size.  Each record's values
become keys (a host asks for itself and for every suffix); the filter drops those that no
indicator has, and what is left is joined with the written table.  Both sides of that join are
tables, so Spark splits an address that has very many records.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.net import host_of_uri
from huntframe.operators.bloom import MOST_BYTES, Bloom
from huntframe.sources.store import settled

#: What lies below a domain, given as ``*.domain``.
BELOW = "below"
FIELDS = ("type", "value", "confidence", "tag")


def keyed(table: DataFrame) -> DataFrame:
    """``__key`` and the indicator's fields, for types other than patterns and address blocks; each value once, its smallest row."""
    kind, value = F.lower(F.trim("type")), F.lower(F.trim("value"))
    wild = (kind == "domain") & value.startswith("*.")
    key = F.when(wild, F.concat(F.lit(f"{BELOW}:"), F.substring(value, 3, 1 << 30))).otherwise(F.concat(kind, F.lit(":"), value))
    some = table.where((value != "") & ~((kind == "ip") & value.contains("/")) & ~kind.isin("path", "url", "ua", "tool"))
    return some.groupBy(key.alias("__key")).agg(F.min(F.struct(*FIELDS)).alias("ioc"))


def keys_of(values: Mapping[str, Column]) -> Column:
    """The keys that a record asks for, from its columns by type; a domain asks for its suffixes too."""
    def below(value: Column) -> Column:
        labels = F.split(value, "\\.")
        suffixes = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda k: F.concat(F.lit(f"{BELOW}:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
        return F.when((value != "") & (F.size(labels) > 1), suffixes)

    asked = []
    for kind, column in values.items():
        value = F.lower(F.trim(column.cast("string")))
        asked.append(F.when(value != "", F.array(F.concat(F.lit(f"{kind}:"), value))))
        if kind == "domain":
            asked.append(below(value))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*asked))))


def hits(records: DataFrame, values: Mapping[str, Column], table: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A row for each record and indicator that one of its values is: the record's columns and ``ioc``.

    Null and empty values ask for nothing; case and outer blanks don't count; a record that meets a
    domain and what it lies below meets both.
    """
    known = settled(keyed(table), "indicators")
    bloom = Bloom.of(known, "__key", most_bytes)
    asked = records.withColumn("__key", F.explode(keys_of(values)))
    if bloom is not None:
        asked = asked.where(bloom.may_hold(records, F.col("__key")))
    return asked.join(known.withColumnRenamed("ioc", "__ioc"), "__key").drop("__key").withColumnRenamed("__ioc", "ioc")


def log_hits(log: DataFrame, table: DataFrame) -> DataFrame:
    """``hits`` of LOG: its address and the host of its URI."""
    return hits(log, {"ip": F.col("src_ip"), "domain": host_of_uri(F.col("uri"))}, table)
