"""Vendors' alerts to ALERT, by tables of names and words."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe import schemas
from huntframe.functions.text import first_match
from huntframe.rules.catalog import OTHER
from huntframe.rules.vendors import VENDORS

# Fixed values.
CATEGORY_NAMES = ("category", "attack_type", "event_type", "threat_type", "event_category", "attack_type_name")
WRAPPERS = ("data", "result", "records", "alerts", "items")
DEFAULT_SEVERITY = "P2"

_FIELDS = [f.split(" ")[0] for f in schemas.ALERT.split(", ")][:12]


def _aliased(obj: Column, lowered: Column, names) -> Column:
    """The first alias with a value, each first as it is written, then in any case."""
    if not names:
        return F.lit(None).cast("string")
    found = []
    for n in names:
        found += [F.nullif(F.try_element_at(obj, F.lit(n)), F.lit("")), F.try_element_at(lowered, F.lit(n.lower()))]
    return F.coalesce(*found)


def lowered_keys(obj: Column) -> Column:
    """The map with lower-case keys and no empty values; of keys that become equal the first stays."""
    full = F.filter(F.map_entries(obj), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    entries = F.transform(full, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def mapped_severity(raw: Column, table: Mapping[str, str]) -> Column:
    """A level by its word, whatever the case, or by its number (``4``, ``4.0``); null if unknown."""
    word = F.trim(raw)
    exact = F.create_map(*[F.lit(x) for p in table.items() for x in p])
    lower: dict[str, str] = {}
    for k, v in table.items():
        lower.setdefault(k.lower(), v)
    low = F.create_map(*[F.lit(x) for p in lower.items() for x in p])
    number = word.try_cast("double").try_cast("bigint").cast("string")
    return F.coalesce(F.try_element_at(exact, word), F.try_element_at(low, F.lower(word)), F.try_element_at(exact, number))


def mapped_category(rule: Column, kind: Column, table: Mapping[str, str]) -> Column:
    """The first of the table's words, in its order, that the kind or the rule's name contains."""
    texts = [F.coalesce(F.trim(c), F.lit("")) for c in (kind, rule)]
    return F.coalesce(first_match((texts[0].contains(k) | texts[1].contains(k), v) for k, v in table.items()), F.lit(OTHER))


def normalised(objects: DataFrame, vendor: str | Mapping, strict: bool = False) -> DataFrame:
    """Maps (column ``obj``) to ALERT.  Alerts without a time are dropped.

    Severities that the table doesn't know become P2; with ``strict`` they fail the job.
    """
    config = VENDORS[vendor] if isinstance(vendor, str) else vendor
    name = vendor if isinstance(vendor, str) else config.get("name", "unknown")
    rows = objects.withColumn("__low", lowered_keys(F.col("obj")))
    found = {f: _aliased(F.col("obj"), F.col("__low"), config["fields"].get(f, ())) for f in _FIELDS}
    rows = rows.withColumns({f"__{f}": c for f, c in found.items()} | {"__kind": _aliased(F.col("obj"), F.col("__low"), CATEGORY_NAMES)})
    level = mapped_severity(F.col("__severity"), config["severities"])
    if strict:
        unknown = F.concat(F.lit("unknown severity: "), F.col("__severity"))
        level = F.when(F.col("__severity").isNotNull() & level.isNull(), F.raise_error(unknown)).otherwise(level)
    out = {f: F.col(f"__{f}") for f in _FIELDS} | {"severity": F.coalesce(level, F.lit(DEFAULT_SEVERITY))}
    return rows.where("__ts IS NOT NULL").select(
        *[c.alias(f) for f, c in out.items()],
        mapped_category(F.col("__rule_name"), F.col("__kind"), config["categories"]).alias("category"),
        F.lit(name).alias("vendor"),
        F.array_sort(F.map_keys("obj")).alias("_raw_keys"),
    )


def as_log(alerts: DataFrame, compat: bool = False) -> DataFrame:
    """ALERT under LOG's names, so that indicators can match agents and payloads too (``compat``: only addresses)."""
    wide = {"ua": "user_agent", "uri": "payload", "user": "username"}
    mine = {n: F.lit(None).cast("string") if compat else F.col(v) for n, v in wide.items()}
    mine |= {"ts": F.col("ts"), "log_type": F.col("vendor"), "src_ip": F.col("src_ip"), "dst_ip": F.col("dst_ip"), "msg": F.col("rule_name")}
    return alerts.select(*[mine.get(n, F.lit(None)).cast(k).alias(n) for n, k in (f.split(" ") for f in schemas.LOG.split(", "))])
