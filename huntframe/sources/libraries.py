"""Rule libraries, indicators and baselines from files: small tables that the driver holds."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("rules", "patterns", "signatures", "iocs")


def _text(spark: SparkSession, path: str) -> str:
    """A whole small file, by Spark's readers, so from any store."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def read_rows(spark: SparkSession, path: str, pattern: str | None = "pattern") -> list[dict]:
    """A JSON list, or the list under one of ``KEYS``; rows whose ``pattern`` isn't a pattern are left out."""
    data = json.loads(_text(spark, path))
    rows = data if isinstance(data, list) else next((data[k] for k in KEYS if isinstance(data.get(k), list)), [])
    out = []
    for r in rows:
        try:
            re.compile(r.get(pattern) or "" if pattern else "")
        except re.error:
            continue
        out.append(r)
    return out


def as_tuples(rows: Sequence[dict], names: Sequence[str], where: dict | None = None) -> tuple[tuple, ...]:
    """Rows as the tuples that the rules take, of those that have the values of ``where``."""
    return tuple(tuple(r.get(n) for n in names) for r in rows if all(r.get(k) == v for k, v in (where or {}).items()))


def read_vendor(spark: SparkSession, path: str) -> dict:
    """A vendor's names and words from the YAML block at the head of a text."""
    head = re.match(r"^---\s*\n(.*?)\n---\s*\n", _text(spark, path), re.S)
    data = yaml.safe_load(head[1]) if head else None
    if not isinstance(data, dict):
        raise ValueError(f"no YAML block at the head of {path}")
    missing = [k for k in ("vendor_name", "field_map", "severity_map", "category_map") if k not in data]
    if missing:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    words = lambda k: {str(a): str(b) for a, b in data[k].items()}
    return {"name": data["vendor_name"], "fields": data["field_map"], "severities": words("severity_map"), "categories": words("category_map")}


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Users of ``user`` or ``user=fingerprint`` lines; ``#`` begins a comment line."""
    line = F.trim("value")
    user = F.trim(F.substring_index(line, "=", 1))
    return spark.read.text(path).where((line != "") & ~line.startswith("#") & (user != "")).select(user.alias("user")).distinct()
