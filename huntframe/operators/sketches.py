"""Mergeable sketches: distinct values and most frequent ones, a row a key and slab, merged for any window later.

Exact counts of distinct values must go back to the records for every window that is asked.
Sketches are made once, as records arrive, have a bounded size whatever the key, are kept as a
table (``sources.store`` writes it by day), and any span of slabs is their union.  Estimates of
distinct values err by about ``1.04 / sqrt(2 ** LG)`` (1.6 %), and hardly up to some hundred values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.operators.windows import HOUR

#: Registers of a distinct-count sketch (a power of two), and items that a frequency sketch tracks.
LG, TRACKED = 12, 2000


def per_slab(df: DataFrame, keys: Sequence[str], value: Column, us: str = "us", slab_us: int = HOUR) -> DataFrame:
    """``keys, slab, n, distinct_sketch, top_sketch`` of the non-null values in each slab of time; records without a time are left out.

    Tasks sketch their own records first, so a busy key is a row a task when it is shuffled.
    """
    rows = df.where(F.col(us).isNotNull()).select(*keys, F.floor(F.col(us) / slab_us).cast("bigint").alias("slab"), value.cast("string").alias("__value"))
    return rows.groupBy(*keys, "slab").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("__value", LG).alias("distinct_sketch"), F.expr(f"approx_top_k_accumulate(__value, {TRACKED})").alias("top_sketch")
    )


def merged(sketches: DataFrame, keys: Sequence[str], first_slab: Column | None = None, last_slab: Column | None = None) -> DataFrame:
    """The same for a span of slabs (both ends belong to it, null is open), a row a key; keys that are left out are merged too."""
    within = F.lit(True)
    if first_slab is not None:
        within = within & (F.col("slab") >= first_slab)
    if last_slab is not None:
        within = within & (F.col("slab") <= last_slab)
    return sketches.where(within).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.expr(f"approx_top_k_combine(top_sketch, {TRACKED})").alias("top_sketch")
    )


def estimates(sketches: DataFrame, keys: Sequence[str], most: int = 5) -> DataFrame:
    """``keys, n, distinct, top``: the number of different values, and the ``most`` frequent ones as an array of (item, count)."""
    top = F.expr(f"approx_top_k_estimate(top_sketch, {most})")
    return sketches.select(*keys, "n", F.hll_sketch_estimate("distinct_sketch").alias("distinct"), F.filter(top, lambda x: x["item"].isNotNull()).alias("top"))


def over_values(sketches: DataFrame, keys: Sequence[str], more_than: int) -> DataFrame:
    """Keys with more than ``more_than`` different values in what was merged: a first look that costs a row a key and slab."""
    return estimates(sketches, keys).where(F.col("distinct") > more_than)
