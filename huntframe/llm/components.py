"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.llm.store import drop, written


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    """Per vertex u of (u, v): the smallest of u and its neighbours; aggregated before the shuffle.

    Written, so that the join with it is one of two tables: Spark splits the edges of a vertex
    that has very many, as it can't where the other side is still being aggregated.
    """
    return written(edges.groupBy("u").agg(F.min("v").alias("v0")).select("u", F.least("u", "v0").alias("m")), "neighbours")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours are tied to the smallest vertex it sees."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex's smaller neighbours, and itself, are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    small = _smallest_neighbour(down)
    return down.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        small.select("u", F.col("m").alias("v"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(u, label) for every vertex of the edges (u, v) but the labels themselves; label is the
    component's smallest vertex.

    Alternates the two star steps until the table stays the same.  Every round is written to
    the shared folder, so no round depends on another's executors; nothing is collected but
    one count and one checksum a round.
    """
    spark = edges.sparkSession
    now = written(edges.select("u", "v").where("u != v").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            return now.select("u", F.col("v").alias("label"))
        seen = tuple(mark)
        after = written(_small_star(_large_star(now)).where("u != v").distinct(), "edges")
        drop(spark, now)
        now = after
