"""Exact deduplication by content sort, in DataFrame operations only.

Splitters that Spark samples range-partition the normalised texts, an external sort puts
equal texts next to each other, and each row is compared in full with its neighbour.  The
row with the smallest ``doc_id`` of a run stays.

* The splitters are (first 64 characters, 64-bit hash, salt): of bounded length however
  long the texts are.  Comparison is always over the whole text.
* A text that many rows share is salted into parts of bounded size, so a third of all rows
  with one text is sorted by many tasks.  The list of such texts has at most
  ``4 x partitions`` hashes, which is what bounds the broadcasts.
* A row learns its group from the run it stands in, where it stands.  Only the parts of salted
  texts meet again, as rows of (SHA-256, smallest id, count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe.llm.store import partitions, written

SPACE = "[\\x20\\x09-\\x0D]+"
#: A text is hot from this many copies on, or from its share of a quarter of a partition.
HOT_ROWS = 200


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def _hot_texts(rows: DataFrame) -> tuple[DataFrame, int]:
    """(h, n) of the hashes of ``norm`` that more rows have than the limit, and the limit."""
    counts = written(rows.groupBy(F.xxhash64("norm").alias("h")).agg(F.count(F.lit(1)).alias("n")), "dedup-counts")
    limit = max(HOT_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) // (4 * partitions(rows.sparkSession)))
    return counts.where(F.col("n") > limit), limit


#: Rows that are next to each other after the sort.
_PLACE = ("head", "h", "salt")


def _sorted(rows: DataFrame, hot: DataFrame, limit: int, *ties: Column) -> DataFrame:
    """``rows`` (``doc_id, norm`` and others) in the order of their texts, with ``head, h, salt, hot, starts, run``.

    Comparing a row with its neighbour alone says where a run of equal texts begins (``starts``).
    """
    parts = F.ceil(F.col("n") / F.lit(limit)).cast("long")
    # Not by id alone: a hot text's rows may all have one id, or none.
    nth = F.xxhash64("doc_id", F.lit(7)) % F.lit(1 << 31) + F.monotonically_increasing_id() % F.lit(1 << 31)
    salt = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(nth, parts))
    ranged = (
        rows.withColumn("h", F.xxhash64("norm"))
        .join(F.broadcast(hot), "h", "left")
        .withColumns({"head": F.substring("norm", 1, 64), "salt": salt.cast("long"), "hot": F.col("n").isNotNull()})
        .drop("n")
        .repartitionByRange(partitions(rows.sparkSession), *_PLACE)
    )
    place = Window.partitionBy(*_PLACE).orderBy("norm", F.col("doc_id").asc_nulls_last(), *ties)
    before = F.lag("norm").over(place)
    starts = ranged.withColumn("starts", before.isNull() | (before != F.col("norm")))
    return starts.withColumn("run", F.sum(F.col("starts").cast("long")).over(place))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null texts are empty texts.  A null ``doc_id`` loses against any other; where all ids of
    a group are null, ``keep_id`` is null and one row stays.  Of rows repeated with the same
    id and text one stays.  Other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    found = _sorted(rows, *_hot_texts(rows))
    # Texts are left behind, their digest is taken once a run; a run's rows are still where they were.
    light = found.select(*_PLACE, "doc_id", "hot", "run", F.col("starts").alias("kept"), F.when(F.col("starts"), F.unhex(F.sha2("norm", 256))).alias("sha"))
    run = Window.partitionBy(*_PLACE, "run")
    members = written(
        light.select(
            "doc_id",
            "hot",
            "salt",
            "kept",
            F.max("sha").over(run).alias("sha"),
            F.min("doc_id").over(run).alias("keep_id"),
            F.count(F.lit(1)).over(run).alias("group_size"),
        ),
        "dedup-members",
    )

    # The parts of a hot text meet as one row each; of parts with the same smallest id the first has the row that stays.
    first = F.min(F.struct(F.col("keep_id").isNull().alias("none"), "keep_id", "salt")).alias("first")
    parted = members.where("hot AND kept").groupBy("sha").agg(first, F.sum("group_size").alias("all"))
    whole = members.where("NOT hot").select("doc_id", "keep_id", "group_size", "kept", "sha")
    split = members.where("hot").join(F.broadcast(parted), "sha").select(
        "doc_id",
        F.col("first.keep_id").alias("keep_id"),
        F.col("all").alias("group_size"),
        (F.col("kept") & (F.col("salt") == F.col("first.salt"))).alias("kept"),
        "sha",
    )
    return whole.unionByName(split).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def distinct(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with their columns as they were.

    Rows are sorted once and stay where they are.  Of rows with one id and equal texts that of
    the smallest hash of the text stays.  Rows of a hot text aren't sorted at all: each task
    keeps the first of its own, and one row a hot text and task meets.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"), own)
    hot, limit = _hot_texts(rows.select("norm"))
    known = F.broadcast(hot.select("h"))
    hashed = rows.withColumn("h", F.xxhash64("norm"))
    others = hashed.join(known, "h", "left_anti").drop("h")
    kept = _sorted(others, hot, limit, F.xxhash64("row.text")).where("starts").select("row.*")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("row.text").alias("text"))
    first = hashed.join(known, "h", "left_semi").groupBy(F.sha2("norm", 256)).agg(F.min_by("row", place).alias("row"))
    return kept.unionByName(first.select("row.*"))
