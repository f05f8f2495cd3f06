"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source's documents stand in a fixed order.  The running sum of their expected copies,
plus one random offset a source, is taken; a document is emitted once for each integer the
sum crosses at it.  The order goes by cells of about ``CELL_ROWS`` documents (by a hash of
the id), and by size inside a cell: ranks inside the cells are counted in parallel, and a
running sum over the cells' counts - a few rows a source - makes them ranks of the source.
A source with a third of all rows is therefore many cells.  Rows repeated with one id, or without
one, would be one cell: such cells are found by their counts and cut finer, in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe.llm.store import written

WORD = "[^\\x20\\x09-\\x0D]+"
#: Fixed, not taken from the cluster's settings: reruns agree on any cluster.
CELL_ROWS, MOST_CELLS = 500, 65536
#: A cell with so many times the rows it should have holds repeated ids; its rows are dealt by size, id and chunks of 2 ** CHUNK_BITS rows.
CROWDED, CHUNK_BITS = 8, 13
SEED = 20240
#: A table of sources is broadcast up to this many rows, of some 100 bytes each.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _random(text: Column) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the text alone."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _sums_before(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds ``at``, which ascends in the (total) order, and per name the sum of a column over all rows before.

    Sampled ranges are sorted and summed each on its own; only a row a range is summed in one task.
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "mix-order")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    starts = parts.select("part", *[F.coalesce(F.sum(n).over(ranges), F.lit(0)).alias(f"start_{n}") for n in sums])
    found = placed.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(starts), "part")
    return found.withColumns({n: F.col(n) + F.col(f"start_{n}") for n in sums}).drop("part", *[f"start_{n}" for n in sums])


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """From (source, source_size, n_docs), a row a source: adds ``target`` and ``copies_each``.

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; they share the total by weight.
    A target stops at ``most`` times its source's size, and what is above is shared again.
    In the order of size per weight the capped sources come first, so running sums find
    the share at which the rest is not above its cap: one number, as are the totals.  There may be
    as many sources as documents.
    """
    last = F.col("source").asc_nulls_last()
    numbered = _sums_before(sizes.withColumn("one", F.lit(1).cast("long")), [last], {"before": "one"}).drop("one", "at")
    ranked = numbered.withColumns({"weight": F.col("before") % 3 + 1, "cap": F.lit(most) * F.col("source_size")}).drop("before")
    line = _sums_before(ranked, [(F.col("cap") / F.col("weight")).asc(), last], {"caps": "cap", "weights": "weight"})
    size, weight = (n or 0 for n in line.agg(F.sum("source_size"), F.sum("weight")).first())
    shared = line.withColumn("share", (F.lit(size).cast("long") - F.col("caps")) / (F.lit(weight).cast("long") - F.col("weights")))
    free = shared.where(F.col("share") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct("at", "share")).alias("first")).first().first
    capped = F.col("cap").cast("double")
    target = capped if free is None else F.when(F.col("at") < free["at"], capped).otherwise(F.lit(free["share"]) * F.col("weight"))
    return shared.withColumn("target", target).withColumn(
        "copies_each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ).select("source", "source_size", "n_docs", "target", "copies_each")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies`` added.

    ``mix_copies`` is how often the mix takes the row, 0 to 3.  Null and wordless texts have
    size 0 and take part in the count of copies; a source without words has target 0 and is
    not taken.  A null source is a source.  Rows repeated with one id count apart.  The
    other columns are carried along; those with the four names above are replaced.
    """
    names = [c for c in docs.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_copies")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    sized = docs.select(
        row,
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        word_count(F.col("text")).alias("size"),
    )
    return _copies(sized, seed).select(
        "row.*",
        F.col("size").alias("mix_size"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.col("copies").alias("mix_copies"),
    )


def mix_sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The same decisions without the rows' other columns: ``doc_id, size, source_size, target, copies``."""
    sized = docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        word_count(F.col("text")).alias("size"),
    )
    return _copies(sized, seed).select("doc_id", "size", "source_size", "target", "copies")


def _copies(sized: DataFrame, seed: int) -> DataFrame:
    # A key without nulls, so that one hash partitioning serves the window and the joins.
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    sized = sized.withColumn("key", key)
    n_cells = F.least(F.lit(MOST_CELLS), F.ceil(F.col("n_docs") / F.lit(CELL_ROWS))).cast("long")
    sources = written(
        source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
        .withColumn("key", key)
        .withColumn("n_cells", n_cells)
        .withColumn("offset", _random(F.concat(F.lit(f"{seed}:"), F.col("key"))) / F.lit(4294967296.0))
        .drop("source"),
        "mix-sources",
    )
    few = sources.count() <= BROADCAST_SOURCES
    spread = _random(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    def with_source(df: DataFrame, *columns: str) -> DataFrame:
        """A broadcast only of a table whose rows were counted; else a join that Spark splits where it is skewed."""
        right = sources.select("key", *columns)
        return df.join(F.broadcast(right) if few else right.hint("merge"), "key")

    def in_cells(df: DataFrame) -> DataFrame:
        return with_source(df, "n_cells").withColumn("cell", F.pmod(spread, F.col("n_cells"))).drop("n_cells")

    rows = in_cells(sized).drop("source")
    counted = written(in_cells(sized.select("key", "doc_id")).groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    crowded = with_source(counted, "n_docs", "n_cells").where(F.col("n") > CROWDED * F.greatest(F.lit(CELL_ROWS), F.col("n_docs") / F.col("n_cells"))).select("key", "cell")
    n_crowded = crowded.count()
    whole = {"at_size": F.lit(-1), "no_id": F.lit(False), "at_id": F.lit(0).cast("long"), "chunk": F.lit(0).cast("long")}
    cells = counted.withColumns(whole)
    if n_crowded:
        crowded = F.broadcast(crowded) if n_crowded <= BROADCAST_SOURCES else crowded.hint("merge")
        finer = {"at_size": F.col("size"), "no_id": F.col("doc_id").isNull(), "at_id": F.coalesce("doc_id", F.lit(0)), "chunk": F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)}
        # written, so that a chunk has the same rows when they are counted and when they are dealt
        split = written(rows.join(crowded, ["key", "cell"], "left_semi").withColumns(finer), "mix-crowded")
        rows = rows.join(crowded, ["key", "cell"], "left_anti")
        counts = split.groupBy("key", "cell", *whole).agg(F.count(F.lit(1)).alias("n"))
        cells = cells.join(crowded, ["key", "cell"], "left_anti").unionByName(counts)
    so_far = Window.partitionBy("key").orderBy("cell", *whole).rowsBetween(Window.unboundedPreceding, -1)
    cells = with_source(
        cells.withColumn("start", F.coalesce(F.sum("n").over(so_far), F.lit(0))), "source_size", "target", "copies_each", "offset"
    ).drop("n")
    at = F.col("start") + F.col("rank")

    def dealt(part: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
        inside = Window.partitionBy(*keys).orderBy("size", F.col("doc_id").asc_nulls_last())
        ranked = part.repartition(*map(F.col, keys)).withColumn("rank", F.row_number().over(inside) - 1)
        return ranked.join(starts, keys).withColumn(
            "copies",
            F.floor((at + 1) * F.col("copies_each") + F.col("offset")) - F.floor(at * F.col("copies_each") + F.col("offset")),
        )

    if not n_crowded:
        return dealt(rows, cells.drop(*whole), ["key", "cell"])
    cells = written(cells, "mix-starts")
    normal = dealt(rows, cells.where("at_size < 0").drop(*whole), ["key", "cell"])
    return normal.unionByName(dealt(split, cells.where("at_size >= 0"), ["key", "cell", *whole]).drop(*whole))
