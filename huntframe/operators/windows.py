"""Ordered operators that no single key can overload.

A plain window ``PARTITION BY key ORDER BY time`` puts all rows of a key into one task, and in
logs one address may have a third of them.  Here time is cut into slabs: a task gets one key's
rows of one slab, with the few rows before the slab that it needs, and what must be carried
from slab to slab is first aggregated to one row a slab.

Order is by ``us`` (microseconds) and then by ``ties``, which must make it total.  Keys must
not be null; rows with a null ``us`` are left out by every operator that looks at time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from huntframe.sources.store import settled

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
#: Longer windows than this are not cut into slabs of several windows.
LONG = 2 * HOUR
_FIRST, _HERE = Window.unboundedPreceding, Window.currentRow


def _slab(us: str, size: int) -> Column:
    return F.floor(F.col(us) / size).cast("bigint")


def trailing(
    df: DataFrame, keys: Sequence[str], us: str, ties: Sequence[str], window_us: int, sums: dict[str, Column], slab_us: int | None = None
) -> DataFrame:
    """Adds, for each name in ``sums``, its whole-number sum over the rows of the key so far that are
    at most ``window_us`` old; a row counts itself, rows after it at the same time don't.

    This is the length of a queue that is appended to and trimmed at the front.  A task gets a key's
    rows of a few windows; where the window is longer than ``LONG`` it gets those of an hour instead:
    each row counts from its time on and is taken off again when the window has passed.
    """
    if window_us > LONG and slab_us is None:
        return _arriving_and_leaving(df, keys, us, ties, window_us, sums)
    size = max(window_us, slab_us or 8 * window_us)
    own = _slab(us, size)
    needed_next = F.col(us) >= (own + 1) * size - window_us
    rows = (
        df.where(F.col(us).isNotNull())
        .withColumns({f"__v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
        .withColumn("__own", own)
        .withColumn("__slab", F.explode(F.when(needed_next, F.array(own, own + 1)).otherwise(F.array(own))))
    )
    part = [*keys, "__slab"]
    so_far = Window.partitionBy(*part).orderBy(us, *ties).rowsBetween(_FIRST, _HERE)
    too_old = Window.partitionBy(*part).orderBy(us).rangeBetween(_FIRST, -(window_us + 1))
    out = {n: F.sum(f"__v_{n}").over(so_far) - F.coalesce(F.sum(f"__v_{n}").over(too_old), F.lit(0)) for n in sums}
    return rows.withColumns(out).where("__own = __slab").drop("__own", "__slab", *[f"__v_{n}" for n in sums])


def _arriving_and_leaving(df: DataFrame, keys: Sequence[str], us: str, ties: Sequence[str], window_us: int, sums: dict[str, Column]) -> DataFrame:
    """``trailing`` as running sums; at equal times rows leave before others arrive."""
    rows = df.where(F.col(us).isNotNull()).withColumns({f"__w_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    moves = F.array(F.struct(F.lit(1).alias("sign"), F.col(us).alias("at")), F.struct(F.lit(-1).alias("sign"), (F.col(us) + window_us + 1).alias("at")))
    moved = rows.withColumn("__move", F.explode(moves)).withColumns({"__sign": F.col("__move.sign"), "__at": F.col("__move.at")})
    counted = running(moved, keys, "__at", ["__sign", *ties], {n: F.col(f"__w_{n}") * F.col("__sign") for n in sums})
    return counted.where("__sign = 1").drop("__move", "__sign", "__at", *[f"__w_{n}" for n in sums])


def running(df: DataFrame, keys: Sequence[str], us: str, ties: Sequence[str], sums: dict[str, Column], slab_us: int = HOUR) -> DataFrame:
    """Adds, for each name, its sum over all rows of the key so far."""
    part = [*keys, "__slab"]
    rows = df.where(F.col(us).isNotNull()).withColumn("__slab", _slab(us, slab_us)).withColumns({f"__v_{n}": c for n, c in sums.items()})
    slabs = rows.groupBy(*part).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("__slab").rowsBetween(_FIRST, -1)
    starts = slabs.select(*part, *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy(*part).orderBy(us, *ties).rowsBetween(_FIRST, _HERE)
    rows = rows.withColumns({n: F.sum(f"__v_{n}").over(inside) for n in sums})
    joined = rows.join(starts, part).withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in sums})
    return joined.drop("__slab", *[f"__v_{n}" for n in sums], *[f"__b_{n}" for n in sums])


def ranked(df: DataFrame, order: Sequence[str], name: str = "nth") -> DataFrame:
    """Adds the row's number in the whole table, from 1 on, in an order that must be total.

    Sampled ranges are sorted each on its own; a range's rows are counted, and only the counts,
    one row a range, are added up in one task.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of the range in the upper 31 bits, the place in it in the lower 33.
    placed = settled(parts.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(_FIRST, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__before")))
    nth = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("__part", part).join(starts, "__part").withColumn(name, nth).drop("__at", "__part", "__before")


def numbered(df: DataFrame, keys: Sequence[str], us: str, ties: Sequence[str], name: str = "nth", slab_us: int = HOUR) -> DataFrame:
    """Adds the row's number within its key, from 1 on; ``ranked`` numbers a whole table."""
    return running(df, keys, us, ties, {name: F.lit(1).cast("bigint")}, slab_us)


def looking_back(
    df: DataFrame,
    keys: Sequence[str],
    us: str,
    ties: Sequence[str],
    rows: int,
    made: Callable[[WindowSpec], dict[str, Column]],
    chunk: int = 100_000,
    slab_us: int = HOUR,
) -> DataFrame:
    """Adds window columns that need at most ``rows`` rows before theirs.

    ``made`` gets the window (partitioned and ordered) and returns the columns.  Rows are
    numbered and cut into chunks; each chunk also gets the last rows of the chunk before.
    """
    chunk = max(chunk, rows)
    at = F.col("__nth") - 1
    own = F.floor(at / chunk).cast("bigint")
    held = numbered(df, keys, us, ties, "__nth", slab_us).withColumn("__own", own)
    held = held.withColumn("__chunk", F.explode(F.when(at % chunk >= chunk - rows, F.array(own, own + 1)).otherwise(F.array(own))))
    order = Window.partitionBy(*keys, "__chunk").orderBy("__nth")
    return held.withColumns(made(order)).where("__own = __chunk").drop("__nth", "__own", "__chunk")


def first_rows(df: DataFrame, keys: Sequence[str], us: str, ties: Sequence[str]) -> DataFrame:
    """Each key's first row.  One row a key and task is shuffled, with the columns that are used later only."""
    return nth_rows(df, keys, us, ties, 1)


def nth_rows(df: DataFrame, keys: Sequence[str], us: str, ties: Sequence[str], n: int) -> DataFrame:
    """Each key's row number ``n``; only the first ``n`` rows of a key and task are shuffled."""
    order = Window.partitionBy(*keys).orderBy(us, *ties)
    return df.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= n).where(F.col("__nth") == n).drop("__nth")


def first_over(df: DataFrame, keys: Sequence[str], us: str, ties: Sequence[str], condition: Column) -> DataFrame:
    """Each key's first row for which ``condition`` holds: what is reported once per key."""
    return first_rows(df.where(condition), keys, us, ties)


def burst(df: DataFrame, keys: Sequence[str], us: str, ties: Sequence[str], window_us: int, at_least: int, count: str = "n") -> DataFrame:
    """Each key's first row at which ``at_least`` rows lie within ``window_us``, with their number."""
    counted = trailing(df, keys, us, ties, window_us, {count: F.lit(1).cast("bigint")})
    return first_over(counted, keys, us, ties, F.col(count) >= at_least)


def distinct_over(df: DataFrame, keys: Sequence[str], value: str, us: str, ties: Sequence[str], more_than: int) -> DataFrame:
    """Each key's row at which its number of different values first exceeds ``more_than``."""
    firsts = first_rows(df.where(F.col(value).isNotNull()), [*keys, value], us, ties)
    return nth_rows(firsts, keys, us, ties, more_than + 1)


def after_first(df: DataFrame, marks: DataFrame, keys: Sequence[str], us: str, ties: Sequence[str], at: str, within_us: int) -> DataFrame:
    """Rows after their key's mark and at most ``within_us`` later; ``marks`` has one row a key: the keys, ``at``, and the ties of the mark.

    The mark's time stays in the column ``at``.  ``marks`` should be ``settled``, so that a busy key's rows can be split.
    """
    names = [f"__m_{t}" for t in ties]
    right = marks.select(*keys, F.col(at), *[F.col(t).alias(n) for t, n in zip(ties, names, strict=True)])
    later = F.struct(F.col(us), *[F.col(t) for t in ties]) > F.struct(F.col(at), *[F.col(n) for n in names])
    return df.join(right, list(keys)).where(later & (F.col(us) - F.col(at) <= within_us)).drop(*names)


def as_of(
    df: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    within_us: int,
    value: str,
    name: str,
    forward: bool = True,
    outer: bool = False,
    us: str = "us",
    slab_us: int = HOUR,
) -> DataFrame:
    """As-of join: adds the ``value`` (as ``name``) and time (``name_us``) of the nearest mark of the row's keys that is
    later (``forward``) or earlier than the row, by at most ``within_us``; of marks at one time that of the smallest value.

    Both sides are put into one table and sorted once by key, slab and time; on the way through a
    slab the nearest mark so far is kept.  Where a slab's marks don't reach, the first mark of the
    next marked slab does: it is carried to the slabs that have rows, over one row a key and slab.  Rows
    without a mark, a key or a time are left out, or kept with nulls if ``outer``.  Columns of
    ``marks`` other than the keys, ``us`` and ``value`` are ignored.
    """
    size = min(within_us, slab_us)
    steps = -(-within_us // size)
    sign = 1 if forward else -1
    at = F.col(us).cast("bigint") * sign
    own_keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    part = [*(f"__k{i}" for i in range(len(keys))), "__slab"]
    known = F.col(us).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    slab = F.floor(F.col("__at") / size).cast("bigint")
    mark = F.struct(F.col("__at").alias("at"), F.col("__value").alias("value"))
    # rows: 0 before marks at the same time, which don't count for them
    rows = df.where(known).select(*own_keys, at.alias("__at"), F.struct("*").alias("__row")).withColumns({"__slab": slab, "__kind": F.lit(0)})
    seen = marks.where(known).select(*own_keys, at.alias("__at"), F.col(value).alias("__value")).withColumns({"__slab": slab, "__kind": F.lit(1)})
    seen = seen.select(*part, "__kind", "__at", mark.alias("__mark"))
    held = rows.select(*part, F.lit(True).alias("__rows")).unionByName(seen.select(*part, "__mark"), allowMissingColumns=True)
    slabs = held.groupBy(*part).agg(F.max("__rows").alias("__rows"), F.min(F.when(F.col("__mark").isNotNull(), F.struct("__slab", "__mark"))).alias("__first"))
    after = Window.partitionBy(*part[:-1]).orderBy(F.col("__slab").desc()).rowsBetween(_FIRST, -1)
    carried = slabs.withColumn("__next", F.last("__first", ignorenulls=True).over(after))
    carried = carried.where(F.col("__rows") & (F.col("__next.__slab") - F.col("__slab") <= steps))
    firsts = carried.select(*part, F.lit(1).alias("__kind"), F.col("__next.__mark.at").alias("__at"), F.col("__next.__mark").alias("__mark"))
    line = rows.unionByName(seen.unionByName(firsts), allowMissingColumns=True)
    so_far = Window.partitionBy(*part).orderBy(F.col("__at").desc(), "__kind").rowsBetween(_FIRST, _HERE)
    nearest = line.withColumn("__near", F.min("__mark").over(so_far)).where("__kind = 0")
    near = F.when(F.col("__near.at") - F.col("__at") <= within_us, F.col("__near"))
    out = nearest.withColumn("__near", near)
    out = out.select("__row.*", F.col("__near.value").alias(name), (F.col("__near.at") * sign).alias(f"{name}_us"))
    if not outer:
        return out.where(F.col(f"{name}_us").isNotNull())
    return out.unionByName(df.where(~F.coalesce(known, F.lit(False))), allowMissingColumns=True)


def followed_by(df: DataFrame, after: DataFrame, keys: Sequence[str], within_us: int, name: str) -> DataFrame:
    """Rows of ``df`` with a row of ``after`` later than they and at most ``within_us`` later: column ``next`` is the first one's ``name``."""
    return as_of(df, after, keys, within_us, name, "next").drop("next_us")
