"""Reports and checks over findings and cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe.operators.findings import LEVELS
from huntframe.operators.windows import looking_back


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))


def severity_summary(found: DataFrame) -> DataFrame:
    """One row: ``p0`` to ``p3`` and ``total``."""
    return found.agg(*[F.count_if(F.col("severity") == v).alias(v.lower()) for v in LEVELS], F.count(F.lit(1)).alias("total"))


def daily_report(found: DataFrame, day: Column) -> DataFrame:
    """Counts by day, severity and category with all subtotals (``all``), and the busiest address of each."""
    rows = found.withColumn("day", day).groupBy("day", "severity", "category", "src_ip").agg(F.count(F.lit(1)).alias("n"))
    # Subtotals of the small table of counts, not of the findings.
    cube = rows.cube("day", "severity", "category").agg(F.sum("n").alias("hits"), F.max_by("src_ip", F.struct("n", "src_ip")).alias("top_ip"))
    return cube.na.fill("all", ["day", "severity", "category"])


def hours(found: DataFrame, us: str = "us") -> DataFrame:
    return found.groupBy(F.hour(F.timestamp_micros(us)).alias("hour")).agg(F.count(F.lit(1)).alias("hits"))


def worst(found: DataFrame, n: int = 30, ties: Sequence[str] = ("us", "src_file", "line_no", "rule_id")) -> DataFrame:
    """The ``n`` worst findings, earliest first: a top-k report."""
    return found.orderBy("severity", *ties).limit(n)


def document(found: DataFrame, n: int = 30, ties: Sequence[str] = ("id",)) -> DataFrame:
    """The head of a report as one JSON object: ``version, total``, counts by level and the ``n`` worst findings.

    The findings themselves are written as lines (``write_ndjson``): a report of any size stays a table.
    """
    rest = [c for c in found.columns if c not in ("severity", *ties)]
    top = found.orderBy("severity", *ties).limit(n).select(F.struct("severity", *ties, *rest).alias("finding"))
    # At most n + 1 rows meet here.
    both = severity_summary(found).unionByName(top, allowMissingColumns=True)
    counts = [v.lower() for v in LEVELS]
    head = both.agg(*[F.max(c).alias(c) for c in ("total", *counts)], F.array_sort(F.collect_list("finding")).alias("findings"))
    return head.select(F.to_json(F.struct(F.lit("0.1").alias("version"), "total", *counts, "findings")).alias("report"))


def paths_in_order(nodes: DataFrame, path: str, position: str, ts: str) -> DataFrame:
    """Attack paths with the number of nodes that come before their predecessor in time."""
    numbered = nodes.withColumn("__us", F.col(position).cast("bigint"))
    marked = looking_back(numbered, [path], "__us", [position], 1, lambda w: {"__before": F.lag(ts).over(w)})
    wrong = F.count_if(F.col(ts) < F.col("__before"))
    return marked.groupBy(path).agg(F.count(F.lit(1)).alias("nodes"), wrong.alias("out_of_order"))


def dangling(nodes: DataFrame, found: DataFrame, ref: str = "finding_ref") -> DataFrame:
    """Path nodes that refer to a finding that isn't there."""
    return nodes.join(found.select(F.col("id").alias(ref)).distinct(), ref, "left_anti")


def first_by_tactic(nodes: DataFrame, path: str, tactic: str, ts: str) -> DataFrame:
    """At most one node a tactic and path: the first."""
    order = Window.partitionBy(path, tactic).orderBy(ts)
    return nodes.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def completeness(found: DataFrame, share: float = 0.9) -> DataFrame:
    """One row of checks: no output, findings without key fields, and one address with over ``share`` of all."""
    sources = found.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule_id").isNull() | F.col("severity").isNull()).alias("bare"))
    return sources.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("findings"),
        F.coalesce(F.sum("bare"), F.lit(0)).alias("without_key_fields"),
        F.coalesce(F.max("n") > share * F.sum("n"), F.lit(False)).alias("one_source"),
    )


def dwell(found: DataFrame, verdict_us: Column, keys: Sequence[str] = ("src_ip",)) -> DataFrame:
    """Seconds from the first evidence of a key to the verdict."""
    return found.groupBy(*keys).agg(F.min("us").alias("first_us")).withColumn("dwell_s", (verdict_us - F.col("first_us")) / F.lit(1e6))


def write_ndjson(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a row, null fields too."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The columns with a header; null is empty, and quotes are doubled, as spreadsheets and ``read_csv_files`` want them."""
    df.select(*[F.col(c).cast("string") for c in columns]).write.csv(path, header=True, nullValue="", emptyValue="", escape='"')


def append_audit(audit: DataFrame, path: str) -> None:
    write_ndjson(audit, path, "append")
