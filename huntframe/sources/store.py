"""Tables in the shared folder, and normalised records as Parquet, so that every rule reads only its own rows and columns.

Detectors with a memory are operators of their own, each with its filter; on a table that is
partitioned by kind of record and day, Spark prunes to the folders that a filter needs, and
reads only the columns that the rule uses.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_KEYS, FLOW_KEYS, EVENT_KEYS = ("log_type", "day"), ("view", "day"), ("channel", "day")


SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that ``spark.checkpoint.dir`` names.

    Where it is unset the folder is a local one, but only on a single machine (tests): a cluster without it is an error.
    """
    named = spark.conf.get(SETTING, None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all machines share")
        app = spark.conf.get("spark.app.id")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="huntframe-")
        named = _own[app]
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def translated(uri: str) -> str:
    """A name that Spark reads as Arrow's file systems name it: ``s3a`` and ``s3n`` are ``s3``, ``dbfs`` is a mounted folder."""
    scheme, _, rest = uri.partition(":")
    return f"s3:{rest}" if scheme in ("s3a", "s3n") else f"/dbfs/{rest.lstrip('/')}" if scheme == "dbfs" else uri


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path for a name that Spark reads."""
    return pafs.FileSystem.from_uri(translated(uri))


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df`` written to the shared folder and read again.

    What is used twice is computed once, no executor's loss reaches behind it, and a join with it
    is one of two tables, of which Spark can split a key that has very many rows: beside an
    aggregate that is still being made it can't.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many tasks as there are shuffle partitions, or cores if these are more; adaptive execution leaves the number as it is.

    For rows of few bytes and much work: a table of one small file would be one task, and after a
    shuffle that Spark counts itself, few.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def write_records(df: DataFrame, path: str, keys: Sequence[str] = LOG_KEYS, ts: str = "ts", mode: str = "append") -> None:
    """Append records in folders by ``keys``; ``day`` is the date of ``ts``, and records without one have none.

    Rebalanced by the keys: Spark splits a kind with very many records over several tasks and
    puts small ones together, so there are neither huge nor tiny files.
    """
    if "day" in keys:
        day = F.to_date(ts) if dict(df.dtypes)[ts] == "timestamp" else F.substring(ts, 1, 10)
        df = df.withColumn("day", day)
    df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).option("compression", "zstd").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
