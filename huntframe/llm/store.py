"""Tables and files of a running job, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from huntframe.sources.store import file_system

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}
#: Settings of a session that a session of its own takes over.
CARRIED = (
    "spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes",
)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    One of our own only where it is unset on a single machine (tests); a cluster without it is an error.
    """
    named = spark.conf.get(SETTING, None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all machines share")
        app = spark.conf.get("spark.app.id")
        named = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="huntframe-")
        _own[app] = named
    return named.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet in the shared folder; returns where.

    Zstandard, since most of these tables are read once or twice and hold digests and texts.
    """
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage durably."""
    path = write(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing will read it again.  Where this machine can't open the shared folder they stay."""
    top = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(top):
            try:
                fs, at = file_system(folder)
            except (pa.ArrowInvalid, OSError):
                continue
            fs.delete_dir(at)


def letting_go(spark: SparkSession) -> SparkSession:
    """A session in which the shuffle files of a finished query are deleted at once; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    for name in CARRIED:
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    return own


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
