"""The training-data pipeline: documents through five of the operators, one after the other.

Each stage takes what the stage before kept.  All but the last return the columns of
``documents``; the mix repeats a document as often as it takes it, and the last stage returns
the encoded tokens of each row that is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.llm import bpe, exact_dedup, mixing, queries, simhash, toxicity
from huntframe.llm.store import written


def with_rows(docs: DataFrame, kept: DataFrame, digest: Column) -> DataFrame:
    """Of the documents whose id (null included) and text digest are in ``kept`` (``doc_id, digest``), one row each, whatever
    their columns are called.

    The first row of each id and text is found before the join, so repeated rows go within the tasks that read them.
    """

    def key(digest: Column) -> Column:
        return F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(" "), digest)

    mine = kept.select(key(F.col("digest")).alias("__kept"))
    first = Window.partitionBy("__row").orderBy(F.xxhash64("text"))
    one = docs.withColumn("__row", key(digest)).withColumn("__copy", F.row_number().over(first)).where("__copy = 1")
    return one.join(mine, F.col("__row") == F.col("__kept"), "left_semi").drop("__copy", "__row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, chain)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return exact_dedup.distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays; of its texts, if it has several there, the one of the smallest digest."""
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    rows = simhash.near_components(docs, digest).where("doc_id <=> component_id")
    kept = rows.groupBy("label").agg(F.first("component_id").alias("doc_id"), F.min("digest").alias("digest"))
    return with_rows(docs, kept, digest)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mixed(docs).where("mix_copies > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))
    return taken.withColumn("mix_size", times).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row its number of tokens and the digests of its ids and of their decoding."""
    return bpe.digests(docs, queries.vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]

#: The first, third and last stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
