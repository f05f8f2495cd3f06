"""All queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from huntframe.plans import auth, chains, context, grading, playbook, streams, tables, traffic, web, win
from huntframe.plans.base import QUERIES, SQL, Query

MODULES = (web, auth, win, traffic, context, grading, playbook, chains, streams, tables)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.FLAGSHIP(spark, sf_dir)
