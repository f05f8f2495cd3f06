"""Streams run to their end over a table; the rows they give are those of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.operators.windows import DAY
from huntframe.plans.base import query, table
from huntframe.sources.store import new_folder
from huntframe.streaming import detect, state

LATE = "2 days"
#: Of the streams over the driver's tables, at least; the cores if these are more.  A stream of its own size sets its own.
PARTITIONS = 4


def _own(spark: SparkSession) -> tuple[SparkSession, str]:
    """A session and a folder of a stream's own: a stream's checkpoint fixes the number of shuffle partitions for its life."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", max(PARTITIONS, spark.sparkContext.defaultParallelism))
    return own, new_folder(spark, "stream")


def _events(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """Events as a stream of files, all there when it starts; a last row far ahead lets the watermark pass the others."""
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    last = rows.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("event_id"), F.expr("ts + INTERVAL 30 DAYS").alias("ts"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"))
    rows.unionByName(last).write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


def _run(spark: SparkSession, result: DataFrame, folder: str) -> DataFrame:
    detect.run_to_end(result, f"{folder}/state", f"{folder}/out")
    return spark.read.schema(result.schema).parquet(f"{folder}/out")


@query("stream_buckets", "SELECT strftime(ts, '%Y-%m-%d') AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_buckets(spark, sf):
    own, folder = _own(spark)
    made = detect.bucket_counts(_events(own, sf, folder), "1 day", LATE, ("event_type",))
    return _run(spark, made, folder).where("event_type <> 'end'").select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "event_type", "n")


@query(
    "stream_burst",
    f"""WITH d AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events WHERE event_type = 'error'), c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) -
      coalesce(count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY + 1} PRECEDING), 0) AS n FROM d)
    SELECT CAST(user_id AS VARCHAR) AS key, us, n FROM c WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us) = 1""",
)
def stream_burst(spark, sf):
    own, folder = _own(spark)
    errors = _events(own, sf, folder).where("event_type = 'error'")
    found = _run(spark, detect.bursts(errors, "user_id", DAY, 3, LATE), folder)
    return found.select("key", F.unix_micros("ts").alias("us"), "n")


@query("stream_indicators", "SELECT event_id FROM events WHERE user_id IN (SELECT n_nationkey FROM nation)")
def stream_indicators(spark, sf):
    own, folder = _own(spark)
    known = table(own, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("value"))
    return _run(spark, detect.with_indicators(_events(own, sf, folder), known, "user_id").select("event_id"), folder)


@query("stream_first_sights", "SELECT user_id FROM events GROUP BY user_id")
def stream_first_sights(spark, sf):
    own, folder = _own(spark)
    firsts = detect.first_sights(_events(own, sf, folder).where("user_id >= 0"), ("user_id",), "400 days")
    return _run(spark, firsts.select("user_id"), folder)


@query(
    "stream_sessions",
    """WITH d AS (SELECT user_id, ts, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 43200000000 AS INT), 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM d)
    SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + 43200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, nth""",
)
def stream_sessions(spark, sf):
    own, folder = _own(spark)
    made = _run(spark, detect.sessions(_events(own, sf, folder), "12 hours", LATE, ("user_id",)), folder)
    return made.where("user_id >= 0").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


_RULES = state.Rules(last=6, at_least=4, cv_under=0.5, mean_over=5.0, more_values_than=9)


@query(
    "stream_key_rules",
    f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_id % 40 AS v FROM events), d AS (SELECT *, (us - lag(us) OVER w) / 1e6 AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    c AS (SELECT *, count(gap) OVER f AS n, avg(gap) OVER f AS mean, stddev_pop(gap) OVER f AS sd FROM d WINDOW f AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN {_RULES.last - 1} PRECEDING AND CURRENT ROW)),
    b AS (SELECT * FROM c WHERE n >= {_RULES.at_least} AND mean > {_RULES.mean_over} AND sd / mean < {_RULES.cv_under} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) = 1),
    f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, v ORDER BY us, event_id) = 1),
    g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) = {_RULES.more_values_than + 1})
    SELECT CAST(user_id AS VARCHAR) AS key, 'beacon' AS rule, us, event_id FROM b UNION ALL SELECT CAST(user_id AS VARCHAR), 'values', us, event_id FROM g""",
)
def stream_key_rules(spark, sf):
    """Two rules with timers on one key's state: even intervals, and many different values."""
    own, folder = _own(spark)
    value = F.col("event_id") % 40
    made = state.key_rules(_events(state.with_timers(own), sf, folder), F.col("user_id"), F.lit(None), value, F.col("event_id"), LATE, _RULES)
    return _run(spark, made, folder).where("key <> '-1'").select("key", "rule", "us", F.col("nth").alias("event_id"))


@query(
    "stream_follow_ups",
    f"""SELECT a.event_id, b.event_id AS other_id FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND epoch_us(b.ts) > epoch_us(a.ts) AND epoch_us(b.ts) <= epoch_us(a.ts) + {DAY}
    WHERE a.event_type = 'error'""",
)
def stream_follow_ups(spark, sf):
    """Each error with its user's purchases of the next day, from two streams; errors that none follow come out when their day has passed."""
    own, folder = _own(spark)
    rows = _events(own, sf, folder)
    again = own.readStream.schema(rows.schema).parquet(f"{folder}/in")
    made = state.within(rows.where("event_type IN ('error', 'end')"), again.where("event_type IN ('purchase', 'end')"), "user_id", "1 DAY", LATE)
    return _run(spark, made, folder).where("event_type = 'error'").select("event_id", F.col("other_event_id").alias("other_id"))
