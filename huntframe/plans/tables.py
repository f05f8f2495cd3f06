"""Large tables of rules beside the records, as-of joins, and packets made of the tables' rows, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntframe.operators import indicator_table, ranges, signatures, sketches
from huntframe.operators.windows import DAY, as_of
from huntframe.plans.base import Rendered, query, table
from huntframe.sources import pcap, reassembly
from huntframe.sources.store import settled

#: Orders as requests: an agent that names one of the parts' tools, an address that names a part's script.
REQUESTS = Rendered(
    "orders",
    {
        "ua": "CASE o_orderkey % 3 WHEN 0 THEN concat('Mozilla TOOL', o_custkey % 500, '/', o_orderkey % 10) WHEN 1 THEN concat('tool', o_custkey % 700, ' beta') ELSE '' END",
        "uri": "concat('/app', o_custkey % 900, CASE o_orderkey % 2 WHEN 0 THEN '.php' ELSE '.html' END, CASE o_orderkey % 5 WHEN 0 THEN '?id=7' ELSE '' END)",
    },
)


@query(
    "signature_table",
    f"""WITH {REQUESTS.sql('r')}, p AS (SELECT p_partkey AS k FROM part),
    h AS (SELECT o_orderkey, concat('A-', k) AS sig_id, 'ua' AS field FROM r JOIN p ON ua LIKE 'Mozilla%' AND k = o_custkey % 500 AND k % 3 < 2
      UNION ALL SELECT o_orderkey, concat('A-', k), 'ua' FROM r JOIN p ON ua LIKE 'tool%' AND k = o_custkey % 700 AND k % 3 = 2
      UNION ALL SELECT o_orderkey, concat('U-', k), 'uri' FROM r JOIN p ON k = o_custkey % 900 AND o_orderkey % 2 = 0)
    SELECT sig_id, field, count(*) AS hits, count(DISTINCT o_orderkey) AS records FROM h GROUP BY ALL""",
)
def signature_table(spark, sf):
    """Two signatures a part, all of them in one automaton a field; more parts make more signatures."""
    part = table(spark, sf, "part")
    agent = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit(r"^tool"), "p_partkey", F.lit(r"\s+beta$"))).otherwise(F.concat(F.lit(r"(?i)\btool"), "p_partkey", F.lit("/[0-9]")))
    rows = part.select(F.concat(F.lit("A-"), "p_partkey").alias("sig_id"), F.lit("ua").alias("field"), agent.alias("pattern"))
    rows = rows.unionByName(part.select(F.concat(F.lit("U-"), "p_partkey").alias("sig_id"), F.lit("uri").alias("field"), F.concat(F.lit(r"/app"), "p_partkey", F.lit(r"\.(?:php|jsp)\b")).alias("pattern")))
    found = signatures.hits(REQUESTS.spark(spark, sf).select("o_orderkey", "ua", "uri"), {"ua": F.col("ua"), "uri": F.col("uri")}, rows)
    return found.groupBy("sig_id", "field").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("o_orderkey").alias("records"))


def _as_of_sql(gap: str, order: str) -> str:
    return f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events),
    p AS (SELECT a.event_id, b.us AS other_us, b.event_id AS other_id FROM e a JOIN e b ON a.user_id = b.user_id AND b.event_type = 'error' AND {gap} > 0 AND {gap} <= {3 * DAY}
      WHERE a.event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.us {order}, b.event_id) = 1)
    SELECT e.event_id, other_us, other_id FROM e LEFT JOIN p ON e.event_id = p.event_id WHERE event_type = 'purchase'"""


def _near_errors(spark, sf, forward: bool):
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    found = as_of(rows.where("event_type = 'purchase'"), rows.where("event_type = 'error'"), ["user_id"], 3 * DAY, "event_id", "other_id", forward, outer=True)
    return found.select("event_id", F.col("other_id_us").alias("other_us"), "other_id")


@query("as_of_next", _as_of_sql("(b.us - a.us)", "ASC"))
def as_of_next(spark, sf):
    """Each purchase with its user's next error within three days, or none."""
    return _near_errors(spark, sf, True)


@query("as_of_last", _as_of_sql("(a.us - b.us)", "DESC"))
def as_of_last(spark, sf):
    """Each purchase with its user's last error within three days before, or none."""
    return _near_errors(spark, sf, False)


#: Orders as requests: their text, the address that sends it, and its place in the connection's stream.
WIRE = Rendered(
    "orders",
    {
        "text": """concat('GET /o/', o_orderkey, ' HTTP/1.1', chr(13), chr(10), 'Host: c', o_custkey % 50, '.example', chr(13), chr(10),
            'User-Agent: agent-', o_custkey % 7, chr(13), chr(10), chr(13), chr(10))""",
        "cut": "CAST(20 + o_orderkey % 30 AS INT)",
    },
)


def packets_of_orders(spark, sf):
    """Each order is a connection: a SYN, then two segments, the second sent first, and the first one twice, with a byte of the second."""
    rows = WIRE.spark(spark, sf).withColumn("isn", F.pmod(F.xxhash64("o_orderkey"), F.lit(1 << 32)))
    after = lambda n: F.pmod(F.col("isn") + 1 + n, F.lit(1 << 32))
    part = lambda at, seq, flags, data: F.struct(F.lit(at).alias("at"), seq.alias("seq"), F.lit(flags).alias("flags"), data.cast("binary").alias("data"))
    first, second = F.substring("text", F.lit(1), F.col("cut")), F.substring("text", F.col("cut") + 1, F.length("text"))
    more = F.substring("text", F.lit(1), F.col("cut") + 1)
    sent = F.array(part(0.0, F.col("isn"), "0x0002", F.lit("")), part(0.2, after(F.col("cut")), "0x0018", second), part(0.3, after(F.lit(0)), "0x0018", first), part(0.4, after(F.lit(0)), "0x0018", more))
    rows = rows.withColumn("p", F.explode(sent)).select(
        F.lit("orders").alias("src_file"), (F.col("o_orderkey") * 4 + F.round(F.col("p.at") * 10).cast("bigint")).alias("line_no"), (F.lit(1.7e9) + F.col("o_orderkey") + F.col("p.at")).alias("t"),
        F.concat(F.lit("10."), (F.col("o_orderkey") / 62500).cast("int"), F.lit("."), (F.col("o_orderkey") / 250).cast("int") % 250, F.lit("."), F.col("o_orderkey") % 250).alias("src_ip"), F.lit("10.255.0.1").alias("dst_ip"),
        (F.lit(1024) + F.col("o_custkey") % 60000).cast("int").alias("src_port"), F.lit(80).alias("dst_port"), F.lit("tcp").alias("proto"), "p.seq", F.lit(0).cast("bigint").alias("ack"), "p.flags", F.lit(40).alias("length"), "p.data",
    )
    none = {n: F.lit(None).cast(k) for n, k in (f.split(" ") for f in pcap.PACKET.split(", ")) if n not in rows.columns}
    return rows.withColumns(none)


@query(
    "packets_to_http",
    "SELECT concat('/o/', o_orderkey) AS uri, concat('c', o_custkey % 50, '.example') AS host, concat('agent-', o_custkey % 7) AS ua FROM orders",
)
def packets_to_http(spark, sf):
    """The http view of packets that are out of order, repeated and overlapping: one record a request."""
    found = reassembly.http(reassembly.messages(packets_of_orders(spark, sf)))
    return found.select("raw.uri", "raw.host", "raw.ua")


#: Orders as requests of addresses to hosts.
HOSTS = Rendered("orders", {"src_ip": "concat('10.0.', o_custkey % 200, '.', o_orderkey % 100)", "host": "concat('W', o_orderkey % 3, '.c', o_custkey, '.example.org')"})


@query(
    "indicator_table",
    f"""WITH {HOSTS.sql('h')}, i AS (SELECT 'ip' AS kind, concat('10.0.', c_custkey % 200, '.', c_custkey % 7) AS value FROM customer UNION SELECT 'domain', concat('*.c', c_custkey, '.example.org') FROM customer WHERE c_custkey % 3 = 0
      UNION SELECT 'domain', concat('w1.c', c_custkey, '.example.org') FROM customer WHERE c_custkey % 3 = 1)
    SELECT kind, value, count(*) AS n FROM h JOIN i ON (kind = 'ip' AND src_ip = value) OR (kind = 'domain' AND (lower(host) = value OR (starts_with(value, '*.') AND ends_with(lower(host), substr(value, 2))))) GROUP BY ALL""",
)
def indicator_hits(spark, sf):
    """As many indicators as there are customers, none of them on the driver."""
    customer = table(spark, sf, "customer")
    key = F.col("c_custkey")
    domain = F.concat(F.when(key % 3 == 0, F.lit("*.c")).otherwise(F.lit("w1.c")), key, F.lit(".example.org"))
    rows = customer.select(F.lit("ip").alias("type"), F.concat(F.lit("10.0."), key % 200, F.lit("."), key % 7).alias("value"))
    rows = rows.unionByName(customer.where(key % 3 < 2).select(F.lit("domain").alias("type"), domain.alias("value"))).withColumns({"confidence": F.lit("high"), "tag": F.lit("t")})
    found = indicator_table.hits(HOSTS.spark(spark, sf).select("o_orderkey", "src_ip", "host"), {"ip": F.col("src_ip"), "domain": F.col("host")}, rows)
    return found.groupBy(F.col("ioc.type").alias("kind"), F.col("ioc.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


#: Events as log-ins from addresses of all nations; a nation's range begins and ends anywhere.
LOG_INS = Rendered(
    "events",
    {
        "us": "{us}",
        "line_no": "event_id",
        "src_file": "'events'",
        "user": "concat('u', user_id)",
        "src_ip": "concat('10.', event_id * 7 % 27, '.', event_id % 250, '.', user_id % 256)",
    },
)
_PLACES = (
    "concat('10.', n_nationkey, '.0.', n_nationkey + 3) AS first_ip",
    "concat('10.', n_nationkey, '.', 200 + n_nationkey, '.77') AS last_ip",
    "CAST(n_nationkey * 3 - 40 AS DOUBLE) AS lat",
    "CAST(n_nationkey * 12 - 150 AS DOUBLE) AS lon",
)


@query(
    "plb_impossible_travel",
    f"""WITH {LOG_INS.sql('e')}, n AS (SELECT n_nationkey, CAST(n_nationkey * 3 - 40 AS DOUBLE) AS lat, CAST(n_nationkey * 12 - 150 AS DOUBLE) AS lon FROM nation),
    p AS (SELECT "user", us, line_no, lat, lon FROM e JOIN n ON n_nationkey = line_no * 7 % 27
      AND (line_no % 250) * 256 + user_id % 256 BETWEEN n_nationkey + 3 AND (200 + n_nationkey) * 256 + 77),
    q AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(us) OVER w AS us0 FROM p WINDOW w AS (PARTITION BY "user" ORDER BY us, line_no)),
    k AS (SELECT *, 2 * {ranges.EARTH_KM} * asin(least(1.0, sqrt(sin((radians(lat) - radians(lat0)) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat)) * sin((radians(lon) - radians(lon0)) / 2) ** 2))) AS km FROM q)
    SELECT line_no, round(km, 3) AS km, round(km / greatest((us - us0) / 3.6e9, 1.0 / 3600), 3) AS kmh FROM k WHERE us0 IS NOT NULL AND km >= 100 AND km / greatest((us - us0) / 3.6e9, 1.0 / 3600) > 900""",
)
def plb_impossible_travel(spark, sf):
    places = table(spark, sf, "nation").selectExpr(*_PLACES)
    found = ranges.impossible_travel(LOG_INS.spark(spark, sf).select("us", "line_no", "src_file", "user", "src_ip"), places)
    return found.select("line_no", F.round("km", 3).alias("km"), F.round("kmh", 3).alias("kmh"))


@query(
    "plb_leaked_accounts",
    f"""WITH {LOG_INS.sql('e')} SELECT "user", count(DISTINCT src_ip) AS sources, count(*) AS tries FROM e WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY "user" HAVING count(DISTINCT src_ip) >= 5""",
)
def plb_leaked_accounts(spark, sf):
    leaked = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("u"), "c_custkey").alias("user"))
    return ranges.leaked_accounts(LOG_INS.spark(spark, sf), leaked)


@query(
    "sketch_windows",
    """WITH e AS (SELECT event_type, user_id % 60 AS v, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS slab FROM events), s AS (SELECT min(slab) AS low FROM e)
    SELECT event_type, count(*) AS n, count(DISTINCT v) AS users FROM e, s WHERE slab BETWEEN low + 3 AND low + 9 GROUP BY event_type""",
)
def sketch_windows(spark, sf):
    """Different users (of 60 groups, which a sketch still counts exactly) in a window of seven days, from sketches a day."""
    rows = table(spark, sf, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("user_id") % 60).alias("v"))
    made = settled(sketches.per_slab(rows, ["event_type"], F.col("v"), slab_us=DAY), "sketches")
    low = made.agg(F.min("slab")).first()[0]
    found = sketches.estimates(sketches.merged(made, ["event_type"], F.lit(low + 3), F.lit(low + 9)), ["event_type"])
    return found.select("event_type", "n", F.col("distinct").alias("users"))
