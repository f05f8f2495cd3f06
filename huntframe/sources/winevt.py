"""Windows events to WINEVT: JSON lines, CSV exports and event XML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.functions.text import blank
from huntframe.functions.time import parsed
from huntframe.sources.logs import MAP, first_of, read_csv_files, read_lines

# Fixed values.
NAMES = {
    "ts": ("TimeCreated", "ts", "SystemTime"),
    "channel": ("LogName", "Channel", "channel"),
    "event_id": ("Id", "EventID", "event_id"),
    "record_id": ("RecordId", "EventRecordID", "record_id"),
    "computer": ("MachineName", "Computer", "computer"),
    "message": ("Message", "message"),
    "data": ("EventData", "data"),
}
USER, ADDRESS = ("TargetUserName", "SubjectUserName", "User"), ("IpAddress", "SourceIp", "SourceNetworkAddress")
NO_ADDRESS = ("-", "::", "0.0.0.0")
PAIR = r"([A-Za-z][\w\-]*)\s*[:=]\s*([^;\r\n]+)"
_XML = (
    "System struct<Channel:string,Computer:string,EventID:string,EventRecordID:string,TimeCreated:struct<_SystemTime:string>>, "
    "EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"
)


def event_data(text: Column) -> Column:
    """The event's own fields, from a JSON object or from ``key=value; key: value``."""
    keys = F.regexp_extract_all(text, F.lit(PAIR), F.lit(1))
    values = F.transform(F.regexp_extract_all(text, F.lit(PAIR), F.lit(2)), F.trim)
    # Of a key given twice the last counts.
    last = F.filter(keys, lambda k, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), k))
    pairs = F.map_from_arrays(last, F.filter(values, lambda v, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), F.get(keys, i))))
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, MAP)).otherwise(pairs)


def normalised(objects: DataFrame) -> DataFrame:
    """Maps (``obj``, and ``data`` where it is a map already) to WINEVT; times without a zone are UTC."""
    obj = F.col("obj")
    get = {n: first_of(obj, keys) for n, keys in NAMES.items()}
    own = F.col("data") if "data" in objects.columns else event_data(get["data"])
    rows = objects.withColumn("__data", F.coalesce(own, F.create_map().cast(MAP)))
    address = F.coalesce(first_of(F.col("__data"), ADDRESS), first_of(obj, ("src_ip",)))
    places = [c for c in ("src_file", "line_no") if c in objects.columns]
    return rows.select(
        parsed(get["ts"]).alias("ts"),
        blank(get["channel"]).alias("channel"),
        F.coalesce(get["event_id"].try_cast("int"), F.lit(0)).alias("event_id"),
        get["record_id"].try_cast("bigint").alias("record_id"),
        blank(get["computer"]).alias("computer"),
        F.coalesce(first_of(F.col("__data"), USER), first_of(obj, ("user",))).alias("user"),
        F.when(~address.isin(*NO_ADDRESS), address).alias("src_ip"),
        blank(get["message"]).alias("message"),
        F.col("__data").alias("data"),
        *places,
    )


def read_jsonl(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Event objects, one a line; broken lines are dropped."""
    lines = read_lines(spark, path).withColumn("obj", F.from_json("value", MAP))
    return normalised(lines.where("obj IS NOT NULL AND size(obj) > 0"))


def read_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Exported tables; columns ``EventData.*`` and ``Properties[...`` are the event's own fields."""
    rows = read_csv_files(spark, path)
    own = F.map_filter("obj", lambda k, v: k.startswith("EventData.") | k.startswith("Properties["))
    named = F.transform_keys(own, lambda k, v: F.when(k.contains("."), F.regexp_replace(k, "^[^.]*\\.", "")).otherwise(k))
    plain = event_data(first_of(F.col("obj"), NAMES["data"]))
    return normalised(rows.withColumn("data", F.when(F.size(own) > 0, named).otherwise(plain)))


def from_xml(events: DataFrame) -> DataFrame:
    """Event XML (column ``value``), one event a row, as event viewers export it."""
    x = F.from_xml(F.col("value"), _XML)
    pairs = F.transform(F.filter(x["EventData"]["Data"], lambda d: d["_Name"].isNotNull()), lambda d: F.struct(d["_Name"], d["_VALUE"]))
    system = x["System"]
    obj = F.create_map(
        F.lit("TimeCreated"), system["TimeCreated"]["_SystemTime"], F.lit("Id"), system["EventID"], F.lit("LogName"), system["Channel"],
        F.lit("MachineName"), system["Computer"], F.lit("EventRecordID"), system["EventRecordID"],
    )
    places = [c for c in ("src_file", "line_no") if c in events.columns]
    return normalised(events.select(obj.alias("obj"), F.map_from_entries(pairs).alias("data"), *places))
