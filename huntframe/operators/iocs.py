"""Indicators of compromise against records: joins for values, one branch each for patterns.

Indicators are a table (``type, value, confidence, tag``, and ``ua_pattern, uri_pattern`` for
tools).  Exact addresses, domains, hashes and mail addresses are equi-joins; address blocks are
equi-joins on the prefix, one bucket for each prefix length in use; domain suffixes are
equi-joins on each of the host's suffixes.  Patterns are literals in one expression: there must
be few of them, and the regex engine then compiles each once.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.functions.net import host_of_uri, ip6_bits, ip_number
from huntframe.functions.text import all_matches, blank, first_match
from huntframe.operators.signatures import matching, valid
from huntframe.operators.windows import ranked
from huntframe.rules.libraries import IOCS
from huntframe.sources.store import settled

# Fixed values.
LEVELS = {"high": "P1", "medium": "P2", "low": "P3"}
FALSE_ALARMS = {"high": 0.1, "medium": 0.3, "low": 0.55}
CATEGORIES = (("c2", "rce"), ("tool", "recon"), ("scanner", "recon"), ("mining", "data-exfil"), ("reverse-shell", "rce"))
SNIPPET, CUT, SAMPLES = 240, 200, 5
FIELDS = ("type", "value", "confidence", "tag")
HASHES = ("hash:md5", "hash:sha1", "hash:sha256")

#: Up to so many patterns are branches of one expression, without Python.
FEW = 100
IOC = "struct<ordinal:int,type:string,value:string,confidence:string,tag:string>"


def indicators(rows: Iterable[Sequence | Mapping] = IOCS) -> list[dict]:
    """Indicators as dicts with their place in the list; those without type or value are left out."""
    out = []
    for r in rows:
        d = dict(r) if isinstance(r, Mapping) else dict(zip(FIELDS, r, strict=True))
        if d.get("type") and d.get("value"):
            out.append(d | {"type": d["type"].lower(), "ordinal": len(out)})
    return out


def _lit(i: dict) -> Column:
    return F.struct(F.lit(i["ordinal"]).alias("ordinal"), *[F.lit(i.get(f)).cast("string").alias(f) for f in FIELDS])


def _table(spark: SparkSession, rows: list[tuple], keys: str) -> DataFrame:
    """A table of the keys and the indicator in one column ``__ioc``, so that no name clashes with a record's."""
    rows_table = spark.createDataFrame(rows, f"{keys}, ordinal int, type string, value string, confidence string, tag string")
    names = [k.split(" ")[0] for k in keys.split(", ")]
    return rows_table.select(*names, F.struct("ordinal", *FIELDS).alias("__ioc"))


def _values(i: dict) -> tuple:
    return (i["ordinal"], *[i.get(f) for f in FIELDS])


def match_addresses(records: DataFrame, iocs: list[dict], column: str = "src_ip", name: str = "ip_ioc") -> DataFrame:
    """Adds the indicator of an address: exact, else the first block of the list that holds it.

    A block is one row of its version, prefix length and leading bits; each address probes the
    lengths in use of its version.
    """
    spark = records.sparkSession
    mine = [i for i in iocs if i["type"] == "ip"]
    exact = {i["value"]: i for i in mine if "/" not in i["value"]}
    blocks = []
    for i in mine:
        if "/" in i["value"]:
            try:
                net = ipaddress.ip_network(i["value"], strict=False)
            except ValueError:
                continue
            leading = int(net.network_address) >> (net.max_prefixlen - net.prefixlen)
            blocks.append((net.version, net.prefixlen, str(leading) if net.version == 4 else f"{leading:b}".zfill(net.prefixlen)[: net.prefixlen], i))
    out = records
    if exact:
        table = _table(spark, [(v, *_values(i)) for v, i in exact.items()], "__value string")
        out = out.join(table, out[column] == table["__value"], "left").drop("__value").withColumnRenamed("__ioc", "__exact")
    else:
        out = out.withColumn("__exact", F.lit(None).cast(IOC))
    if not blocks:
        return out.withColumnRenamed("__exact", name)
    lengths = sorted({(v, p) for v, p, _, _ in blocks})
    table = _table(spark, [(v, p, b, *_values(i)) for v, p, b, i in blocks], "__version int, __length int, __block string")
    number, bits = ip_number(F.col("__ip")), F.col("__bits")

    def probes(version: int, block: Callable[[int], Column]) -> Column:
        mine = [F.struct(F.lit(v).alias("__version"), F.lit(p).alias("__length"), block(p).alias("__block")) for v, p in lengths if v == version]
        return F.array(*mine)

    # Only addresses are exploded and joined, each once, not records.
    six = any(v == 6 for v, _ in lengths)
    asked = records.select(F.col(column).alias("__ip")).where(number.isNotNull() | (F.contains("__ip", F.lit(":")) & F.lit(six))).distinct()
    four = probes(4, lambda p: F.shiftrightunsigned(number, 32 - p).cast("string"))
    if six:
        asked = asked.withColumn("__bits", ip6_bits("__ip"))
        probe = F.when(bits.isNotNull(), probes(6, lambda p: F.substring(bits, 1, p)))
        if any(v == 4 for v, _ in lengths):
            probe = F.when(number.isNotNull(), four).otherwise(probe)
    else:
        probe = four
    asked = asked.select("__ip", F.explode(probe).alias("__probe")).select("__ip", "__probe.*")
    held = asked.join(table, ["__version", "__length", "__block"])
    first = settled(held.groupBy("__ip").agg(F.min("__ioc").alias("__in")), "addresses-in-blocks")
    out = out.join(first, out[column] == first["__ip"], "left")
    return out.withColumn(name, F.coalesce("__exact", "__in")).drop("__exact", "__in", "__ip")


def match_domains(records: DataFrame, iocs: list[dict], host: Column, name: str = "domain_ioc") -> DataFrame:
    """Adds the indicator of a host: exact, else the first ``*.suffix`` that it lies below (the suffix itself isn't meant)."""
    spark = records.sparkSession
    mine = [i for i in iocs if i["type"] == "domain"]
    rows = [(i["value"].lower().removeprefix("*."), i["value"].startswith("*."), *_values(i)) for i in mine]
    records = records.withColumn("__host", F.lower(host))
    if not rows:
        return records.drop("__host").withColumn(name, F.lit(None).cast(IOC))
    labels = F.split("__host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = records.select("__host").where("__host IS NOT NULL").distinct()
    asked = hosts.select(F.col("__host").alias("__h"), F.posexplode(suffixes).alias("__at", "__suffix"))
    table = _table(spark, rows, "__suffix string, __wild boolean")
    held = asked.join(table, "__suffix").where((F.col("__at") > 0) == F.col("__wild"))
    # Exact before wild, then the order of the list.
    best = settled(held.groupBy("__h").agg(F.min(F.struct("__wild", "__ioc")).alias("__in")).select("__h", F.col("__in.__ioc").alias(name)), "hosts-of-indicators")
    return records.join(best, F.col("__host") == F.col("__h"), "left").drop("__host", "__h")


def match_values(records: DataFrame, iocs: list[dict], kinds: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the indicator of a hash or a mail address, compared in lower case."""
    mine = [i for i in iocs if i["type"] in kinds]
    if not mine:
        return records.withColumn(name, F.lit(None).cast(IOC))
    unique = {i["value"].lower(): i for i in mine}
    table = _table(records.sparkSession, [(v, *_values(i)) for v, i in unique.items()], "__value string")
    joined = records.withColumn("__key", F.lower(value)).join(table, F.col("__key") == F.col("__value"), "left")
    return joined.drop("__key", "__value").withColumnRenamed("__ioc", name)


def _pattern(i: dict) -> str:
    """A path is literal unless it has a character of patterns (a dot is none)."""
    special = set("^$()[]{}|*+?\\")
    return i["value"] if i["type"] != "path" or set(i["value"]) & special else re.escape(i["value"])


def uri_indicator(uri: Column, iocs: list[dict]) -> Column:
    """The first path, else the first URL indicator that matches."""
    mine = [i for kind in ("path", "url") for i in iocs if i["type"] == kind]
    return first_match((uri.rlike(_pattern(i)), _lit(i)) for i in mine) if mine else F.lit(None).cast(IOC)


def agent_indicator(ua: Column, iocs: list[dict]) -> Column:
    mine = [i for i in iocs if i["type"] == "ua"]
    return first_match((ua.rlike(i["value"]), _lit(i)) for i in mine) if mine else F.lit(None).cast(IOC)


def tool_indicators(ua: Column, uri: Column, iocs: list[dict]) -> Column:
    """All tools whose agent or address pattern matches."""
    choices = []
    for i in (i for i in iocs if i["type"] == "tool"):
        agent = (blank(ua) != "") & ua.rlike(i["ua_pattern"]) if i.get("ua_pattern") else F.lit(False)
        address = (blank(uri) != "") & uri.rlike(i["uri_pattern"]) if i.get("uri_pattern") else F.lit(False)
        choices.append((F.coalesce(agent, F.lit(False)) | F.coalesce(address, F.lit(False)), _lit(i)))
    return all_matches(choices) if choices else F.array().cast(f"array<{IOC}>")


def with_patterns(records: DataFrame, iocs: list[dict], few: int = FEW) -> tuple[DataFrame, Column, Column, Column]:
    """``records`` and, of each, the first path or URL indicator, the first agent indicator and all tools.

    Few patterns are branches of one expression; more than ``few`` are looked for by one automaton
    over all of them, and the numbers that it finds are looked up among the indicators.
    """
    uri, ua = F.col("uri"), F.col("ua")
    kinds = ("path", "url", "ua", "tool")
    mine = sorted((i for i in iocs if i["type"] in kinds), key=lambda i: kinds.index(i["type"]))  # paths before URLs
    if len(mine) <= few:
        first = F.when(blank(uri) != "", uri_indicator(uri, iocs)), F.when(blank(ua) != "", agent_indicator(ua, iocs))
        return records, *first, tool_indicators(ua, uri, iocs)
    asked = []
    for n, i in enumerate(mine):
        if i["type"] == "tool":
            asked += [(n, f, i[p]) for f, p in (("ua", "ua_pattern"), ("uri", "uri_pattern")) if i.get(p)]
        else:
            asked.append((n, "ua" if i["type"] == "ua" else "uri", _pattern(i)))
    numbered = [(n, *_values(i), kinds.index(i["type"])) for n, i in enumerate(mine)]
    table = records.sparkSession.createDataFrame(numbered, "n int, ordinal int, type string, value string, confidence string, tag string, kind int")
    held = F.array_sort(F.collect_list(F.struct("n", "kind", F.struct("ordinal", *FIELDS).alias("ioc"))))
    # one row: the list of the patterns that were read from rule files
    known = table.agg(held.alias("__known"))
    found = records.withColumn("__n", F.array_distinct(matching({"ua": ua, "uri": uri}, valid_patterns(asked), records.sparkSession)))
    found = found.join(F.broadcast(known)).withColumn("__n", F.transform("__n", lambda n: F.get("__known", n))).drop("__known")

    def of(*which: int) -> Column:
        return F.transform(F.filter("__n", lambda x: x["kind"].isin(*which)), lambda x: x["ioc"])

    return found, F.get(of(0, 1), F.lit(0)), F.get(of(2), F.lit(0)), of(3)


def valid_patterns(asked: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    return [tuple(r) for r in valid(asked)]


def matched(records: DataFrame, iocs: list[dict], extended: bool = False, few: int = FEW) -> DataFrame:
    """Records of LOG with ``iocs``, an array of the indicators they hit: address, domain, path, agent, tools.

    ``extended`` also looks at ``dst_ip`` and, where the records have them, ``sni``, ``hash`` and ``email``.
    """
    out = match_addresses(records, iocs)
    out = match_domains(out, iocs, host_of_uri(F.col("uri")))
    names = ["ip_ioc", "domain_ioc"]
    if extended:
        out = match_addresses(out, iocs, "dst_ip", "dst_ioc")
        names.append("dst_ioc")
        for column, kinds in (("hash", HASHES), ("email", ("email",))):
            if column in records.columns:
                out = match_values(out, iocs, kinds, F.col(column), f"{column}_ioc")
                names.append(f"{column}_ioc")
        if "sni" in records.columns:
            out = match_domains(out, iocs, F.col("sni"), "sni_ioc")
            names.append("sni_ioc")
    out, uri, ua, tools = with_patterns(out, iocs, few)
    single = F.array(*map(F.col, names), uri, ua)
    return out.withColumn("iocs", F.concat(F.array_compact(single), tools)).drop(*names, "__n")


def hits(matches: DataFrame) -> DataFrame:
    """One row a record and indicator."""
    return matches.where(F.size("iocs") > 0).withColumn("ioc", F.explode("iocs")).drop("iocs")


def by_indicator(found: DataFrame, order: Sequence[str] = ("src_file", "line_no")) -> DataFrame:
    """Hits by indicator and source: count, first and last time (as text), different URIs and agents, and the first five records.

    Of the records only five a group and task are shuffled; what differs is counted, not collected.
    """
    ts = F.nullif("ts", F.lit(""))
    flat = found.select("*", *[F.col(f"ioc.{f}").alias(f) for f in FIELDS], F.col("ioc.ordinal").alias("ordinal"), blank(F.col("src_ip")).alias("source_key"))
    keys = ["ordinal", *FIELDS, "source_key"]
    first = Window.partitionBy("ordinal", "source_key").orderBy(*order)
    sample = F.struct(F.col("nth"), *order, "ts", F.substring(blank(F.col("raw_line")), 1, SNIPPET).alias("raw_line_snippet"))
    samples = flat.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLES)
    samples = samples.groupBy("ordinal", "source_key").agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    groups = flat.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.count_distinct(F.substring(F.nullif("uri", F.lit("")), 1, CUT)).alias("n_uris"),
        F.count_distinct(F.substring(F.nullif("ua", F.lit("")), 1, CUT)).alias("n_uas"),
    )
    samples = samples.withColumnRenamed("ordinal", "__o").withColumnRenamed("source_key", "__s")
    joined = groups.join(samples, (groups["ordinal"] == F.col("__o")) & (groups["source_key"] == F.col("__s")))
    source = F.nullif("source_key", F.lit(""))
    return joined.withColumns({"src_ip": source, "src_ips": F.array_compact(F.array(source))}).drop("__o", "__s", "source_key")


def severity(confidence: Column) -> Column:
    low = F.lower(blank(confidence))
    return first_match([(low == k, v) for k, v in LEVELS.items()] + [(F.lit(True), "P3")])


def category(tag: Column) -> Column:
    low = F.lower(blank(tag))
    return first_match([(low.contains(k), v) for k, v in CATEGORIES] + [(F.lit(True), "其他")])


def findings(groups: DataFrame) -> DataFrame:
    """``by_indicator`` as findings ``IOC-001``, ... in the order of type, value and source (null first)."""
    order = ranked(groups.withColumn("__ip", blank(F.col("src_ip"))), ["type", "value", "__ip", "ordinal"])
    low = F.lower(blank(F.col("confidence")))
    fp = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in FALSE_ALARMS.items() for x in p]), low), F.lit(0.5))
    evidence = F.to_json(F.struct("first_seen", "last_seen", "count", "src_ips", "samples"), {"ignoreNullFields": "false"})
    mine = F.struct("type", "value", "confidence", "first_seen", F.lit(None).cast("string").alias("source"), "tag")
    return order.select(
        F.format_string("IOC-%03d", "nth").alias("id"),
        severity(F.col("confidence")).alias("severity"),
        category(F.col("tag")).alias("category"),
        evidence.alias("evidence"),
        F.concat(F.lit("IOC-"), "type").alias("rule_id"),
        fp.alias("false_positive_prob"),
        F.lit("Block or watch the indicator; review the source's other records").alias("recommended_action"),
        F.array(mine).alias("iocs"),
    )
