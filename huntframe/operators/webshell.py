"""Web shells: files against a pattern library, scored by what matched, entropy and name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.functions.text import all_matches, bound, rlike_with_words, text_entropy
from huntframe.operators.windows import ranked
from huntframe.rules.libraries import WEBSHELL_PATTERNS

# Fixed values.
EXTENSIONS = (
    ".php", ".phtml", ".php3", ".php4", ".php5", ".jsp", ".jspx", ".jspf", ".asp", ".aspx", ".ashx", ".asmx", ".cer", ".cdx",
)
SKIPPED_FOLDERS = ("node_modules", "vendor", ".git", "dist", "build", "__pycache__")
MAX_BYTES, ENTROPY_CHARS, TINY = 5 * 1024 * 1024, 65536, 200
WEIGHTS = {"high": 5, "medium": 2, "low": 1}
RUNNING_WORDS = ("eval", "assert", "system", "exec", "passthru", "runtime")
AROUND, EXCERPT, LISTED = 40, 240, 5


def read_files(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, size, text`` of the files below a folder that have one of the extensions.

    Larger files and those in skipped folders are left out, as a scanner of web roots wants.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.lower(F.substring_index("path", "/", -1))
    wanted = F.concat(F.lit("."), F.substring_index(name, ".", -1)).isin(*[e.lower() for e in extensions]) if extensions else F.lit(True)
    inside = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS)))
    return files.where((F.col("length") <= max_bytes) & wanted & ~inside).select("path", F.col("length").alias("size"), F.col("content").cast("string").alias("text"))


def _rule(text: Column, low: Column, rule: tuple) -> tuple[Column, Column]:
    rule_id, lang, pattern, level = rule[:4]
    rx = f"(?ms){pattern}"
    found = F.regexp_extract(text, rx, 0)
    at = F.position(found, text)
    before = F.substring(text, 1, at - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    start = F.greatest(F.lit(1), at - AROUND)
    excerpt = F.substring(F.replace(F.substring(text, start, at + F.length(found) + AROUND - start), F.lit("\n"), F.lit(" ")), 1, EXCERPT)
    value = F.struct(F.lit(rule_id).alias("id"), F.lit(lang).alias("lang"), F.lit(level).alias("severity"), line.cast("int").alias("line_no"), excerpt.alias("excerpt"))
    return rlike_with_words(text, low, rx), value


def score(hits: Column, size: Column, entropy: Column, path: Column, running: Column | None = None) -> Column:
    """The sum of the hits' weights, and points for entropy and odd names; ``running`` adds 4 for tiny files that run something."""
    weight = F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p])
    total = F.aggregate(hits, F.lit(0), lambda a, h: a + F.coalesce(F.try_element_at(weight, h["severity"]), F.lit(1)))
    base = F.regexp_replace(F.substring_index(path, "/", -1), "(?<=.)\\.[^.]*$", "")
    points = F.when(entropy > 6.0, 3).when(entropy > 5.5, 1).otherwise(0)
    points = points + F.when(base.rlike("^[a-z0-9]$"), 2).otherwise(0) + F.when(base.rlike("^[0-9]{8,}$"), 1).otherwise(0)
    points = points + F.when((F.length(base) >= 4) & base.rlike("\\p{Lu}") & (base == F.upper(base)), 1).otherwise(0)
    return total + points if running is None else total + points + F.when((size < TINY) & running, 4).otherwise(0)


def severity(points: Column, high: Column) -> Column:
    return F.when(high & (points >= 6), "P0").when(high | (points >= 6), "P1").when(points >= 3, "P2").otherwise("P3")


def scan(files: DataFrame, patterns: Sequence[tuple] = WEBSHELL_PATTERNS, tiny_bonus: bool = False) -> DataFrame:
    """``path, size, entropy, score, hits, severity, fp`` of the files that any pattern matches.

    Each pattern counts once, at its first place.  ``tiny_bonus`` turns on the extra points for
    tiny files with a pattern that runs something.  Null texts match nothing.
    """
    both = F.struct(F.coalesce(F.col("text"), F.lit("")).alias("t"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("low"))
    hits = bound(both, lambda b: all_matches(_rule(b["t"], b["low"], p) for p in patterns))
    # Exploded, not filtered by: a filter would be pushed below and match everything a second time.
    found = files.withColumn("hits", F.explode(F.filter(F.array(hits), lambda h: F.size(h) > 0)))
    found = found.withColumn("entropy", text_entropy(F.substring(F.coalesce(F.col("text"), F.lit("")), 1, ENTROPY_CHARS)))
    runs = [p[0] for p in patterns if any(w in p[2].lower() for w in RUNNING_WORDS)]
    running = F.exists("hits", lambda h: h["id"].isin(*runs)) if tiny_bonus else None
    found = found.withColumn("score", score(F.col("hits"), F.col("size"), F.col("entropy"), F.col("path"), running))
    high = F.exists("hits", lambda h: h["severity"] == "high")
    fp = F.when(high & (F.col("score") >= 6), 0.05).when(high, 0.2).when(F.col("score") >= 4, 0.35).otherwise(0.55)
    return found.select("path", "size", "entropy", "score", "hits", severity(F.col("score"), high).alias("severity"), fp.alias("fp"))


def findings(scanned: DataFrame) -> DataFrame:
    """The same as findings ``WS-001``, ... by path; the rule is the list of the first five patterns."""
    rows = ranked(scanned, ["path"])
    first = F.slice("hits", 1, LISTED)
    lines = F.transform(first, lambda h: F.concat(h["id"], F.lit(" L"), h["line_no"].cast("string"), F.lit(": "), h["excerpt"]))
    sure = F.when(F.col("severity").isin("P0", "P1"), "high").otherwise("medium")
    none = F.lit(None).cast("string")
    source = F.concat(F.lit("webshell_scan:"), F.get("hits", F.lit(0))["id"])
    return rows.select(
        F.format_string("WS-%03d", "nth").alias("id"),
        "severity",
        F.lit("webshell").alias("category"),
        F.to_json(F.struct("path", "size", "entropy", "score", lines.alias("lines"))).alias("evidence"),
        F.array_join(F.transform(first, lambda h: h["id"]), ",").alias("rule_id"),
        F.col("fp").alias("false_positive_prob"),
        F.lit("Keep a copy and its hash, stop serving the file, trace how it was uploaded").alias("recommended_action"),
        F.array(F.struct(F.lit("path").alias("type"), F.col("path").alias("value"), sure.alias("confidence"), none.alias("first_seen"), source.alias("source"), F.lit("webshell").alias("tag"))).alias("iocs"),
    )
