"""The uniform finding: eight fields, whatever rule made it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.operators.windows import ranked
from huntframe.rules.catalog import RULES

#: How bad; smaller is worse.
LEVELS = ("P0", "P1", "P2", "P3")


@dataclass(frozen=True)
class Branch:
    """A rule of one record: where ``when`` holds it reports, with ``extra`` as further evidence."""

    rule_id: str
    when: Column
    extra: Mapping[str, Column] | None = None
    severity: Column | None = None


def _hit(ordinal: int, b: Branch) -> Column:
    extra = F.to_json(F.struct(*[v.alias(k) for k, v in b.extra.items()])) if b.extra else F.lit(None).cast("string")
    severity = b.severity if b.severity is not None else F.lit(RULES[b.rule_id].severity)
    return F.when(
        b.when,
        F.struct(
            F.lit(ordinal).alias("ordinal"),
            F.lit(b.rule_id).alias("rule_id"),
            F.coalesce(severity, F.lit(RULES[b.rule_id].severity)).alias("severity"),
            extra.alias("extra"),
        ),
    )


def hits(df: DataFrame, branches: Sequence[Branch]) -> DataFrame:
    """A row for each rule that reports a record: the record with ``ordinal, rule_id, severity, extra``.

    All rules are one array column, so the input is scanned once however many rules there are.
    The array is a column before it is exploded, and what doesn't report goes after that: as the
    argument of a filter by a lambda, the rules would be interpreted and read no field in common.
    ``explode_outer``, since ``explode`` also asks for the array's size, in a filter of its own that runs all rules once more.
    """
    names = [c for c in df.columns if c not in ("ordinal", "rule_id", "severity", "extra")]
    each = df.withColumn("__hits", F.array(*[_hit(i, b) for i, b in enumerate(branches)]))
    return each.select(*names, F.explode_outer("__hits").alias("__hit")).where("__hit IS NOT NULL").select(*names, "__hit.*")


def one_rule(df: DataFrame, rule_id: str, ordinal: int, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """The same row for each row of ``df``: for rules that are operators of their own."""
    made = F.to_json(F.struct(*[v.alias(k) for k, v in extra.items()])) if extra else F.lit(None).cast("string")
    return df.withColumns(
        {"ordinal": F.lit(ordinal), "rule_id": F.lit(rule_id), "severity": F.lit(RULES[rule_id].severity), "extra": made}
    )


def _by_rule(field: str) -> Column:
    pairs = [x for r in RULES.values() for x in (F.lit(r.rule_id), F.lit(getattr(r, field)))]
    return F.try_element_at(F.create_map(*pairs), F.col("rule_id"))


def as_findings(
    found: DataFrame,
    prefix: str,
    evidence: Mapping[str, Column],
    iocs: Column | None = None,
    us: str = "us",
    ties: Sequence[str] = ("src_file", "line_no"),
) -> DataFrame:
    """Rows of ``hits`` as findings, numbered ``PREFIX-001``, ``-002``, ... in the order of their records.

    ``evidence`` becomes a JSON object, with the rule's own ``extra`` in the key ``rule``.  Records
    without a time come last.
    """
    timed = found.withColumn("__us", F.coalesce(F.col(us), F.lit((1 << 63) - 1)))
    rows = ranked(timed, ["__us", *ties, "ordinal"])
    if iocs is None:
        iocs = F.array().cast("array<struct<type:string,value:string,confidence:string,first_seen:string,source:string,tag:string>>")
    body = F.to_json(F.struct(*[v.alias(k) for k, v in evidence.items()], F.col("extra").alias("rule")), {"ignoreNullFields": "false"})
    return rows.select(
        F.format_string(f"{prefix}-%03d", "nth").alias("id"),
        "severity",
        _by_rule("category").alias("category"),
        body.alias("evidence"),
        "rule_id",
        _by_rule("fp").alias("false_positive_prob"),
        _by_rule("action").alias("recommended_action"),
        iocs.alias("iocs"),
    )


def ioc(kind: str, value: Column, confidence: str, first_seen: Column, source: Column, tag: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        value.alias("value"),
        F.lit(confidence).alias("confidence"),
        first_seen.alias("first_seen"),
        source.alias("source"),
        tag.alias("tag"),
    )


def level_rank(severity: Column) -> Column:
    """P0 is 0; unknown levels rank as P3."""
    return F.when(severity.isin(*LEVELS), F.substring(severity, 2, 1).cast("int")).otherwise(F.lit(3))


def raised(severity: Column, by: Column | int = 1) -> Column:
    """``by`` levels worse, P0 at most."""
    by = F.lit(by) if isinstance(by, int) else by
    return F.concat(F.lit("P"), F.greatest(F.lit(0), level_rank(severity) - by).cast("string"))
