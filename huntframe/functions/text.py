"""Strings: cuts, labels of domain names, alphabets and entropy."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import reduce
from re._constants import BRANCH, LITERAL, MAX_REPEAT, MIN_REPEAT, SUBPATTERN
from re._parser import parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


#: Stands around matches while a text is rewritten.
_MARK = "\x01"


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made(value)`` with ``value`` computed once, however often ``made`` uses it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def truncated(text: Column, n: int, ellipsis: str = "") -> Column:
    """The first ``n`` characters, with ``ellipsis`` where something was cut; null stays null."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit(ellipsis)))


def blank(text: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(text, F.lit(""))


def has_any(text: Column, words: Iterable[str]) -> Column:
    """Whether the lower-cased text contains one of ``words``; null doesn't."""
    low = F.lower(blank(text))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def first_match(choices: Iterable[tuple[Column, Column | str]]) -> Column:
    """The value of the first (condition, value) that holds, as ``CASE`` evaluates them; else null."""
    out = None
    for condition, value in choices:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if out is not None else F.lit(None).cast("string")


def all_matches(choices: Iterable[tuple[Column, Column]]) -> Column:
    """An array of the values whose conditions hold, in order."""
    return F.filter(F.array(*[F.when(c, v) for c, v in choices]), lambda x: x.isNotNull())


def basename(path: Column) -> Column:
    """The lower-cased last part of a path with either kind of slash."""
    return F.lower(F.substring_index(F.replace(blank(path), F.lit("\\"), F.lit("/")), "/", -1))


def trimmed_name(name: Column) -> Column:
    return F.regexp_replace(blank(name), "^\\.+|\\.+$", "")


def first_label(name: Column) -> Column:
    return F.substring_index(trimmed_name(name), ".", 1)


def parent_domain(name: Column) -> Column:
    """The last two labels."""
    return F.substring_index(trimmed_name(name), ".", -2)


def longest_label(name: Column) -> Column:
    """The longest label, the first of equally long ones."""
    labels = F.split(trimmed_name(name), "\\.")
    return F.aggregate(labels, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def kept(text: Column, inside: str) -> Column:
    """How many characters belong to the class ``inside``."""
    return F.length(F.regexp_replace(blank(text), f"[^{inside}]", ""))


def digit_ratio(name: Column) -> Column:
    """Digits among the letters and digits of a name's longest label; 1 without letters, 0 for no name."""

    def ratio(label: Column) -> Column:
        digits, letters = kept(label, "\\p{Nd}"), kept(label, "\\p{L}")
        return F.when(F.length(label) == 0, F.lit(0.0)).when(letters == 0, F.lit(1.0)).otherwise(digits / (letters + digits))

    return bound(longest_label(name), ratio)


def alphabet_ratio(label: Column, inside: str) -> Column:
    return F.when(F.length(blank(label)) == 0, F.lit(0.0)).otherwise(kept(label, inside) / F.length(label))


def base32_ratio(label: Column) -> Column:
    return alphabet_ratio(label, "A-Za-z2-7")


def base64url_ratio(label: Column) -> Column:
    return alphabet_ratio(label, "\\p{L}\\p{Nd}_-")


def consonant_run(label: Column) -> Column:
    """The longest run of characters that are neither vowels nor digits."""
    return F.array_max(F.transform(F.split(F.lower(blank(label)), "[aeiou0-9]", -1), F.length))


def numeric_or_address(text: Column) -> Column:
    return blank(text).rlike("^[0-9a-fA-F:.]+$")


def entropy(label: Column) -> Column:
    """Shannon entropy of the characters in bits; for short strings (labels), inside the JVM."""

    def bits(chars: Column) -> Column:
        def part(c: Column) -> Column:
            p = F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
            return -p * F.log2(p)

        total = F.aggregate(F.transform(F.array_distinct(chars), part), F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(chars) == 0, F.lit(0.0)).otherwise(F.abs(total))

    return bound(F.array_remove(F.split(blank(label), ""), ""), bits)


@pandas_udf(DoubleType())
def text_entropy(texts: pd.Series) -> pd.Series:
    """Shannon entropy of whole texts to 3 digits, for long ones: counts characters in one pass."""

    def one(t: str | None) -> float:
        if not t:
            return 0.0
        total = len(t)
        return round(abs(sum(-k / total * math.log2(k / total) for k in Counter(t).values())), 3)

    return texts.map(one)


def rewritten(text: Column, pattern: str, replace: Callable[[Column], Column]) -> Column:
    """Every match of ``pattern`` replaced by ``replace(match)``; what ``regexp_replace`` can't say.

    One search puts a mark around each match; what stands between marks is then every second
    part.  A text that has the mark itself is searched twice instead.  No match may be empty.
    """

    def marked(t: Column) -> Column:
        parts = F.split(F.regexp_replace(t, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
        return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.coalesce(replace(x), F.lit("")))), "")

    def searched(t: Column) -> Column:
        found = F.concat(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), replace), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return bound(text, lambda t: F.when(F.contains(t, F.lit(_MARK)), searched(t)).otherwise(marked(t)))


def required_words(pattern: str) -> tuple[str, ...]:
    """Lower-case words of which every match of a pattern has at least one; none if there is no telling."""

    def least(words: list[str]) -> int:
        return min(map(len, words), default=0)

    def best(parts) -> list[str]:
        runs: list[list[str]] = []
        run = ""
        for op, value in parts:
            if op is LITERAL and value < 128:
                run += chr(value).lower()
                continue
            runs, run = [*runs, [run]], ""
            if op is SUBPATTERN:
                runs.append(best(value[-1]))
            elif op in (MAX_REPEAT, MIN_REPEAT) and value[0] > 0:
                runs.append(best(value[2]))
            elif op is BRANCH:
                each = [best(b) for b in value[1]]
                runs.append([w for words in each for w in words] if all(map(least, each)) else [])
        return max([*runs, [run]], key=least)

    try:
        words = best(parse(pattern))
    except re.error:
        return ()
    return tuple(dict.fromkeys(words)) if least(words) >= 2 else ()


def rlike_with_words(text: Column, low: Column, pattern: str) -> Column:
    """``text.rlike(pattern)``, asked only where ``low``, the text in lower case, has one of the words that a match needs."""
    words = required_words(pattern)
    return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words]) & text.rlike(pattern) if words else text.rlike(pattern)
