"""Masking of addresses, names and customers in text, as expressions.

Masking what is masked already changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from huntframe.functions.text import rewritten

# Fixed values.
QUAD = "\\b(\\d{1,3})\\.(\\d{1,3})\\.(\\d{1,3})\\.(\\d{1,3})\\b"
MAC = "\\b((?:[0-9A-Fa-f]{2}:){2}[0-9A-Fa-f]{2})(?::[0-9A-Fa-f]{2}){3}\\b"
EMAIL = "\\b([A-Za-z0-9._%+-]++)@([A-Za-z0-9.-]+\\.[A-Za-z]{2,})\\b"
HOME = "(/home/|/Users/)([A-Za-z0-9_.\\-]++)(?!\\*)"
HOST = "\\b(?:[a-zA-Z0-9-]++\\.)+[a-zA-Z]{2,}\\b"
MASKED = "^[a-zA-Z]\\*{3,}$|^<user>$|^<masked>$|^<customer>$|^<internal>$|^<public-ip>$"
LITERALS = ("null", "None", "true", "false", "True", "False", "~", "nil")
NAME = "[A-Za-z0-9_.\\-*<>]+"
#: Phrases that name a user: (pattern, group of the name, what stands before it, and after it).
USER_PHRASES = (
    (f"\\b(user|User|USER)\\s*[=:]\\s*({NAME})", 2, "$1=", ""),
    (f"\\bfor\\s+(invalid user\\s+)?({NAME})\\s+from\\b", 2, "for $1", " from"),
    (f"\\bby\\s+({NAME})(?=\\s|$|[,.;:!?)\\]])", 1, "by ", ""),
    (f"(\\busername[\"']?\\s*[:=]\\s*[\"']?)({NAME})", 2, "$1", ""),
)


def masked_name(name: Column) -> Column:
    """``z*******``; ``<user>`` for names of up to three characters."""
    stars = F.concat(F.substring(name, 1, 1), F.repeat(F.lit("*"), F.length(name) - 1))
    return F.when(name.rlike(MASKED), name).when(F.length(name) <= 3, F.lit("<user>")).otherwise(stars)


def mask_addresses(text: Column, keep_public: bool = False) -> Column:
    """Internal IPv4 addresses lose their last number, public ones all, unless kept; leading zeros go."""

    def one(m: Column) -> Column:
        a, b, c, d = (F.split(m, "\\.")[k].cast("int") for k in range(4))
        inside = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        public = F.concat_ws(".", a, b, c, d) if keep_public else F.lit("<public-ip>")
        return F.when(inside, F.concat(F.concat_ws(".", a, b, c), F.lit(".xxx"))).otherwise(public)

    return rewritten(text, QUAD, one)


def mask_macs(text: Column) -> Column:
    return F.regexp_replace(text, MAC, "$1:xx:xx:xx")


def mask_homes(text: Column) -> Column:
    """User folders under /home and /Users; /root stays."""

    def one(m: Column) -> Column:
        return F.concat(F.regexp_extract(m, HOME, 1), masked_name(F.regexp_extract(m, HOME, 2)))

    return rewritten(text, HOME, one)


def masked_host(host: Column, internal: Sequence[str], customer: Sequence[str]) -> Column:
    """``<internal>`` for hosts that match a glob (``*.x`` also means x), ``<customer>`` for those with a customer's name."""
    low = F.lower(host)
    out = None
    for glob in internal:
        g = glob.lower()
        rx = f"^(?:.*\\.)?{re.escape(g[2:])}$" if g.startswith("*.") else "^" + ".*".join(map(re.escape, g.split("*"))) + "$"
        out = (F if out is None else out).when(low.rlike(rx), F.lit("<internal>"))
    for c in filter(None, customer):
        out = (F if out is None else out).when(low.contains(c.lower()), F.lit("<customer>"))
    return host if out is None else out.otherwise(host)


def mask_emails(text: Column, internal: Sequence[str] = (), customer: Sequence[str] = ()) -> Column:
    def one(m: Column) -> Column:
        local, domain = F.regexp_extract(m, EMAIL, 1), F.regexp_extract(m, EMAIL, 2)
        user = F.when(F.length(local) > 1, F.concat(F.substring(local, 1, 1), F.lit("***"))).otherwise(F.lit("<u>"))
        return F.concat(user, F.lit("@"), masked_host(domain, internal, customer))

    return rewritten(text, EMAIL, one)


def _mask_phrase(text: Column, rx: str, group: int, before: str, after: str) -> Column:
    def one(m: Column) -> Column:
        name = F.regexp_extract(m, rx, group)
        head = [F.regexp_extract(m, rx, 1) if p == "$1" else F.lit(p) for p in re.split(r"(\$1)", before) if p]
        return F.when(name.rlike(MASKED) | name.isin(*LITERALS), m).otherwise(F.concat(*head, masked_name(name), F.lit(after)))

    return rewritten(text, rx, one)


def mask_users(text: Column) -> Column:
    """Names in ``user=x``, ``for x from``, ``by x`` and ``username: x``; literals and masked names stay."""
    for phrase in USER_PHRASES:
        text = _mask_phrase(text, *phrase)
    return text


def mask_hosts(text: Column, internal: Sequence[str], customer: Sequence[str]) -> Column:
    return rewritten(text, HOST, lambda m: masked_host(m, internal, customer)) if internal or customer else text


def mask_customers(text: Column, customer: Sequence[str]) -> Column:
    for c in filter(None, customer):
        text = F.replace(text, F.lit(c), F.lit("<customer>"))
    return text


def masked(text: Column, mode: str = "strict", internal: Sequence[str] = (), customer: Sequence[str] = (), keep_public: bool = False) -> Column:
    """All of the above in their order; ``relaxed`` keeps addresses, paths and hosts."""
    if mode == "relaxed":
        return mask_customers(mask_emails(mask_users(text), internal, customer), customer)
    if mode != "strict":
        raise ValueError(f"no such mode: {mode}")
    text = mask_homes(mask_macs(mask_addresses(text, keep_public)))
    text = mask_users(mask_emails(text, internal, customer))
    return mask_customers(mask_hosts(text, internal, customer), customer)
