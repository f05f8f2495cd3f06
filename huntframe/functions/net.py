"""IP addresses as expressions: IPv4 in the JVM, IPv6 in an Arrow UDF."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

OCTET = "(?:0|[1-9]\\d?|1\\d\\d|2[0-4]\\d|25[0-5])"
IPV4 = f"^{OCTET}(?:\\.{OCTET}){{3}}$"

#: Blocks that aren't globally routable (the IANA registry of special addresses; fixed values).
NOT_GLOBAL = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "240.0.0.0/4", "255.255.255.255/32",
)
#: What masking takes for an internal address.
INTERNAL = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16")


def ip_number(ip: Column) -> Column:
    """A dotted quad as a number; null for anything else."""
    parts = F.split(ip, "\\.")
    number = F.lit(0).cast("bigint")
    for k in range(4):
        number = number * 256 + F.try_element_at(parts, F.lit(k + 1)).try_cast("bigint")
    return F.when(ip.rlike(IPV4), number)


@pandas_udf(StringType())
def ip6_bits(ips: pd.Series) -> pd.Series:
    """The 128 bits of an IPv6 address as text, its zone left out; null for anything else."""

    def one(ip: str | None) -> str | None:
        try:
            return f"{int(ipaddress.IPv6Address(ip)):0128b}" if isinstance(ip, str) else None
        except ValueError:
            return None

    return ips.map(one).astype(object)


def bounds(cidr: str) -> tuple[int, int]:
    """First and last address of an IPv4 block, host bits ignored."""
    net = ipaddress.ip_network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def in_blocks(number: Column, cidrs: Iterable[str]) -> Column:
    out = F.lit(False)
    for c in cidrs:
        low, high = bounds(c)
        out = out | number.between(low, high)
    return out


def is_global(ip: Column) -> Column:
    """Whether a valid IPv4 address is globally routable; false for anything else."""
    number = ip_number(ip)
    return F.coalesce(~in_blocks(number, NOT_GLOBAL), F.lit(False))


def _beginning(cidr: str) -> str:
    """What the dotted quads of an IPv4 block of at most 24 bits begin with, as a pattern."""
    net = ipaddress.ip_network(cidr)
    whole, rest = divmod(net.prefixlen, 8)
    octets = str(net.network_address).split(".")
    parts = octets[:whole]
    if rest:
        parts.append("(?:" + "|".join(str(int(octets[whole]) + i) for i in range(1 << (8 - rest))) + ")")
    return "\\.".join(parts) + "\\."


def is_internal(ip: Column) -> Column:
    """Whether a valid IPv4 address is in ``INTERNAL``: by its beginning, as its number would be made anew for each block."""
    begins = "^(?:" + "|".join(map(_beginning, INTERNAL)) + ")"
    return F.coalesce(ip.rlike(begins) & ip.rlike(IPV4), F.lit(False))


def subnet24(ip: Column) -> Column:
    """``a.b.c.0/24`` of an IPv4 address; null for anything else."""
    return F.when(ip.rlike(IPV4), F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24")))


@pandas_udf(StringType())
def subnet(ips: pd.Series) -> pd.Series:
    """/24 of an IPv4 and /64 of an IPv6 address; null for anything else."""

    def one(ip: str | None) -> str | None:
        try:
            address = ipaddress.ip_address(ip)
        except ValueError:
            return None
        return str(ipaddress.ip_network(f"{address}/{24 if address.version == 4 else 64}", strict=False))

    return ips.map(one)


def host_of_uri(uri: Column) -> Column:
    """The host after ``://``; null without one."""
    return F.nullif(F.regexp_extract(uri, "://([^/:]+)", 1), F.lit(""))
