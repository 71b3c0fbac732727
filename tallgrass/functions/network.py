"""Addresses and domain names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def ipv4(text: Column) -> Column:
    """The address as a number; null if the text is none."""
    parts = F.split(text, r"\.")
    number = F.aggregate(F.transform(parts, lambda p: p.try_cast("long")), F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    return F.when(text.rlike(_IPV4), number)


def without_prefix(text: Column) -> Column:
    """10.0.0.0/8 as 10.0.0.0."""
    return F.substring_index(text, "/", 1)


def is_internal(address: Column) -> Column:
    """Private, loopback or link-local: 10/8, 172.16/12, 192.168/16, 127/8, 169.254/16."""
    a, b = F.shiftright(address, 24), F.shiftright(address, 16)
    return a.isin(10, 127) | b.between(0xAC10, 0xAC1F) | b.isin(0xC0A8, 0xA9FE)


def looks_like_domain(text: Column) -> Column:
    name = F.lower(F.rtrim(F.trim(text), F.lit(".")))
    return F.coalesce((name == "localhost") | (name.rlike(r"^[a-z0-9.-]+$") & name.contains(".") & ~name.rlike(_IPV4)), F.lit(False))


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)


def vertex_of_endpoint(address: Column, port: Column) -> Column:
    """port * 65536 xor address."""
    return F.shiftleft(port.cast("long"), 16).bitwiseXOR(address)
