"""Arithmetic that neither fails nor wraps: whole numbers stop at the ends of 64 bits, a division by zero is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _clamped(exact: Column, negative: Column, a: Column, b: Column) -> Column:
    ends = F.when(negative, F.lit(_LEAST)).otherwise(F.lit(_MOST))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(exact, ends))


def add(a: Column, b: Column) -> Column:
    return _clamped(F.try_add(a, b), a < 0, a, b)


def subtract(a: Column, b: Column) -> Column:
    return _clamped(F.try_subtract(a, b), a < 0, a, b)


def multiply(a: Column, b: Column) -> Column:
    return _clamped(F.try_multiply(a, b), (a < 0) != (b < 0), a, b)


def divide(a: Column, b: Column, dialect: str = "central") -> Column:
    """central: whole numbers, towards zero. agent: floating point."""
    if dialect == "agent":
        return F.try_divide(a.cast("double"), b.cast("double"))
    # the one quotient that does not fit is that of the least number by -1
    safe = F.when((b == -1) & (a == _LEAST), F.lit(_MOST)).when(b == -1, F.try_subtract(F.lit(0).cast("long"), a))
    return F.when(b == 0, F.lit(None).cast("long")).otherwise(F.coalesce(safe, F.call_function("div", a, F.when(b == 0, F.lit(1)).otherwise(b))))


def list_aggregate(values: Column, how: str) -> Column:
    """max, min, sum, avg or count of an array of doubles. Of an empty or null one: null, for sum and count 0; null items make it null."""
    xs = F.coalesce(values, F.array().cast("array<double>"))
    bad = F.exists(xs, lambda x: x.isNull())
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    if how == "count":
        return F.size(xs).cast("long")
    found = {"max": F.array_max(xs), "min": F.array_min(xs), "sum": total, "avg": F.try_divide(total, F.size(xs))}[how]
    return F.when(~F.coalesce(bad, F.lit(False)), found)


#: Nanoseconds of each unit of a duration: fixed values.
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000}


def duration_ns(text: str) -> int:
    """'15m' as nanoseconds, at most what 64 bits hold."""
    unit = text.lstrip("0123456789")
    return min(int(text[: -len(unit)]) * UNITS[unit], _MOST)


def duration_ms(text: str) -> int:
    """As milliseconds; anything shorter counts as 1."""
    return max(duration_ns(text) // 1_000_000, 1) if int(text.rstrip("nsumhd")) else 0


def duration_column(text: Column) -> Column:
    """duration_ns of a text column, null where it is not one."""
    parts = F.regexp_extract(text, r"^(\d+)(?:ns|us|ms|s|m|h|d)$", 1)
    unit = F.regexp_extract(text, r"^\d+(ns|us|ms|s|m|h|d)$", 1)
    scale = F.element_at(F.create_map(*(x for u, n in UNITS.items() for x in (F.lit(u), F.lit(n)))), F.when(unit != "", unit).otherwise(F.lit("ns")))
    return F.when(unit != "", multiply(parts.try_cast("long"), scale))
