"""Joins over event time, and joins with reference tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of their texts and lists, up to which a reference table is broadcast; a larger one is joined by its key.
REFERENCE_ROWS = 200_000
REFERENCE_BYTES = 32 << 20


def aliased(events: DataFrame, alias: str) -> DataFrame:
    """All columns as one struct named by the alias."""
    return events.select(F.struct("*").alias(alias))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def interval_join(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], left_ms: Column, right_ms: Column, within_ms: int, ordered: bool = False) -> DataFrame:
    """Pairs with equal keys, at most within_ms apart, both ends included; ordered: the right one not before the left one.

    Both sides get the number of their time slice; a left row stands in its own, a right one also in the two beside it. Slice and key
    are the join key, so a key that holds a third of all events is spread over its slices, and each pair is met once.
    """
    width = max(within_ms, 1)
    left = left.withColumn("__slice", F.floor(left_ms / width))
    own = F.floor(right_ms / width)
    right = right.withColumn("__near", F.explode(F.sequence(own - 1, own if ordered else own + 1)))
    gap = right_ms - left_ms
    close = gap.between(0 if ordered else -within_ms, within_ms)
    on = [F.col("__slice") == F.col("__near"), *(a == b for a, b in keys), close]
    return left.join(right, _all(on)).drop("__slice", "__near")


def within_of_last(sides: list[tuple[Column, Column]], within_ms: int) -> Column:
    """For tuples of three or more: every member lies within within_ms of the one that arrived last. sides: (milliseconds, arrival) of each."""
    last = reduce(lambda a, b: F.greatest(a, b), (F.struct(arrival.alias("arrival"), ms.alias("ms")) for ms, arrival in sides))
    return _all([F.abs(ms - last["ms"]) <= within_ms for ms, _ in sides])


def _reference(table: DataFrame) -> DataFrame:
    size = F.sum(sum((F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in table.columns), F.lit(0)))
    rows, bytes_ = table.agg(F.count(F.lit(1)), size).first()
    return F.broadcast(table) if rows <= REFERENCE_ROWS and (bytes_ or 0) <= REFERENCE_BYTES else table


def in_set(rows: DataFrame, item: Column, entries: DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose item, lower-cased, is among entries(entry), or with negate those whose item is not; a null item is in no set."""
    known = _reference(entries.select(F.lower("entry").alias("__entry")).filter("__entry IS NOT NULL").distinct())
    return rows.join(known, F.lower(item) == F.col("__entry"), "left_anti" if negate else "left_semi")


def marked_in_set(rows: DataFrame, item: Column, entries: DataFrame, name: str) -> DataFrame:
    """rows with a column that says whether the item, lower-cased, is among entries(entry)."""
    known = _reference(entries.select(F.lower("entry").alias("__entry")).filter("__entry IS NOT NULL").distinct())
    return rows.join(known, F.lower(item.cast("string")) == F.col("__entry"), "left").withColumn(name, F.col("__entry").isNotNull()).drop("__entry")


def with_baseline(rows: DataFrame, key: Column, baseline: DataFrame, name: str = "baseline") -> DataFrame:
    """Left join with baseline(entity, values): an array of the values known of each entity, null if it is unknown."""
    known = _reference(baseline.select(F.col("entity").alias("__entity"), F.col("values").alias(name)))
    return rows.join(known, key == F.col("__entity"), "left").drop("__entity")


def known_to(baseline: Column, item: Column) -> Column:
    """Whether the baseline holds the item; an unknown entity knows everything."""
    return F.coalesce(F.array_contains(baseline, item), F.lit(True))


def fact_exists(rows: DataFrame, facts: DataFrame, tenant: Column, target: Column, now_ms: Column) -> DataFrame:
    """Rows for which a fact of the tenant names the target among its arguments and has not expired."""
    named = facts.select(F.col("tenant_id").alias("__tenant"), F.explode("args").alias("__arg"), F.col("emitted_ms").alias("__from"), F.col("expires_ms").alias("__to"))
    valid = (F.col("__from") <= now_ms) & (F.col("__to").isNull() | (F.col("__to") > now_ms))
    return rows.join(named, (tenant == F.col("__tenant")) & (target.cast("string") == F.col("__arg")) & valid, "left_semi")


def marked_with_fact(rows: DataFrame, facts: DataFrame, tenant: Column, target: Column, now_ms: Column, name: str) -> DataFrame:
    """rows with a column that says whether fact_exists keeps them."""
    keyed = rows.withColumns({f"{name}_tenant": tenant, f"{name}_target": target.cast("string"), f"{name}_ms": now_ms})
    at = [F.col(f"{name}_{x}") for x in ("tenant", "target", "ms")]
    # each asked (tenant, target, time) once, so a row that many facts speak for stays one row
    asked = fact_exists(keyed.select(*at).distinct(), facts, *at).select(*(c.alias(f"__{i}") for i, c in enumerate(at)), F.lit(True).alias(name))
    on = _all([c.eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(at)])
    return keyed.join(asked, on, "left").withColumn(name, F.col(name).isNotNull()).select(*rows.columns, name)


def first_policy(rows: DataFrame, policies: DataFrame, group: str, pid: str) -> DataFrame:
    """The verdict of the closest policy: for (group, pid), then (0, pid), (group, 0), (0, 0). policies(group_id, pid, verdict)."""
    out, found = rows, []
    # of a (group, pid) listed more than once the least verdict holds, so reruns agree
    known = _reference(policies.groupBy("group_id", "pid").agg(F.min("verdict").alias("verdict")))
    zero = {"group_id": F.col("group_id") == 0, "pid": F.col("pid") == 0}
    for n, keys in enumerate((("group_id", "pid"), ("pid",), ("group_id",), ())):
        # the fields that are no key are 0: with none left one row is left
        table = known.filter(reduce(lambda a, b: a & b, (zero[k] for k in zero if k not in keys), F.lit(True)))
        table = table.select(F.col("group_id").alias(f"__g{n}"), F.col("pid").alias(f"__p{n}"), F.col("verdict").alias(f"__v{n}"))
        on = {"group_id": F.col(group) == F.col(f"__g{n}"), "pid": F.col(pid) == F.col(f"__p{n}")}
        out = out.join(table, reduce(lambda a, b: a & b, (on[k] for k in keys), F.lit(True)), "left")
        found.append(F.col(f"__v{n}"))
    return out.select(*rows.columns, F.coalesce(*found).alias("verdict"))
