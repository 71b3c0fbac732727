"""Orders, pages, differences and latest versions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page `number`, from 1, of `size` rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(rows: DataFrame, size: int) -> DataFrame:
    """total and total_pages."""
    return rows.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))


def recent(rows: DataFrame, order: list, limit: int, most: int = 5000) -> DataFrame:
    """The newest rows; the limit is kept between 1 and `most`. Spark takes each partition's newest before they meet."""
    return rows.orderBy(*order).limit(min(max(limit, 1), most))


def differences(desired: DataFrame, observed: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, change (add, remove or update) of the rows in which observed differs from desired."""
    side = lambda df, name: df.select(key, F.struct(*values).alias(name))
    both = side(desired, "want").join(side(observed, "have"), key, "full")
    change = F.when(F.col("have").isNull(), "add").when(F.col("want").isNull(), "remove").when(F.col("want") != F.col("have"), "update")
    return both.select(key, change.alias("change")).filter("change IS NOT NULL")


def union_first(feeds: list[DataFrame], item: str, cap: int | None = None) -> DataFrame:
    """Lower-cased entries of all feeds, each once, at its first place (feed, then `place`); of these the first `cap`."""
    rows = None
    for n, feed in enumerate(feeds):
        part = feed.select(F.lower(item).alias("item"), F.lit(n).alias("feed"), "place")
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("item").agg(F.min(F.struct("feed", "place")).alias("at")).select("item", "at.feed", "at.place")
    return first.orderBy("feed", "place").limit(cap) if cap else first


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; the maximum is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in [*order, *rest]))


def best_per(rows: DataFrame, keys: list[Column], order: list) -> DataFrame:
    """The first row of each key in this order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def lowest_free(taken: DataFrame, slot: str, first: int, last: int, keys: list[str]) -> DataFrame:
    """For each key of taken the least number from first to last that is not taken, null if all are; a key whose slots are null or outside
    gets the first.

    In order, the taken numbers equal their place as long as there is no gap; the first that does not shows where one is.
    """
    inside = F.col(slot).between(first, last)
    used = taken.filter(inside).select(*keys, slot).distinct()
    placed = used.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(slot)) + F.lit(first - 1))
    gap = F.coalesce(F.min(F.when(F.col(slot) != F.col("__place"), F.col("__place"))), F.max(slot) + 1)
    found = placed.groupBy(*keys).agg(F.when(gap <= last, gap).alias("free"))
    # keys without a slot inside
    empty = taken.groupBy(*keys).agg(F.count_if(inside).alias("__n")).filter("__n = 0").select(*keys, F.lit(first).cast(taken.schema[slot].dataType).alias("free"))
    return found.unionByName(empty)


def filtered_alerts(alerts: DataFrame, tenant=None, severity: str | None = None, rule: str | None = None, text: str | None = None) -> DataFrame:
    """alerts(tenant_id, severity, rule_id, ...) that have the given values; text is looked for in all columns, whatever the case."""
    for column, wanted in (("tenant_id", tenant), ("severity", severity), ("rule_id", rule)):
        if wanted is not None:
            alerts = alerts.filter(F.col(column) == wanted)
    if text:
        shown = F.lower(F.concat_ws(" ", *(F.to_json(F.struct(c)) if "<" in t else F.col(c).cast("string") for c, t in alerts.dtypes)))
        alerts = alerts.filter(shown.contains(text.lower()))
    return alerts
