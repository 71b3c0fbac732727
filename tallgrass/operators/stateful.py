"""Functions that remember: novelty, rates, changes. A row's state is what came before it in order of (time, arrival).

Novelty asks for the first rows of a key only, so it is computed from the key's least (time, arrival), combined before the shuffle, where
the key may hold a third of all rows; rates need the rows themselves and are cut into time slices.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seen_before(keys: list[Column], order: list[str]) -> Column:
    """How many rows with these keys came before, in this order."""
    return (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")


def first_seen(rows: DataFrame, keys: list[Column], order: list[str], name: str = "is_new") -> DataFrame:
    """Marks the first row of each key. The order must tell all rows apart."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    least = rows.groupBy(*named).agg(F.min(F.struct(*order)).alias("__first"))
    on = [k.eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return rows.join(least, on, "left").withColumn(name, F.struct(*order) == F.col("__first")).drop("__first", *(f"__k{i}" for i in range(len(keys))))


def among_first(rows: DataFrame, keys: list[Column], order: list[str], most: int, name: str) -> DataFrame:
    """Marks the first `most` rows of each key. The order must tell all rows apart. A task hands on `most` rows of a key at most."""
    if most == 1:
        return first_seen(rows, keys, order, name)
    named, count = [k.alias(f"__k{i}") for i, k in enumerate(keys)], range(len(keys))
    own = [F.col(f"__k{i}") for i in count]
    place = F.row_number().over(Window.partitionBy(*own).orderBy("__o"))
    first = rows.select(*named, F.struct(*order).alias("__o")).withColumn("__n", place).filter(F.col("__n") <= most)
    last = first.groupBy(*own).agg(F.max("__o").alias("__last"))
    on = [k.eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return rows.join(last, on, "left").withColumn(name, F.struct(*order) <= F.col("__last")).drop("__last", *(f"__k{i}" for i in count))


def rare(rows: DataFrame, tenant: str, value: Column, order: list[str], most: int = 3, name: str = "is_rare") -> DataFrame:
    """Marks the first `most` rows of each value in a tenant."""
    return among_first(rows, [F.col(tenant), value], order, most, name)


def rate(rows: DataFrame, keys: list[Column], time_ms: str, window_ms: int, name: str = "rate") -> DataFrame:
    """How many rows of the key lie in the window_ms up to and including the row's time."""
    return rate_sliced(rows, keys, time_ms, window_ms, name)


def rate_sliced(rows: DataFrame, keys: list[Column], time_ms: str, window_ms: int, name: str = "rate") -> DataFrame:
    """A key that holds a third of all rows is spread over its time slices: a row also visits the next one, where it is counted but not returned."""
    width = max(window_ms, 1)
    own = F.coalesce(F.floor(F.col(time_ms) / width), F.lit(0))
    spread = rows.withColumn("__own", own).withColumn("__at", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy(*keys, "__at").orderBy(time_ms).rangeBetween(-window_ms, 0)
    return spread.withColumn(name, F.count(F.lit(1)).over(w).cast("long")).filter("__at = __own").drop("__at", "__own")


def parent_span(rows: DataFrame, keys: list[str], span: str, order: list[str], name: str = "parent_span") -> DataFrame:
    return rows.withColumn(name, F.lag(span).over(Window.partitionBy(*keys).orderBy(*order)))


#: Weights of severity, change, recency and depth, and the half life of recency in milliseconds: fixed values.
WEIGHTS, HALF_LIFE_MS = (0.30, 0.40, 0.20, 0.10), 5000.0


def relevance_value(risk: Column, change: Column, age_ms: Column, depth: Column) -> Column:
    parts = (risk, F.pow(change, F.lit(0.7)), F.pow(F.lit(2.0), -age_ms / HALF_LIFE_MS), F.least(depth / 8.0, F.lit(1.0)))
    total = sum((F.lit(w) * p for w, p in zip(WEIGHTS[1:], parts[1:], strict=True)), F.lit(WEIGHTS[0]) * parts[0])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def dead_band(rows: DataFrame, key: str, risk: str, time_ms: str, order: list[str], band: float = 0.05, depth: str | None = None) -> DataFrame:
    """Rows whose risk differs by `band` or more from that of the last row of the key that passed, with change, age_ms and relevance.

    What passes depends on what passed before, so a key's rows are walked in order, an Arrow batch at a time (transform of sorted
    partitions, with the key's state carried from batch to batch): memory does not grow with the key.
    """
    depth_column = F.col(depth) if depth else F.lit(0)
    narrow = rows.withColumn("__risk", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(risk).cast("double")))).withColumn("__ms", F.col(time_ms).cast("long"))
    dealt = narrow.repartition(F.col(key)).sortWithinPartitions(key, *order)

    def walk(batches):
        at, last_risk, last_ms = object(), 0.0, 0
        for batch in batches:
            keep, change, age = [], [], []
            for k, r, ms in zip(batch[key], batch["__risk"], batch["__ms"], strict=True):
                new = k != at
                delta = 1.0 if new else abs(r - last_risk)
                passes = new or delta >= band
                keep.append(passes)
                change.append(min(delta, 1.0))
                age.append(0 if new else ms - last_ms)
                at, last_ms = k, ms
                last_risk = r if passes else last_risk
            yield batch.assign(change=change, age_ms=age)[pd.Series(keep, index=batch.index, dtype=bool)]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", change double, age_ms long"
    passed = dealt.mapInPandas(walk, schema)
    return passed.withColumn("relevance", relevance_value(F.col("__risk"), F.col("change"), F.col("age_ms").cast("double"), depth_column.cast("double"))).drop("__risk", "__ms")


def quick_relevance(risk: Column, change: Column, age_ms: Column, depth: Column) -> Column:
    """The simpler score, without powers."""
    return 0.30 * risk + 0.40 * (change / F.greatest(F.lit(1.0), change)) + 0.20 / (1 + age_ms / 5000) + 0.10 * depth


def smoothed(rows: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.28, decay: float = 0.82, name: str = "smooth") -> DataFrame:
    """Exponential smoothing of each key's values; a 0 after something counts as the last result times decay."""

    def walk(batches):
        at, last = object(), 0.0
        for batch in batches:
            out = []
            for k, x in zip(batch[key], batch[value], strict=True):
                x = max(0.0, float(x)) if x == x and x is not None else 0.0
                last = x if k != at else alpha * (last * decay if x == 0 and last > 0 else x) + (1 - alpha) * last
                at = k
                out.append(last)
            yield batch.assign(**{name: out})

    dealt = rows.repartition(F.col(key)).sortWithinPartitions(key, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + f", {name} double"
    return dealt.mapInPandas(walk, schema)
