"""Summaries of events and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(events: DataFrame, kind: str, tenant: str, host: str) -> DataFrame:
    """Counts by kind, tenant, host, tenant and kind, tenant and host, and of all rows: one pass over the events.

    The columns are kind, tenant, host (null where not grouped by), by (which grouping), n.
    """
    names = {1: "tenant,host", 2: "tenant,kind", 3: "tenant", 5: "kind", 6: "host", 7: "all"}
    rows = events.select(F.col(kind).alias("kind"), F.col(tenant).alias("tenant"), F.col(host).alias("host"))
    k, t, h = F.col("kind"), F.col("tenant"), F.col("host")
    sets = rows.groupingSets([[k], [t], [h], [t, k], [t, h], []], k, t, h)
    # grouping(x) is 1 where x is not grouped by
    by = F.when((F.grouping("tenant") == 0) & (F.grouping("host") == 0), "tenant,host").when((F.grouping("tenant") == 0) & (F.grouping("kind") == 0), "tenant,kind")
    by = by.when(F.grouping("tenant") == 0, "tenant").when(F.grouping("kind") == 0, "kind").when(F.grouping("host") == 0, "host").otherwise(names[7])
    return sets.agg(by.alias("by"), F.count(F.lit(1)).alias("n")).select("by", "kind", "tenant", "host", "n")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each key: n, least, most and for each share the value at place min(n, floor(n * share) + 1) in ascending order, exactly.

    Ranks come from counts of distinct values, so equal values and hot keys are combined before the shuffle.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(value)
    all_of = Window.partitionBy(*keys)
    ranked = counted.withColumn("__to", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(all_of))
    wanted = {name: F.least(F.col("__all"), F.floor(F.col("__all") * F.lit(p)) + 1) for name, p in shares.items()}
    at = [F.min(F.when(F.col("__to") >= place, F.col(value))).alias(name) for name, place in wanted.items()]
    return ranked.groupBy(*keys).agg(F.sum("__n").alias("n"), F.min(value).alias("least"), *at, F.max(value).alias("most"))


def metric_summary(rows: DataFrame, time: str, width: str, keys: list[str], value: str, exact: bool = False) -> DataFrame:
    """Count, min, max, mean and the 50th, 95th and 99th percentile (approximate: a mergeable sketch) in tumbling windows. Works on streams."""
    grouped = rows.groupBy(F.window(time, width).alias("w"), *keys)
    at = F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), 1000)
    out = grouped.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), at.alias("__at"))
    parts = [] if exact else [F.get("__at", i).alias(name) for i, name in enumerate(("p50", "p95", "p99"))]
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "least", "most", "mean", *parts)


def exact_metric_summary(rows: DataFrame, time: str, width: str, keys: list[str], value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """As metric_summary, for tables only, with exact percentiles p50, p95 ...: the value at place ceil(n * percent / 100), at least 1, in
    ascending order. Places come from counts of distinct values, so equal values are combined before the shuffle and windows may be of any size."""
    counted = rows.groupBy(F.window(time, width).alias("w"), *keys, value).agg(F.count(value).alias("__n"))
    of = ["window_start", *keys]
    all_of = Window.partitionBy(*of)
    ranked = counted.withColumn("window_start", F.col("w.start")).drop("w").withColumn("__to", F.sum("__n").over(all_of.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(all_of))
    # in whole numbers: 0.95 * n may lie beside the place
    place = lambda p: F.greatest(F.lit(1).cast("long"), F.col("__all") - F.expr(f"__all * {100 - p} div 100"))
    at = [F.min(F.when(F.col("__to") >= place(p), F.col(value))).alias(f"p{p}") for p in percents]
    mean = F.sum(F.col(value) * F.col("__n")) / F.nullif(F.sum("__n"), F.lit(0))
    return ranked.groupBy(*of).agg(F.sum("__n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), mean.alias("mean"), *at)


def fleet_summary(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """A summary of summaries: each gives its least, mean, percentiles and most as six samples, null if it has no value."""
    samples = summaries.select(*keys, F.explode(F.array("least", "mean", "p50", "p95", "p99", "most")).alias("x"))
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"))


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """How many values are at most each bound, and at most infinity: one pass, one row a bound."""
    counts = [F.struct(F.lit(str(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds]
    whole = F.struct(F.lit("+Inf").alias("le"), F.count(F.lit(1)).alias("n"))
    return rows.agg(F.array(*counts, whole).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def rate_percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, rounded; 100 if there is nothing."""
    return F.when(whole > 0, F.round(100 * part / whole)).otherwise(F.lit(100.0))


#: Size of a digest: the rank of a quantile is off by about 1.7 / K of all values, 1.3 % here, whatever their number.
DIGEST_K = 200


def digests(rows: DataFrame, keys: list[str | Column], value: str, k: int = DIGEST_K) -> DataFrame:
    """A row a key: n, min, max and digest, a binary sketch of the values' distribution. Digests can be kept and merged. Null is no value."""
    x = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.kll_sketch_agg_double(x, k).alias("digest"))


def merged_digests(digests: DataFrame, keys: list[str | Column], k: int = DIGEST_K) -> DataFrame:
    """Digests of finer keys as digests of coarser ones: seconds to hours, hosts to a fleet."""
    return digests.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("digest", k).alias("digest"))


def digest_quantiles(digests: DataFrame, shares: dict[str, float]) -> DataFrame:
    """digests with a column a share: p95=0.95 is a value that about 95 % of all values do not exceed, null where there are none."""
    at = {name: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("digest", F.lit(share))) for name, share in shares.items()}
    return digests.withColumns(at).drop("digest")
