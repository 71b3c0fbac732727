"""Queries of the analytics around rules: summaries, orders, differences, functions, graphs and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.functions import clock, network, numeric, text
from tallgrass.operators import aggregates, console, derive, graph, rules, selection, tables
from tallgrass.operators.conditions import field
from tallgrass.operators.rules import Rule, Source
from tallgrass.plans.common import EV, Registry, events, table
from tallgrass.sources import events as source

registry = Registry()
add = registry.add

# --- scans and flattening ------------------------------------------------------------------------------------------------


@add("""SELECT event_id, 'a_' || event_type AS kind, value AS a, NULL::DOUBLE AS b FROM ev WHERE event_type IN ('view', 'click')
  UNION ALL SELECT event_id, 'b_' || event_type, NULL, value FROM ev WHERE event_type IN ('error', 'signup')""")
def flatten_union_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    first = rows.filter(F.col("event_type").isin("view", "click")).select("event_id", F.concat(F.lit("a_"), "event_type").alias("kind"), F.col("value").alias("a"))
    second = rows.filter(F.col("event_type").isin("error", "signup")).select("event_id", F.concat(F.lit("b_"), "event_type").alias("kind"), F.col("value").alias("b"))
    return first.unionByName(second, allowMissingColumns=True)


@add(f"""WITH {EV} SELECT tenant_id::VARCHAR AS tenant_id, CASE WHEN event_type = 'error' THEN 'file' ELSE 'process_exec' END AS event_kind, count(*) AS n, sum(user_id)::BIGINT AS users
  FROM ev WHERE event_type IN ('error', 'view') GROUP BY ALL""")
def flatten_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events packed into ingest batches, and taken apart again by the batch flattening."""
    rows = events(spark, sf_dir)
    common = lambda *own: F.struct(F.col("ts_ms").alias("ts_unix_ms"), F.col("user_id").alias("pid"), F.lit(None).cast("map<string,string>").alias("attrs"), *own)
    exec_rows = F.collect_list(F.when(F.col("event_type") == "view", common(F.lit("x").alias("filename"))))
    file_rows = F.collect_list(F.when(F.col("event_type") == "error", common(F.lit("/etc").alias("path"))))
    batches = rows.groupBy(F.col("tenant_id").cast("string").alias("tenant_id"), F.col("user_id").cast("string").alias("host_id")).agg(
        F.max("ts_ms").alias("ingested_at_unix_ms"), exec_rows.alias("process_exec_events"), file_rows.alias("file_events")
    )
    empty = {f: F.array().cast("array<struct<ts_unix_ms:bigint,pid:bigint,attrs:map<string,string>>>") for f, _ in source.FAMILIES.values() if f not in ("process_exec_events", "file_events")}
    batches = batches.withColumns({"schema_version": F.lit(1), "batch_id": F.lit(None).cast("string"), **empty})
    good, _ = source.checked(batches)
    flat = source.flattened(good)
    return flat.groupBy("tenant_id", "event_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("event.pid").alias("users"))


@add("""SELECT event_id, CASE WHEN own BETWEEN arr - 86400000 AND arr + 300000 THEN own ELSE arr END AS t, NOT coalesce(own BETWEEN arr - 86400000 AND arr + 300000, false) AS fallback
  FROM (SELECT event_id, ts_ms AS arr, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN ts_ms - 86400001 WHEN event_id % 7 = 2 THEN ts_ms + 300001 WHEN event_id % 7 = 3 THEN ts_ms + 300000 ELSE ts_ms - 5400000 END AS own FROM ev)""")
def event_time_trust_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, t = F.col("event_id") % 7, F.col("ts_ms")
    own = F.when(m == 1, t - 86_400_001).when(m == 2, t + 300_001).when(m == 3, t + 300_000).when(m > 3, t - 5_400_000)
    return events(spark, sf_dir).select("event_id", clock.trusted_time(own, t).alias("t"), (~clock.in_band(own, t)).alias("fallback"))


@add("SELECT event_id, event_type AS kind, user_id::VARCHAR AS u, coalesce(k, '') AS k, false AS odd FROM ev")
def kv_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("evt kind="), "event_type", F.lit("  u="), F.col("user_id").cast("string"), F.lit(" stray k=0 k="), F.coalesce(source.attribute(F.col("attrs"), "k"), F.lit("")))
    m = text.key_values(line)
    get = lambda name: F.try_element_at(m, F.lit(name))
    return events(spark, sf_dir).select("event_id", get("kind").alias("kind"), get("u").alias("u"), get("k").alias("k"), F.map_contains_key(m, F.lit("stray")).alias("odd"))


@add("SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS entry FROM part WHERE p_brand <> 'Brand#1'")
def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("p_brand") == "Brand#1", F.concat(F.lit("# "), "p_type")).otherwise(F.concat(F.lit("  "), "p_type", F.lit("  # note")))
    return source.feed_entries(table(spark, sf_dir, "part").select(line.alias("value"))).select(F.lower("entry").alias("entry")).distinct()


@add("SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'click' THEN 'debug' ELSE 'info' END AS level FROM ev")
def log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    line = F.concat(F.lit("Jan 01 host "), F.when(kind == "error", "an Error: debug").when(kind == "signup", "WARNING").when(kind == "click", "debug: x").otherwise("ready"))
    return events(spark, sf_dir).select("event_id", text.log_level(line).alias("level"))


# --- aggregates ----------------------------------------------------------------------------------------------------------


@add("""SELECT 'kind' AS "by", event_type AS kind, NULL::BIGINT AS tenant, NULL::BIGINT AS host, count(*) AS n FROM ev GROUP BY event_type
  UNION ALL SELECT 'tenant', NULL, tenant_id, NULL, count(*) FROM ev GROUP BY tenant_id UNION ALL SELECT 'host', NULL, NULL, user_id, count(*) FROM ev GROUP BY user_id
  UNION ALL SELECT 'tenant,kind', event_type, tenant_id, NULL, count(*) FROM ev GROUP BY event_type, tenant_id UNION ALL SELECT 'tenant,host', NULL, tenant_id, user_id, count(*) FROM ev GROUP BY tenant_id, user_id
  UNION ALL SELECT 'all', NULL, NULL, NULL, count(*) FROM ev""")
def summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.summary(events(spark, sf_dir), "event_type", "tenant_id", "user_id")


@add("""SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM ev GROUP BY ALL""")
def metric_summary_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.metric_summary(events(spark, sf_dir), "ts", "1 day", ["event_type"], "value", exact=True)
    return out.withColumn("mean", F.round("mean", 6)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@add()
def metric_digest_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.metric_summary(events(spark, sf_dir), "ts", "1 day", ["event_type"], "value")


@add(f"""WITH {EV}, s AS (SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, min(value) AS least, max(value) AS most, avg(value) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM ev GROUP BY 1, 2),
  x AS (SELECT event_type, unnest([least, mean, p50, p95, p99, most]) AS x FROM s) SELECT event_type, count(*) AS samples, min(x) AS least, max(x) AS most, round(avg(x), 6) AS mean FROM x GROUP BY 1""")
def metric_fleet_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = aggregates.fleet_summary(aggregates.exact_metric_summary(events(spark, sf_dir), "ts", "1 day", ["event_type"], "value"), ["event_type"])
    return rolled.withColumn("mean", F.round("mean", 6))


@add("""WITH r AS (SELECT l_suppkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
  SELECT l_suppkey, max(n) AS n, min(x) AS least, min(CASE WHEN i = least(n, floor(n * 0.5) + 1) THEN x END) AS p50, min(CASE WHEN i = least(n, floor(n * 0.95) + 1) THEN x END) AS p95, max(x) AS most FROM r GROUP BY l_suppkey""")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.nearest_rank(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", {"p50": 0.5, "p95": 0.95})


@add("""SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) FILTER (WHERE l_returnflag = 'A') AS active, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) AS n, round(count(*) FILTER (WHERE l_linestatus = 'O') / greatest(count(*), 1), 4) AS utilization FROM lineitem GROUP BY 1""")
def fleet_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, is_open = F.count(F.lit(1)), F.count_if(F.col("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("l_returnflag") == "A").alias("active"), is_open.alias("open"), n.alias("n"), F.round(is_open / F.greatest(n, F.lit(1)), 4).alias("utilization"))


@add("SELECT le, n FROM (SELECT unnest(['5.0', '10.0', '25.0', '50.0', '100.0', '500.0', '+Inf']) AS le, unnest([count(*) FILTER (WHERE value <= 5), count(*) FILTER (WHERE value <= 10), count(*) FILTER (WHERE value <= 25), count(*) FILTER (WHERE value <= 50), count(*) FILTER (WHERE value <= 100), count(*) FILTER (WHERE value <= 500), count(*)]) AS n FROM ev)")
def histogram_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram(events(spark, sf_dir), "value", [5.0, 10.0, 25.0, 50.0, 100.0, 500.0])


@add("""SELECT o_custkey, max(o_totalprice) AS most, min(o_totalprice) AS least, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1""")
def list_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("xs"), F.collect_list("o_orderpriority").alias("ps"))
    x = lambda how: numeric.list_aggregate(F.col("xs"), how)
    return rows.select("o_custkey", x("max").alias("most"), x("min").alias("least"), F.round(x("sum"), 2).alias("total"), F.round(x("avg"), 6).alias("mean"), x("count").alias("n"), F.size(F.array_distinct("ps")).cast("long").alias("kinds"))


@add("SELECT tenant_id, CASE WHEN count(*) > 0 THEN round(100 * count(*) FILTER (WHERE value > 5) / count(*)) ELSE 100 END AS accepted FROM ev GROUP BY tenant_id")
def accept_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("tenant_id").agg(F.count_if(F.col("value") > 5).alias("a"), F.count(F.lit(1)).alias("n")).select("tenant_id", aggregates.rate_percent(F.col("a"), F.col("n")).alias("accepted"))


@add("SELECT p_brand AS set_name, p_type AS type, count(*) AS n FROM part GROUP BY ALL")
def ioc_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("set_name"), F.col("p_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


# --- orders and sets -----------------------------------------------------------------------------------------------------


@add("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority ILIKE '%high%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def alerts_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").ilike("%high%"))
    return tables.page(rows, [F.desc("o_orderdate"), "o_orderkey"], 3, 25).select("o_orderkey", "o_orderdate")


@add("SELECT count(*) AS total, ceil(count(*) / 25)::BIGINT AS total_pages FROM orders WHERE o_orderpriority ILIKE '%high%'")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pages(table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").ilike("%high%")), 25)


@add("""WITH load AS (SELECT l_suppkey AS s, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), c AS (SELECT n_name, s_nationkey, s_suppkey, coalesce(n, 0) / greatest(s_acctbal, 1) AS load FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN load ON s = s_suppkey)
  SELECT n_name, s_suppkey FROM c QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY load, s_suppkey) = 1""")
def least_loaded_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey").join(load, "s_suppkey", "left")
    rows = rows.withColumn("load", F.coalesce("n", F.lit(0)) / F.greatest("s_acctbal", F.lit(1)))
    return tables.best_per(rows, [F.col("n_name")], ["load", "s_suppkey"]).select("n_name", "s_suppkey")


@add("""WITH t AS (SELECT DISTINCT c_nationkey AS g, c_custkey % 97 AS s FROM customer), a AS (SELECT g, x AS s FROM (SELECT DISTINCT g FROM t), range(0, 97) r(x))
  SELECT a.g AS c_nationkey, min(a.s) FILTER (WHERE t.s IS NULL) AS free FROM a LEFT JOIN t ON a.g = t.g AND a.s = t.s GROUP BY a.g""")
def lowest_free_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") % 97).alias("slot"))
    return tables.lowest_free(taken, "slot", 0, 96, ["c_nationkey"])


@add("""WITH want AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 3 <> 0), have AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 4 <> 0)
  SELECT coalesce(w.c_custkey, h.c_custkey) AS c_custkey, CASE WHEN h.c_custkey IS NULL THEN 'add' WHEN w.c_custkey IS NULL THEN 'remove' ELSE 'update' END AS change FROM want w FULL JOIN have h ON w.c_custkey = h.c_custkey
  WHERE h.c_custkey IS NULL OR w.c_custkey IS NULL OR w.c_mktsegment <> h.c_mktsegment""")
def reconcile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    have = c.filter("c_custkey % 4 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "X").otherwise(F.col("c_mktsegment")))
    return tables.differences(c.filter("c_custkey % 3 <> 0"), have, "c_custkey", ["c_mktsegment", "c_nationkey"])


@add("""WITH r AS (SELECT lower(p_type) AS item, 0 AS feed, p_partkey AS place FROM part WHERE p_size > 25 UNION ALL SELECT lower(p_brand), 1, p_partkey FROM part)
  SELECT item, feed, place FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY feed, place) AS i FROM r) WHERE i = 1 ORDER BY feed, place LIMIT 20""")
def feed_union_dedupe_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    a = part.filter("p_size > 25").select(F.col("p_type").alias("entry"), F.col("p_partkey").alias("place"))
    b = part.select(F.col("p_brand").alias("entry"), F.col("p_partkey").alias("place"))
    return tables.union_first([a, b], "entry", cap=20)


@add("SELECT tenant_id, user_id, event_type, ts_ms, event_id, value FROM ev QUALIFY row_number() OVER (PARTITION BY tenant_id, user_id, event_type ORDER BY ts_ms DESC, event_id DESC) = 1")
def fact_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest(events(spark, sf_dir).select("tenant_id", "user_id", "event_type", "ts_ms", "event_id", "value"), ["tenant_id", "user_id", "event_type"], ["ts_ms", "event_id"])


@add("SELECT event_id, ts_ms FROM ev ORDER BY ts_ms DESC, event_id DESC LIMIT 100")
def recent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.recent(events(spark, sf_dir).select("event_id", "ts_ms"), [F.desc("ts_ms"), F.desc("event_id")], 100)


@add("SELECT tenant_id, user_id, max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END)::INTEGER AS state FROM ev GROUP BY ALL")
def session_risk_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strictest state that a session was ever put in: restrictions only grow."""
    rank = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    return events(spark, sf_dir).groupBy("tenant_id", "user_id").agg(F.max(rank).alias("state"))


@add("""SELECT user_id, CASE WHEN age > 600000000 THEN 'stale' WHEN drops > n / 4 THEN 'degraded' ELSE 'healthy' END AS health FROM
  (SELECT user_id, (SELECT max(ts_ms) FROM ev) - max(ts_ms) AS age, count(*) FILTER (WHERE event_type = 'error') AS drops, count(*) AS n FROM ev GROUP BY user_id)""")
def probe_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    last = rows.agg(F.max("ts_ms").alias("now"))
    per = rows.groupBy("user_id").agg(F.max("ts_ms").alias("seen"), F.count_if(F.col("event_type") == "error").alias("drops"), F.count(F.lit(1)).alias("n"))
    health = F.when(F.col("now") - F.col("seen") > 600_000_000, "stale").when(F.col("drops") > F.col("n") / 4, "degraded").otherwise("healthy")
    return per.join(F.broadcast(last)).select("user_id", health.alias("health"))  # one row


# --- functions -----------------------------------------------------------------------------------------------------------

_BIG = 9223372036854775807


@add(f"SELECT event_id, least(({_BIG}::HUGEINT - 5 + user_id), {_BIG})::BIGINT AS added, greatest(-{_BIG}::HUGEINT - user_id, -{_BIG}::HUGEINT - 1)::BIGINT AS taken, least(({_BIG} // 64)::HUGEINT * user_id, {_BIG})::BIGINT AS times FROM ev")
def arith_saturating(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return events(spark, sf_dir).select("event_id", numeric.add(F.lit(_BIG - 5), u).alias("added"), numeric.subtract(F.lit(-_BIG), u).alias("taken"), numeric.multiply(F.lit(_BIG // 64), u).alias("times"))


@add("SELECT event_id, CASE WHEN d <> 0 THEN n // d END AS whole, CASE WHEN d <> 0 THEN n / d END AS real FROM (SELECT event_id, event_id - 500 AS n, user_id % 4 - 1 AS d FROM ev)")
def div_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.col("event_id") - 500, F.col("user_id") % 4 - 1
    return events(spark, sf_dir).select("event_id", numeric.divide(n, d).alias("whole"), numeric.divide(n, d, "agent").alias("real"))


@add("SELECT event_id, lower(strftime(ts, '%A')) AS weekday, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS m, isodow(ts) < 6 AND hour(ts) BETWEEN 9 AND 16 AS business FROM ev")
def time_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    return events(spark, sf_dir).select("event_id", clock.weekday(t).alias("weekday"), F.hour(t).alias("h"), F.minute(t).alias("m"), clock.is_business_hour(t).alias("business"))


@add("SELECT p_partkey, p_size::BIGINT * CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 1000000000 WHEN 4 THEN 60000000000 WHEN 5 THEN 3600000000000 ELSE 86400000000000 END AS ns FROM part")
def duration_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, numeric.UNITS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", numeric.duration_column(F.concat(F.col("p_size").cast("string"), unit)).alias("ns"))


_IP = "(CASE event_id % 6 WHEN 0 THEN '10' WHEN 1 THEN '172' WHEN 2 THEN '192' WHEN 3 THEN '169' WHEN 4 THEN '127' ELSE '8' END)"
_IP2 = "(CASE event_id % 6 WHEN 1 THEN event_id % 40 WHEN 2 THEN 167 + event_id % 4 WHEN 3 THEN 254 ELSE event_id % 256 END)"


@add(f"""SELECT event_id, ip, CASE WHEN ok THEN a::BIGINT * 16777216 + b * 65536 + user_id % 256 * 256 + 7 END AS n,
  CASE WHEN ok THEN a IN ('10', '127') OR (a = '172' AND b BETWEEN 16 AND 31) OR (a = '192' AND b = 168) OR (a = '169' AND b = 254) END AS internal
  FROM (SELECT event_id, user_id, {_IP} AS a, {_IP2} AS b, event_id % 11 <> 0 AS ok, {_IP} || '.' || {_IP2} || '.' || user_id % 256 || CASE WHEN event_id % 11 = 0 THEN '.300' ELSE '.7' END AS ip FROM ev)""")
def ipv4_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("ip", F.expr(f"concat_ws('.', {_IP}, {_IP2}, user_id % 256, CASE WHEN event_id % 11 = 0 THEN '300' ELSE '7' END)"))
    n = network.ipv4(F.col("ip"))
    return rows.select("event_id", "ip", n.alias("n"), network.is_internal(n).alias("internal"))


@add("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^[a-z0-9.-]+$') AND contains(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.') AS domain FROM pages")
def domain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = network.host_of(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), network.looks_like_domain(host).alias("domain"))


_BYTES = "list_transform(range(1, (length(hex(encode(t))) // 2 + 1)::BIGINT), lambda i: ('0x' || substr(hex(encode(t)), (2 * i - 1)::BIGINT, 2))::BIGINT)"


@add(f"SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, {_BYTES}), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS h FROM (SELECT p_partkey, p_name || 'é' AS t FROM part)")
def fnv1a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.fnv1a32(F.concat("p_name", F.lit("é"))).alias("h"))


@add(f"""WITH b AS (SELECT p_partkey, unnest({_BYTES}) AS b FROM (SELECT p_partkey, p_name || 'é' AS t FROM part)), c AS (SELECT p_partkey, b, count(*) AS n FROM b GROUP BY ALL), s AS (SELECT p_partkey, n / sum(n) OVER (PARTITION BY p_partkey) AS p FROM c)
  SELECT p_partkey, round(-sum(p * log2(p)), 9) AS entropy FROM s GROUP BY p_partkey""")
def entropy_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.entropy(F.concat("p_name", F.lit("é"))), 9).alias("entropy"))


@add("SELECT conv_id, turn, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars FROM conversations")
def len_chars_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.length_of(F.col("text")).alias("bytes"), text.length_of(F.col("text"), "agent").alias("chars"))


@add("SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_type")).alias("slug"))


_STATEMENTS = "concat('SELECT * FROM sales.', replace(p_brand, '#', '_'), ' JOIN \"my table\" x ON x.id = ', p_size, ' WHERE name = ''', p_name, ''' -- note\n AND t1 > ', p_retailprice)"


@add("""SELECT p_partkey, 'SELECT * FROM sales.' || replace(p_brand, '#', '_') || ' JOIN "my table" x ON x.id = ? WHERE name = ? AND t1 > ?' AS redacted FROM part""")
def sql_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.redact(F.expr(_STATEMENTS)).alias("redacted"))


@add("SELECT p_partkey, 'sales.' || replace(p_brand, '#', '_') || CASE WHEN p_size > 25 THEN ',sales.archive' ELSE ',ledger' END AS tables, replace(p_brand, '#', '_') || CASE WHEN p_size > 25 THEN ',archive' ELSE ',ledger' END AS packed, CASE WHEN p_size > 25 THEN 'sales' END AS database FROM part")
def sql_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("p_size") > 25, "sales.archive").otherwise("ledger")
    statement = F.concat(F.lit("SELECT a FROM sales."), F.regexp_replace("p_brand", "#", "_"), F.lit(" JOIN "), second, F.lit(", (SELECT ? FROM (SELECT 1))"))
    names = text.tables_of(statement)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names, ",").alias("tables"), text.pack_tables(names).alias("packed"), text.database_of(names).alias("database"))


@add("SELECT p_partkey, (CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END)::INTEGER AS kind FROM part")
def sql_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ("(select 1)", "insert into t", "DROP table t", "Grant all", "vacuum"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.statement_kind(word).alias("kind"))


# --- graphs --------------------------------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT o_custkey AS src, 1000000 + l_suppkey AS dst, o_orderpriority AS kind, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return lines.join(orders, "l_orderkey").select(F.col("o_custkey").alias("src"), (F.lit(1000000) + F.col("l_suppkey")).alias("dst"), F.col("o_orderpriority").alias("kind"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


@add(f"WITH {_EDGES} SELECT src, dst, kind, ts, seq FROM e QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY ts DESC, seq DESC) = 1")
def edge_coalesce_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.latest_edges(_edges(spark, sf_dir), ["ts", "seq"])


@add(f"WITH {_EDGES} SELECT src, count(*) AS out_degree FROM e GROUP BY src")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


#: A graph with cycles: each event of a user leads to another user, by its attribute.
_LINKS = "l AS (SELECT DISTINCT user_id AS src, (user_id * 7 + k::BIGINT) % (SELECT max(user_id) + 1 FROM ev) AS dst FROM ev)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = source.attribute(F.col("attrs"), "k", "long")
    rows = events(spark, sf_dir)
    users = F.broadcast(rows.agg((F.max("user_id") + 1).alias("users")))  # one row
    return rows.select(F.col("user_id").alias("src"), (F.col("user_id") * 7 + k).alias("to")).join(users).select("src", (F.col("to") % F.col("users")).alias("dst")).distinct()


_BFS = f"WITH RECURSIVE {EV}, {_LINKS}, r AS (SELECT 3::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN l ON src = id WHERE depth < 3), b AS (SELECT id, min(depth)::INTEGER AS depth FROM r GROUP BY id)"


@add(f"{_BFS} SELECT id, depth FROM b")
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(_links(spark, sf_dir), spark.range(3, 4), 3)


@add(f"{_BFS} SELECT src, dst FROM l WHERE src IN (SELECT id FROM b WHERE depth <= 2) AND dst IN (SELECT id FROM b WHERE depth <= 2)")
def khop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.k_hop(_links(spark, sf_dir), spark.range(3, 4), 2)[1]


@add(f"WITH {_EDGES} SELECT DISTINCT src, dst FROM e JOIN supplier ON dst = 1000000 + s_suppkey WHERE s_nationkey >= 10")
def external_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = table(spark, sf_dir, "supplier").select((F.lit(1000000) + F.col("s_suppkey")).alias("id"), F.lit("endpoint").alias("label"), (F.col("s_nationkey") < 10).alias("is_internal"))
    return graph.external_neighbors(_edges(spark, sf_dir), vertices, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@add("SELECT event_id, xor((user_id * 65536)::BIGINT, event_id) AS vertex FROM ev")
def vertex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", network.vertex_of_endpoint(F.col("event_id"), F.col("user_id")).alias("vertex"))


# --- selection -----------------------------------------------------------------------------------------------------------

_BUDGET = {"cpu": 3.0, "mem": 4.0, "io": 3.0, "net": 2.5, "bw": 3.0}


def _items(spark: SparkSession, sf_dir: str, window: Column | str = "user_id") -> DataFrame:
    cost = lambda m: ((F.col("event_id") * m) % 17 + 1) / 20
    return events(spark, sf_dir).select(window, "event_id", F.round(F.least(F.col("value") / 200, F.lit(1.0)), 6).alias("relevance"), *(cost(m).alias(r) for m, r in zip((3, 5, 7, 11, 13), selection.RESOURCES, strict=True)))


_COSTS = ", ".join(f"((event_id * {m}) % 17 + 1) / 20.0::DOUBLE AS {r}" for m, r in zip((3, 5, 7, 11, 13), selection.RESOURCES, strict=True))
_FITS = " AND ".join(f"i.{r} <= s.{r} + 1e-9" for r in selection.RESOURCES)


@add(f"""WITH RECURSIVE {EV}, x AS (SELECT user_id, event_id, round(least(value / 200, 1.0), 6) AS relevance, {_COSTS} FROM ev), y AS (SELECT *, relevance / (cpu * 0.20 + mem * 0.15 + io * 0.15 + net * 0.20 + bw * 0.30) AS e FROM x),
  i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e DESC, event_id) AS n FROM y WHERE e > 0),
  s AS (SELECT DISTINCT user_id, 0::BIGINT AS event_id, 0.0::DOUBLE AS e, 0::BIGINT AS n, false AS taken, {", ".join(f"{v}::DOUBLE AS {r}" for r, v in _BUDGET.items())} FROM i
  UNION ALL SELECT i.user_id, i.event_id, i.e, i.n, {_FITS}, {", ".join(f"CASE WHEN {_FITS} THEN s.{r} - i.{r} ELSE s.{r} END" for r in selection.RESOURCES)} FROM s JOIN i ON i.user_id = s.user_id AND i.n = s.n + 1)
  SELECT user_id, event_id, round(e, 9) AS efficiency FROM s WHERE taken""")
def knapsack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.greedy(_items(spark, sf_dir), "user_id", "event_id", _BUDGET).select("user_id", "event_id", F.round("efficiency", 9).alias("efficiency"))


_WINDOWED = "concat_ws('-', user_id, floor(ts_ms / 86400000))"


@add()
def knapsack_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window is a user's day; every event is in one. A window that is too large for an exact answer is solved greedily, as the tiers say."""
    items = _items(spark, sf_dir, F.expr(_WINDOWED).alias("window"))
    return selection.selected(items, "window", "event_id", _BUDGET, F.lit(0.5), F.lit(True)).select("window", "event_id", "tier")


@add()
def knapsack_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.relaxed(_items(spark, sf_dir), "user_id", "event_id", _BUDGET).select("user_id", "event_id")


@add("SELECT event_id, round((value / 200 - 0.1 * c) / c, 9) AS e FROM (SELECT event_id, value, 0.2 * 0.5 / 2 + 0.15 * 0.3 + 0.15 * 0.1 / 4 + 0.2 * 0.4 / 0.5 + 0.3 * ((event_id % 17 + 1) / 20) / (user_id % 5 + 1) AS c FROM ev)")
def efficiency_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = [F.lit(0.5), F.lit(0.3), F.lit(0.1), F.lit(0.4), (F.col("event_id") % 17 + 1) / 20]
    left = [2.0, 1.0, 4.0, 0.5, (F.col("user_id") % 5 + 1).cast("double")]
    return events(spark, sf_dir).select("event_id", F.round(selection.relative_efficiency(F.col("value") / 200, costs, left), 9).alias("e"))


@add("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size * 15 <= 64 THEN 'exact' WHEN p_size * 15 > 512 OR p_partkey % 10 / 10 < 0.3 THEN 'greedy' WHEN p_partkey % 10 / 10 > 0.8 THEN 'relaxed' ELSE 'greedy' END AS tier FROM part")
def knapsack_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", selection.tier(F.col("p_size") * 15, key % 10 / 10, key % 2 == 0).alias("tier"))


@add("SELECT event_id, round((r - 0.1 * c) / c, 9) AS e FROM (SELECT event_id, value / 200 AS r, 0.2 * 0.5 + 0.15 * 0.3 + 0.15 * 0.1 + 0.2 * 0.4 + 0.3 * (event_id % 17 + 1) / 20 AS c FROM ev)")
def efficiency_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = [F.lit(0.5), F.lit(0.3), F.lit(0.1), F.lit(0.4), (F.col("event_id") % 17 + 1) / 20]
    return events(spark, sf_dir).select("event_id", F.round(selection.penalised_efficiency(F.col("value") / 200, selection.composite_cost(costs)), 9).alias("e"))


# --- what is derived of single events ------------------------------------------------------------------------------------

_KIND = "(CASE event_id % 8 WHEN 1 THEN 'process_exec' WHEN 2 THEN 'file' WHEN 3 THEN 'net' WHEN 4 THEN 'sql' WHEN 5 THEN 'ssl' WHEN 6 THEN 'dns' WHEN 7 THEN 'tc' ELSE 'other' END)"


@add(f"""SELECT event_id, {_KIND} AS kind, CASE event_id % 8 WHEN 1 THEN 0.5 WHEN 2 THEN CASE WHEN value > 50 THEN 0.6 ELSE 0.35 END WHEN 3 THEN 0.7 WHEN 4 THEN CASE user_id % 5 WHEN 3 THEN 0.85 WHEN 4 THEN 0.9 ELSE 0.4 END
  WHEN 5 THEN CASE WHEN value * 100000 > 1048576 THEN 0.85 ELSE 0.55 END WHEN 6 THEN CASE WHEN user_id % 60 > 40 THEN 0.7 ELSE 0.45 END WHEN 7 THEN CASE WHEN value > 100 THEN 0.95 ELSE 0.5 END ELSE 0.0 END::DOUBLE AS risk FROM ev""")
def base_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("kind", derive.kind_name(F.col("event_id") % 8))
    domain = F.repeat(F.lit("x"), (F.col("user_id") % 60).cast("int"))
    risk = derive.base_risk(F.col("kind"), F.col("value") > 50, F.col("user_id") % 5, F.col("value") * 100000, domain, F.col("value") > 100)
    return rows.select("event_id", "kind", risk.alias("risk"))


@add(f"""SELECT event_id, CASE {_KIND} WHEN 'process_exec' THEN 'process_exec' WHEN 'file' THEN 'file' WHEN 'sql' THEN 'db_query' WHEN 'other' THEN 'agent_heartbeat' ELSE 'net' END AS family,
  CASE event_id % 8 WHEN 3 THEN 'tcp' WHEN 5 THEN 'tls' WHEN 6 THEN 'dns' WHEN 7 THEN 'tc' END AS protocol, CASE WHEN event_id % 8 = 6 THEN 53 ELSE user_id % 100 END::INTEGER AS port,
  CASE user_id % 3 WHEN 0 THEN 'mysql' WHEN 1 THEN 'postgresql' ELSE 'unknown' END AS engine, CASE user_id % 5 WHEN 1 THEN 'select' WHEN 2 THEN 'dml' WHEN 3 THEN 'ddl' WHEN 4 THEN 'admin' ELSE 'other' END AS operation FROM ev""")
def wire_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, port = derive.kind_name(F.col("event_id") % 8), F.col("user_id") % 100
    database = F.element_at(F.array(F.lit(3306), F.lit(5432), F.lit(9)), (F.col("user_id") % 3 + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", derive.wire_family(kind).alias("family"), derive.wire_protocol(kind).alias("protocol"), derive.wire_port(kind, port).alias("port"), derive.engine_of(database).alias("engine"), derive.operation_of(F.col("user_id") % 5).alias("operation"))


@add("""SELECT event_id, CASE WHEN rule <> '' THEN CASE WHEN value / 200 >= 0.8 THEN 'crit' WHEN value / 200 >= 0.4 THEN 'high' ELSE 'med' END WHEN kind = 'net' THEN 'med' WHEN kind = 'file' THEN CASE WHEN target = '/etc/Shadow' THEN 'high' ELSE 'low' END
  WHEN kind = 'db_query' THEN CASE WHEN op = 'ddl' THEN 'high' ELSE 'med' END ELSE 'low' END AS severity,
  CASE WHEN rule <> '' THEN 'rule r matched (pid=' || user_id || ')' WHEN kind = 'net' THEN 'proc ' || op || ' ' || target WHEN kind = 'file' THEN 'proc ' || op || ' ' || target WHEN kind = 'db_query' THEN 'proc ' || op || ' ' || target ELSE 'proc exec ' || target END AS description
  FROM (SELECT *, CASE event_type WHEN 'click' THEN 'net' WHEN 'error' THEN 'file' WHEN 'view' THEN 'db_query' ELSE 'process_exec' END AS kind, CASE WHEN event_id % 10 = 0 THEN 'r' ELSE '' END AS rule,
  CASE WHEN event_id % 3 = 0 THEN 'ddl' ELSE 'read' END AS op, CASE WHEN event_id % 2 = 0 THEN '/etc/Shadow' ELSE '/x' END AS target FROM ev)""")
def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, i = F.col("event_type"), F.col("event_id")
    kind = F.when(t == "click", "net").when(t == "error", "file").when(t == "view", "db_query").otherwise("process_exec")
    rule, op, target = F.when(i % 10 == 0, "r").otherwise(""), F.when(i % 3 == 0, "ddl").otherwise("read"), F.when(i % 2 == 0, "/etc/Shadow").otherwise("/x")
    severity = derive.console_severity(kind, rule, F.col("value") / 200, target, op)
    return events(spark, sf_dir).select("event_id", severity.alias("severity"), derive.console_description(kind, rule, F.col("user_id"), F.lit(None).cast("string"), op, target).alias("description"))


@add("SELECT event_id, CASE WHEN value > 50 AND user_id % 2 = 0 THEN 'block' WHEN value > 50 THEN 'would_block' ELSE 'allow' END AS verdict FROM ev")
def policy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", derive.policy_verdict(F.col("value") > 50, F.col("user_id") % 2 == 0).alias("verdict"))


@add("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'unreported' WHEN p_partkey % 5 = 0 OR p_size > 40 THEN 'stale' WHEN p_partkey % 3 = 0 THEN 'no_probes' WHEN p_size > 20 THEN 'degraded' ELSE 'healthy' END AS health FROM part")
def probe_health_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    probes = F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("exec")))
    return table(spark, sf_dir, "part").select("p_partkey", derive.probe_health(key % 7 != 0, key % 5 != 0, size, 40, probes, F.lit(20), size).alias("health"))


@add(f"""SELECT src, dst, dst_label, kind, n, risk FROM (SELECT user_id AS src, CASE WHEN event_id % 8 IN (3, 5, 7) THEN 167772160 + event_id % 9 WHEN event_id % 8 = 4 THEN 7000 + user_id WHEN event_id % 8 = 6 AND user_id % 2 = 1 THEN 9000 ELSE event_id % 100 END AS dst,
  CASE event_id % 8 WHEN 1 THEN 'process' WHEN 2 THEN 'file' WHEN 6 THEN 'domain' WHEN 3 THEN 'endpoint' WHEN 5 THEN 'endpoint' WHEN 7 THEN 'endpoint' ELSE 'host' END AS dst_label,
  CASE event_id % 8 WHEN 1 THEN 'spawned' WHEN 2 THEN 'read_file' WHEN 3 THEN 'connected_to' WHEN 5 THEN 'connected_to' WHEN 6 THEN 'resolved_dns' ELSE 'data_flow' END AS kind, count(*) AS n, max(least(value / 100, 1)) AS risk FROM ev GROUP BY ALL)""")
def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    rows = events(spark, sf_dir).select(derive.kind_name(i % 8).alias("kind"), u.alias("pid"), F.col("ts_ms").alias("ts"), (F.col("value") / 100).alias("risk"), (i % 100).alias("vertex"), (F.lit(167772160) + i % 9).alias("address"), (u + 7000).alias("statement_hash"), F.when(u % 2 == 1, F.lit(9000)).alias("domain_hash"))
    return graph.edges_of(rows).groupBy("src", "dst", "dst_label", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("risk").alias("risk"))


@add(f"""WITH {EV}, v AS (SELECT user_id AS id, max(value) AS risk, max(ts_ms) AS last_seen FROM ev WHERE event_type = 'view' GROUP BY 1), n AS (SELECT user_id AS id, 0.5::DOUBLE AS risk, max(ts_ms) AS last_seen FROM ev WHERE event_type = 'signup' AND user_id % 3 = 0 GROUP BY 1),
  r AS (SELECT user_id AS id, arg_max(value, ts_ms * 1000000 + event_id) AS risk, max(ts_ms * 1000000 + event_id) AS latest FROM ev WHERE event_type = 'error' GROUP BY 1)
  SELECT id, risk, last_seen FROM n UNION ALL SELECT v.id, coalesce(r.risk, v.risk), greatest(last_seen, coalesce(latest, last_seen)) FROM v LEFT JOIN r ON v.id = r.id WHERE v.id NOT IN (SELECT id FROM n)""")
def graph_delta_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices after a delta: new ones take an old one's place, the others take the latest risk."""
    rows, at = events(spark, sf_dir), F.col("ts_ms") * 1000000 + F.col("event_id")
    common = [F.lit("process").alias("label"), F.lit(False).alias("is_canary")]
    old = rows.filter("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.max("value").alias("risk"), F.max("ts_ms").alias("last_seen")).select("*", *common)
    new = rows.filter("event_type = 'signup' AND user_id % 3 = 0").groupBy(F.col("user_id").alias("id")).agg(F.lit(0.5).alias("risk"), F.max("ts_ms").alias("last_seen")).select("*", *common)
    risks = rows.filter("event_type = 'error'").select(F.col("user_id").alias("id"), F.col("value").alias("risk"), at.alias("at"))
    none = _edges(spark, sf_dir)
    return graph.merged(none, none, old, new, risks, ["ts", "seq"])[1].select("id", "risk", "last_seen")


@add("SELECT p_partkey, 'sales' AS database, 'a,' || replace(p_brand, '#', '_') AS tables FROM part WHERE p_size > 20 UNION ALL SELECT p_partkey, NULL, 'a,b' FROM part WHERE p_size <= 20")
def sql_unpack_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.when(F.col("p_size") > 20, F.concat(F.lit("sales.a,,"), F.regexp_replace("p_brand", "#", "_"))).otherwise("x.a,y.b")
    found = text.unpack_tables(packed)
    return table(spark, sf_dir, "part").select("p_partkey", found["database"].alias("database"), F.array_join(found["tables"], ",").alias("tables"))


@add(f"SELECT p_partkey, (list_reduce(list_prepend(5381::HUGEINT, {_BYTES}::HUGEINT[]), lambda h, b: (h * 33 + b) % 18446744073709551616) % 32)::INTEGER AS shard FROM (SELECT p_partkey, p_name || 'é' || p_type AS t FROM part)")
def djb2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.djb2_shard(F.concat("p_name", F.lit("é"), "p_type")).alias("shard"))


# --- motifs, dense ids, digests, failover, the console's filter -----------------------------------------------------------

_KINDS = f"{_LINKS}, k AS (SELECT src, dst, ['calls', 'reads', 'writes'][(src + dst) % 3 + 1] AS kind FROM l)"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = F.array(*map(F.lit, ("calls", "reads", "writes")))
    return _links(spark, sf_dir).select("src", "dst", F.element_at(of, ((F.col("src") + F.col("dst")) % 3 + 1).cast("int")).alias("kind"))


@add(f"WITH {EV}, {_KINDS} SELECT a.src AS x, a.dst AS y, b.dst AS z FROM k a JOIN k b ON a.dst = b.src WHERE a.kind = 'calls' AND b.kind = 'reads' AND a.src <> a.dst AND b.dst NOT IN (a.src, a.dst)")
def motif_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.motif(_kinds(spark, sf_dir), [("x", "calls", "y"), ("y", "reads", "z")])


@add(f"""WITH {EV}, {_KINDS} SELECT a.src AS x, a.dst AS y, b.dst AS z FROM k a JOIN k b ON a.dst = b.src JOIN k c ON c.src = b.dst AND c.dst = a.src
  WHERE a.kind = 'calls' AND b.kind = 'reads' AND c.kind = 'writes' AND a.src <> a.dst AND b.dst NOT IN (a.src, a.dst)""")
def motif_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.motif(_kinds(spark, sf_dir), [("x", "calls", "y"), ("y", "reads", "z"), ("z", "writes", "x")])


@add("""SELECT event_type AS label, count(DISTINCT user_id) AS n, 0::BIGINT AS least, count(DISTINCT user_id) - 1 AS most, count(DISTINCT user_id) AS numbers, count(DISTINCT user_id) FILTER (ts < TIMESTAMP '2024-01-08') AS unchanged FROM ev GROUP BY 1""")
def dense_vertex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the users of each kind of event: those of the first week keep theirs when the rest comes."""
    rows = events(spark, sf_dir)
    vertices = lambda r: r.select(F.col("event_type").alias("label"), F.col("user_id").alias("id")).distinct()
    first = graph.dense_ids(vertices(rows.filter(F.col("ts") < F.lit("2024-01-08").cast("timestamp"))), each=100)
    now = graph.dense_ids(vertices(rows), first, each=100)
    same = now.join(first.withColumnRenamed("number", "before"), ["label", "id"], "left").withColumn("same", (F.col("number") == F.col("before")).cast("long"))
    facts = same.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("least"), F.max("number").alias("most"), F.countDistinct("number").alias("numbers"), F.coalesce(F.sum("same"), F.lit(0)).alias("unchanged"))
    return facts


@add("SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, true AS p50_close, true AS p95_close FROM ev GROUP BY 1")
def digest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of an hour merge to digests of a day and these to one of all: quantiles lie within 3 % of their rank."""
    rows = events(spark, sf_dir)
    hours = aggregates.digests(rows, ["event_type", F.date_trunc("hour", "ts").alias("hour")], "value")
    days = aggregates.merged_digests(hours, ["event_type", F.date_trunc("day", "hour").alias("day")])
    found = aggregates.digest_quantiles(aggregates.merged_digests(days, ["event_type"]), {"p50": 0.5, "p95": 0.95})
    below = lambda q: F.avg((F.col("value") <= F.col(q)).cast("double"))
    exact = rows.join(F.broadcast(found), "event_type").groupBy("event_type").agg(*((F.abs(below(q) - x) <= 0.03).alias(f"{q}_close") for q, x in (("p50", 0.5), ("p95", 0.95))))
    return found.join(exact, "event_type").select("event_type", "n", "min", "max", "p50_close", "p95_close")


_SESSIONS = """s AS MATERIALIZED (SELECT o_orderkey AS session_id, o_custkey % 7 AS tenant_id, 'r' || (o_orderkey % 3) AS region, o_custkey % 40 AS gateway_id FROM orders WHERE o_orderstatus <> 'F'),
  g AS MATERIALIZED (SELECT x AS gateway_id, CASE WHEN x % 4 = 0 THEN x % 7 END AS tenant_id, 'r' || (x % 3) AS region, (SELECT count(*) FROM s) // 45 * (20 + x) // 30 AS capacity, x % 5 <> 0 AS healthy FROM range(40) r(x)),
  free AS MATERIALIZED (SELECT gateway_id, tenant_id AS owner, region AS area, capacity, taken FROM (SELECT g.*, (SELECT count(*) FROM s WHERE s.gateway_id = g.gateway_id) AS load FROM g WHERE healthy) f, unnest(range(load, capacity)) u(taken) WHERE load < capacity),
  t0 AS MATERIALIZED (SELECT * FROM s WHERE gateway_id IN (SELECT gateway_id FROM g WHERE NOT healthy))"""
_ROUNDS = [("tenant_id || '/' || region", "owner || '/' || area", "owner IS NOT NULL"), ("region", "area", "owner IS NULL"), ("tenant_id::VARCHAR", "owner::VARCHAR", "owner IS NOT NULL"), ("'all'", "'all'", "owner IS NULL")]


def _failover_sql() -> str:
    steps, places = "", "free"
    for n, (of_session, of_place, wanted) in enumerate(_ROUNDS):
        steps += f""", m{n} AS MATERIALIZED (SELECT session_id, p.gateway_id AS new_gateway, taken FROM (SELECT session_id, {of_session} AS pool, row_number() OVER (PARTITION BY {of_session} ORDER BY session_id) AS i FROM t{n}) a
  JOIN (SELECT *, {of_place} AS pool, row_number() OVER (PARTITION BY {of_place} ORDER BY taken::DOUBLE / capacity, gateway_id) AS i FROM {places} WHERE {wanted}) p USING (pool, i)),
  t{n + 1} AS MATERIALIZED (SELECT * FROM t{n} WHERE session_id NOT IN (SELECT session_id FROM m{n})),
  p{n + 1} AS MATERIALIZED (SELECT * FROM {places} f WHERE NOT EXISTS (SELECT 1 FROM m{n} m WHERE m.new_gateway = f.gateway_id AND m.taken = f.taken))"""
        places = f"p{n + 1}"
    moved = " UNION ALL ".join(f"SELECT new_gateway FROM m{n}" for n in range(4))
    return f"WITH {_SESSIONS}{steps} SELECT new_gateway, count(*) AS sessions FROM ({moved} UNION ALL SELECT NULL FROM t4) GROUP BY 1"


@add(_failover_sql())
def session_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sessions each healthy gateway takes over, and (null) how many stay because nothing is free."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    sessions = orders.select(F.col("o_orderkey").alias("session_id"), (F.col("o_custkey") % 7).alias("tenant_id"), F.concat(F.lit("r"), F.col("o_orderkey") % 3).alias("region"), (F.col("o_custkey") % 40).alias("gateway_id"), F.lit("ACTIVE").alias("state"))
    x, each = F.col("id"), orders.count() // 45
    gateways = spark.range(40).select(x.alias("gateway_id"), F.when(x % 4 == 0, x % 7).alias("tenant_id"), F.concat(F.lit("r"), x % 3).alias("region"), F.floor(F.lit(each) * (x + 20) / 30).alias("capacity"), (x % 5 != 0).alias("healthy"))
    return derive.failed_over(sessions, gateways).groupBy("new_gateway").agg(F.count(F.lit(1)).alias("sessions"))


#: Filter lines, and what they say in SQL over the rows as `_console_rows` has them.
_LINES = {
    "eq": ("comm == 'BASH'", "comm = 'bash'"), "ne": ("event.comm != bash", "comm <> 'bash'"), "gt": ("port > 50", "port > 50"), "ge": ("net.dst_port >= 50", "port >= 50"), "lt": ("k < 7.5", "k::DOUBLE < 7.5"),
    "le": ("attrs.k <= 7", "k::DOUBLE <= 7"), "part": ("kind ~ LIC", "event_type = 'click'"), "all_of": ("name ~ ur and k > 10 AND port < 90", "comm = 'curl' AND k::DOUBLE > 10 AND port < 90"),
    "free": ("curl and purchase", "comm = 'curl' AND event_type = 'purchase'"), "no_field": ("nothing != x", "false"), "no_number": ("comm > 5", "false"), "empty": ("  ", "true"),
}


@add(f"SELECT event_id, {', '.join(f'coalesce({sql}, false) AS {n}' for n, (_, sql) in _LINES.items())} FROM (SELECT *, ['bash', 'curl', NULL, 'vim'][event_id % 4 + 1] AS comm, CASE WHEN event_id % 3 = 0 THEN (user_id % 100) END AS port FROM ev)")
def console_filter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven operators, several clauses, free text and names by their short form."""
    i = F.col("event_id")
    comm = F.element_at(F.array(F.lit("bash"), F.lit("curl"), F.lit(None), F.lit("vim")), (i % 4 + 1).cast("int"))
    rows = events(spark, sf_dir).select("event_id", F.col("event_type").alias("event_kind"), F.struct(comm.alias("comm"), F.when(i % 3 == 0, F.col("user_id") % 100).alias("dst_port"), "attrs").alias("event"))
    return rows.select("event_id", *(console.condition(rows, line).alias(n) for n, (line, _) in _LINES.items()))


@add("""SELECT event_id, CASE event_type WHEN 'click' THEN 'curl net ' || CASE WHEN u % 3 = 0 THEN 'unknown-dst' WHEN u % 3 = 1 THEN '10.0.0.' || u ELSE '10.0.0.' || u || ':' || i END
    WHEN 'view' THEN 'curl query ' || CASE WHEN u % 2 = 0 THEN 'pg/shop' ELSE 'db' END || CASE WHEN i % 3 = 0 THEN '' ELSE ' on a, b' END WHEN 'error' THEN 'heartbeat read=' || i || ' dropped=0' ELSE 'curl exec /x' END AS description
  FROM (SELECT event_id, event_type, user_id AS u, event_id % 1000 + 1 AS i FROM ev)""")
def console_lines_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with ports, engine and database with their tables, a heartbeat's counts."""
    t, u, i = F.col("event_type"), F.col("user_id"), F.col("event_id") % 1000 + 1
    kind = F.when(t == "click", "net").when(t == "view", "db_query").when(t == "error", "agent_heartbeat").otherwise("process_exec")
    address = derive.endpoint_target(F.when(u % 3 != 0, F.concat(F.lit("10.0.0."), u.cast("string"))), F.when(u % 3 == 2, i).otherwise(0))
    tables = F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    of_base = lambda x: F.when(u % 2 == 0, x).otherwise("")
    target = F.when(kind == "net", address).when(kind == "db_query", derive.database_target(of_base("pg"), of_base("shop"), tables)).otherwise("/x")
    nothing = F.lit(None).cast("string")
    return events(spark, sf_dir).select("event_id", derive.console_description(kind, nothing, u, F.lit("curl"), nothing, target, read=i).alias("description"))


# --- sessions, inventories and lookups beside events -----------------------------------------------------------------------


@add("SELECT e.event_id, o.o_orderkey AS session_id FROM ev e JOIN orders o ON o.o_custkey % 3 = e.tenant_id AND o.o_custkey = e.user_id WHERE e.event_type = 'error' AND o.o_orderstatus <> 'F'")
def alerts_with_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "TERMINATED").otherwise("ACTIVE")
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_custkey") % 3).alias("tenant_id"), F.col("o_custkey").alias("host_id"), state.alias("state"))
    alerts = events(spark, sf_dir).filter("event_type = 'error'").select("event_id", "tenant_id", F.col("user_id").alias("host_id"))
    return derive.alerts_of_sessions(alerts, sessions).select("event_id", "session_id")


@add("SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 500 <= 200 - 60 THEN 'expired' WHEN 200 - o_custkey % 300 > 60 THEN 'stale' END AS fault FROM orders")
def session_fault_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderkey") % 500).alias("expires_s"), (F.col("o_custkey") % 300).alias("heartbeat_s"))
    return derive.session_faults(sessions, F.lit(200), 60).select("session_id", "fault")


@add("SELECT c_custkey AS id, coalesce(s_nationkey < 5, false) AS is_canary FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def canary_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") < 5).alias("is_canary"))
    return graph.canaries(vertices, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@add("SELECT event_id FROM ev WHERE tenant_id = 1 AND event_type = 'error' AND k LIKE '%7%'")
def alerts_by_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("K="), F.regexp_replace(source.attribute(F.col("attrs"), "k"), "7", "seven"))
    alerts = events(spark, sf_dir).select("event_id", "tenant_id", F.lit("high").alias("severity"), F.col("event_type").alias("rule_id"), message.alias("message"))
    return tables.filtered_alerts(alerts, tenant=1, severity="high", rule="error", text="SEVEN").select("event_id")


@add(f"WITH {_EDGES}, m AS (SELECT src, dst, kind, ts, seq FROM e WHERE seq % 2 = 0 UNION ALL SELECT src, dst, 'new', ts, seq FROM e WHERE seq % 2 = 1) SELECT src, dst, kind, ts, seq FROM m QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY ts DESC, seq DESC) = 1")
def graph_delta_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    vertices = spark.createDataFrame([], "id long, label string, risk double, last_seen long, is_canary boolean")
    old, new = edges.filter("seq % 2 = 0"), edges.filter("seq % 2 = 1").withColumn("kind", F.lit("new"))
    return graph.merged(old, new, vertices, vertices, spark.createDataFrame([], "id long, risk double, at long"), ["ts", "seq"])[0]


@add("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN lpad(user_id::VARCHAR, 64, '0') END AS container_id, CASE WHEN user_id % 3 = 1 THEN lpad(user_id::VARCHAR, 8, '0') || '-0000-0000-0000-00000000000a' END AS pod_uid FROM ev""")
def cgroup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, text_of = F.col("user_id"), F.col("user_id").cast("string")
    path = F.when(u % 3 == 0, F.concat(F.lit("/docker/"), F.lpad(text_of, 64, "0"))).when(u % 3 == 1, F.concat(F.lit("/kubepods/pod"), F.lpad(text_of, 8, "0"), F.lit("_0000_0000_0000_00000000000a"))).otherwise(F.lit("/user.slice"))
    rows = events(spark, sf_dir).select("event_id", u.alias("cgroup_id"))
    cgroups = events(spark, sf_dir).filter(u % 3 != 2).select(u.alias("cgroup_id"), path.alias("path"))
    return derive.with_cgroups(rows, cgroups).select("event_id", "container_id", "pod_uid")


@add("SELECT row_number() OVER (ORDER BY p_size > 25 DESC, p_retailprice DESC, p_partkey)::INTEGER AS place, p_partkey AS id, (SELECT sum(p_size) FROM part)::BIGINT AS bytes FROM part QUALIFY place <= 20")
def program_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty programs of the inventory, and the memory of all."""
    programs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") > 25).alias("attributed"), F.col("p_retailprice").alias("run_count"), F.col("p_size").alias("bytes_memlock"))
    rows, total = derive.inventory(programs)
    first = rows.limit(20).withColumn("place", F.row_number().over(Window.orderBy(F.desc("attributed"), F.desc("run_count"), "id")).cast("int"))
    return first.select("place", "id").join(F.broadcast(total.select(F.col("bytes").cast("long").alias("bytes"))))


_KEYS = "t AS (SELECT o_orderkey AS session_id, o_custkey % 7 AS tenant_id, o_orderstatus AS state FROM orders), m AS (SELECT l_orderkey AS session_id, l_linenumber AS key_id, CASE WHEN l_returnflag = 'R' THEN 1 END AS revoked_at FROM lineitem)"


def _session_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    state = F.when(F.col("o_orderstatus") == "F", "TERMINATED").otherwise("ACTIVE")
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_custkey") % 7).alias("tenant_id"), state.alias("state"))
    return sessions, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("key_id"), F.when(F.col("l_returnflag") == "R", 1).alias("revoked_at"))


@add(f"WITH {_KEYS} SELECT session_id, key_id FROM t JOIN m USING (session_id) WHERE state <> 'F' AND revoked_at IS NULL")
def session_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.peers(*_session_keys(spark, sf_dir)).select("session_id", "key_id")


@add(f"WITH {_KEYS} SELECT tenant_id, count(key_id) FILTER (WHERE revoked_at IS NULL) AS active_keys FROM t LEFT JOIN m USING (session_id) GROUP BY 1")
def session_active_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.active_keys(*_session_keys(spark, sf_dir))


_DUMP = f"""WITH {_EDGES}, l AS (SELECT src, dst, count(*) AS n FROM e GROUP BY 1, 2), r AS (SELECT event_id AS src, user_id AS dst, event_id % 50 AS parent, 'c' || event_id AS comm FROM (WITH {EV} SELECT * FROM ev WHERE event_type = 'error' AND value > 150)),
  v AS (SELECT c_custkey AS id, 'Process' AS label FROM customer UNION ALL SELECT 1000000 + s_suppkey, 'Endpoint' FROM supplier), named AS (SELECT src AS id FROM l UNION SELECT dst FROM l UNION SELECT src FROM r UNION SELECT dst FROM r UNION SELECT parent FROM r)"""


def _dump(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    flags = [F.lit(0.5).alias("risk"), F.lit(True).alias("is_internal"), F.lit(False).alias("is_canary")]
    vertices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("Process").alias("label"), *flags)
    vertices = vertices.unionByName(table(spark, sf_dir, "supplier").select((F.lit(1000000) + F.col("s_suppkey")).alias("id"), F.lit("Endpoint").alias("label"), *flags))
    edges = _edges(spark, sf_dir).groupBy("src", "dst").agg(F.lit("link").alias("kind"), F.lit(1.0).alias("risk"), F.max("seq").alias("ts"))
    i = F.col("event_id")
    recent = events(spark, sf_dir).filter("event_type = 'error' AND value > 150").select(i.alias("src"), F.col("user_id").alias("dst"), (i % 50).alias("parent"), "event_type", F.concat(F.lit("c"), i.cast("string")).alias("comm"), F.lit(2.0).alias("risk"), F.col("ts_ms").alias("ts"))
    return graph.dump(vertices, edges, recent)


@add(f"{_DUMP} SELECT id, CASE WHEN label = 'Endpoint' THEN 'Endpoint #' || id WHEN comm IS NOT NULL THEN 'Process ' || comm || ' (#' || id || ')' ELSE 'Process #' || id END AS display_label, coalesce(o.n, 0) AS out_degree FROM v SEMI JOIN named USING (id) LEFT JOIN (SELECT src AS id, count(*) AS n FROM l GROUP BY 1) o USING (id) LEFT JOIN (SELECT src AS id, comm FROM r) c USING (id)")
def graph_dump_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dump(spark, sf_dir)[0].select("id", "display_label", "out_degree")


@add(f"{_DUMP} SELECT src, dst, 'link' AS kind, 'graph' AS origin FROM l UNION ALL SELECT src, dst, 'event.error', 'event' FROM r")
def graph_dump_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dump(spark, sf_dir)[1].select("src", "dst", "kind", "origin")


@add(f"""WITH {EV}, {_KINDS}, v AS (SELECT user_id AS id, user_id % 3 AS tenant_id, max(value) AS risk FROM ev GROUP BY 1)
  SELECT x.id AS x, y.id AS y, z.id AS z, (40 + CASE WHEN y.risk > x.risk THEN 20 ELSE 0 END)::INTEGER AS score FROM k a JOIN k b ON a.dst = b.src JOIN v x ON x.id = a.src JOIN v y ON y.id = a.dst JOIN v z ON z.id = b.dst
  WHERE a.kind = 'calls' AND b.kind = 'calls' AND a.src <> a.dst AND b.dst NOT IN (a.src, a.dst) AND x.tenant_id = y.tenant_id AND x.tenant_id = z.tenant_id AND x.risk > 100 AND z.risk > 120""")
def rule_over_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule whose sources are vertices and whose graph clause is a path of two edges."""
    u = F.col("user_id")
    vertices = events(spark, sf_dir).groupBy(u.alias("id"), (u % 3).alias("tenant_id")).agg(F.lit("user").alias("label"), F.max("value").alias("risk"), F.max("ts_ms").alias("last_seen"))
    risk = lambda alias: field(f"{alias}.risk")
    rule = Rule("path", "Path", (Source("x", "user", risk("x") > 100), Source("y", "user"), Source("z", "user")), graph=(("x", "calls", "y"), ("y", "calls", "z")), where=(risk("z") > 120,), base=40, modifiers=((20, risk("y") > risk("x")),))
    return rules.graph_alerts(rule, vertices, _kinds(spark, sf_dir)).select("x.id", F.col("y.id").alias("y"), F.col("z.id").alias("z"), "score").withColumnRenamed("id", "x")
