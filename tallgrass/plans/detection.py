"""Queries of the rule side: predicates, correlation, memory and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import numeric, text, twovalued
from tallgrass.operators import joins, rules, standard, stateful, tables
from tallgrass.operators.callables import call
from tallgrass.operators.conditions import attribute, field, first_seen, has_fact, rare, rate
from tallgrass.operators.rules import Branch, Fact, Rule, Source
from tallgrass.plans.common import EV, Registry, events, table
from tallgrass.sources import events as source
from tallgrass.sources.catalog import Catalog, Entry

registry = Registry()
add = registry.add

FLAGSHIP = Rule(
    rule_id="error_then_purchase",
    name="Purchase close to an error of the same user",
    sources=(Source("e", "error"), Source("p", "purchase")),
    on=(("e.user_id", "p.user_id"),),
    within="1h",
    where=(field("p.value") > 0,),
    let=(("big", field("p.value") > 100), ("quick", abs(field("p.ts_ms") - field("e.ts_ms")) <= 600000)),
    base=50,
    modifiers=((20, field("big").is_true()), (15, field("quick").is_true())),
    require=(field("score") >= 50,),
    emit=(Fact("user.risky_purchase", (field("e.user_id"),), "6h"),),
    respond=(
        Branch(field("score") >= 80, (("alert", "critical"), ("block_egress", "p.user_id"), ("open_case", "Purchase after error"))),
        Branch(field("score") >= 60, (("alert", "high"), ("snapshot", "e, p"))),
        Branch(None, (("alert", "medium"),)),
    ),
)
_PAIRS = f"""WITH {EV}, pairs AS (SELECT e.tenant_id, e.user_id, e.event_id AS e_id, p.event_id AS p_id, e.ts_ms AS e_ms, p.ts_ms AS p_ms, p.value,
  50 + CASE WHEN p.value > 100 THEN 20 ELSE 0 END + CASE WHEN abs(p.ts_ms - e.ts_ms) <= 600000 THEN 15 ELSE 0 END AS score
  FROM ev e JOIN ev p ON e.user_id = p.user_id AND abs(p.ts_ms - e.ts_ms) <= 3600000 WHERE e.event_type = 'error' AND p.event_type = 'purchase' AND p.value > 0)"""


@add(f"""{_PAIRS} SELECT 'error_then_purchase' AS rule_id, tenant_id, user_id, e_id AS error_event_id, p_id AS purchase_event_id, score::INTEGER AS score,
  CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' ELSE 'medium' END AS severity, abs(p_ms - e_ms) AS gap_ms FROM pairs""")
def rule_correlate_error_then_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.run(FLAGSHIP, events(spark, sf_dir))
    return rows.select("rule_id", "tenant_id", F.col("e.user_id").alias("user_id"), F.col("e.event_id").alias("error_event_id"), F.col("p.event_id").alias("purchase_event_id"), "score", "severity", F.abs(F.col("p.ts_ms") - F.col("e.ts_ms")).alias("gap_ms"))


@add(f"""{_PAIRS} SELECT e_id, p_id, score >= 80 AS block_egress, false AS block_query, CASE WHEN score >= 80 THEN 'alert,block_egress,open_case' WHEN score >= 60 THEN 'alert,snapshot' ELSE 'alert' END AS actions FROM pairs""")
def enforcement_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.run(FLAGSHIP, events(spark, sf_dir))
    return rows.select(F.col("e.event_id").alias("e_id"), F.col("p.event_id").alias("p_id"), "block_egress", "block_query", F.array_join(F.transform("actions", lambda a: a["action"]), ",").alias("actions"))


@add(f"{_PAIRS} SELECT e_id, p_id, tenant_id, 'user.risky_purchase' AS fact, user_id::VARCHAR AS arg, greatest(e_ms, p_ms) AS emitted_ms, greatest(e_ms, p_ms) + 21600000 AS expires_ms FROM pairs")
def emit_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.run(FLAGSHIP, events(spark, sf_dir))
    return rules.facts(FLAGSHIP, rows, keep=("e.event_id AS e_id", "p.event_id AS p_id")).select("e_id", "p_id", "tenant_id", "fact", F.get("args", 0).alias("arg"), "emitted_ms", "expires_ms")


_SINGLE = Rule("large_error", "Large error", (Source("e", "error"),), where=(field("e.value") > 100,), base=70, modifiers=((15, field("e.value") > 200), (-20, attribute("e.attrs", "k", "long") % 2 == 0)))


@add("""SELECT event_id, (70 + CASE WHEN value > 200 THEN 15 ELSE 0 END - CASE WHEN k::BIGINT % 2 = 0 THEN 20 ELSE 0 END)::INTEGER AS score
  FROM ev WHERE event_type = 'error' AND value > 100""")
def score_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scored(_SINGLE, rules.correlated(_SINGLE, events(spark, sf_dir))).select("e.event_id", "score")


@add("""SELECT event_id, CASE WHEN s >= 80 THEN 'critical' WHEN s >= 60 THEN 'high' ELSE 'medium' END AS severity FROM
  (SELECT event_id, 70 + CASE WHEN value > 200 THEN 15 ELSE 0 END - CASE WHEN k::BIGINT % 2 = 0 THEN 20 ELSE 0 END AS s FROM ev WHERE event_type = 'error' AND value > 100)""")
def default_action_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.run(_SINGLE, events(spark, sf_dir)).select("e.event_id", "severity")


@add("""SELECT event_id, CASE WHEN value > 200 THEN 'critical' WHEN value > 100 THEN 'high' ELSE 'informational' END AS severity FROM ev WHERE event_type = 'error'""")
def respond_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("branches", "Branches", (Source("e", "error"),), respond=(Branch(field("e.value") > 200, (("alert", "critical"), ("isolate", "host"))), Branch(field("e.value") > 100, (("alert", "high"),)), Branch(None, (("alert", "informational"),))))
    return rules.run(rule, events(spark, sf_dir)).select("e.event_id", "severity")


@add("""SELECT event_id, CASE WHEN r >= 0.9 THEN 'critical' WHEN r >= 0.7 THEN 'high' WHEN r >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM
  (SELECT event_id, least(value / 200, 1) AS r FROM ev)""")
def severity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.least(F.col("value") / 200, F.lit(1.0))
    return events(spark, sf_dir).select("event_id", F.when(r >= 0.9, "critical").when(r >= 0.7, "high").when(r >= 0.4, "medium").otherwise("low").alias("severity"))


# --- predicates: null-safe on rows with an attribute that is missing in every fifth row ----------------------------------

_NULLED = "SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 5 <> 0 THEN k END AS k, (CASE WHEN event_id % 5 <> 0 THEN k END)::BIGINT AS n FROM ev"


def _over(select: str) -> str:
    return f"SELECT {select} FROM (WITH {EV} {_NULLED}) x"


def _nulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("event_id") % 5 != 0, source.attribute(F.col("attrs"), "k"))
    return events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", k.alias("k"), k.try_cast("long").alias("n"))


@add(_over("event_id, k IS NOT DISTINCT FROM '3' AS is_3, k IS DISTINCT FROM '3' AS not_3, k IS NULL AS is_null"))
def pred_eq_ne_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _nulled(spark, sf_dir).select("event_id", twovalued.eq(k, "3").alias("is_3"), twovalued.ne(k, "3").alias("not_3"), twovalued.eq(k, F.lit(None).cast("string")).alias("is_null"))


@add(_over("event_id, coalesce(n < 50, false) AS lt, coalesce(n > 50, false) AS gt, coalesce(n < 50, false) OR n IS NOT DISTINCT FROM 50 AS le, coalesce(n >= 50, false) AS ge_agent"))
def pred_order_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return _nulled(spark, sf_dir).select("event_id", twovalued.lt(n, 50).alias("lt"), twovalued.gt(n, 50).alias("gt"), twovalued.le(n, 50).alias("le"), twovalued.ge(n, 50, "agent").alias("ge_agent"))


@add(_over("event_id, coalesce(k IN ('1', '2', '3'), false) AS found, k IS NULL OR k IN ('1', '2') AS found_null"))
def pred_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nulled(spark, sf_dir).select("event_id", twovalued.is_in(F.col("k"), ["1", "2", "3"]).alias("found"), twovalued.is_in(F.col("k"), ["1", "2", None]).alias("found_null"))


@add(_over("event_id") + " WHERE NOT coalesce(k IN ('1', '2', '3'), false)")
def pred_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nulled(spark, sf_dir).filter(twovalued.not_in(F.col("k"), ["1", "2", "3"])).select("event_id")


@add(_over("event_id, coalesce(contains(k, '1'), false) AS has_1, contains(coalesce(k, ''), '') AS agent_has_empty"))
def pred_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nulled(spark, sf_dir).select("event_id", twovalued.contains(F.col("k"), "1").alias("has_1"), twovalued.contains(F.col("k"), "", "agent").alias("agent_has_empty"))


@add("SELECT p_partkey, starts_with(p_name, 'part') AS pre, ends_with(p_type, 'L') AS suf FROM part")
def pred_prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", twovalued.starts_with(F.col("p_name"), "part").alias("pre"), twovalued.ends_with(F.col("p_type"), "L").alias("suf"))


@add("SELECT page_id, starts_with(url, 'https://a') OR starts_with(url, 'http://') AS hit FROM pages")
def pred_under_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", twovalued.under(F.col("url"), ["https://a", "http://"]).alias("hit"))


@add("SELECT page_id, regexp_matches(url, '^https?://[^/]*e.*/.*[0-9]$') AS hit, regexp_matches(url, '^.*e.*.5$', 's') AS glob FROM pages")
def pred_matches_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", twovalued.matches(F.col("url"), "^https?://[^/]*e.*/.*[0-9]$").alias("hit"), twovalued.matches(F.col("url"), "*e*?5", "agent").alias("glob"))


@add("SELECT event_id, event_type IN ('view', 'click', 'error') AS hit, event_type IN ('view', 'error') AS listed FROM ev")
def pred_matches_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return events(spark, sf_dir).select("event_id", twovalued.matches(kind, "(vie?|click|err*)", "agent").alias("hit"), twovalued.matches(kind, ["v?ew", "error"], "agent").alias("listed"))


@add(_over("event_id") + " WHERE (coalesce(n > 10, false) AND NOT (event_type = 'view' OR coalesce(n > 90, false))) OR NOT coalesce(value > 1, false)")
def pred_bool_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = F.col("n"), twovalued
    return _nulled(spark, sf_dir).filter((t.gt(n, 10) & ~(t.eq(F.col("event_type"), "view") | t.gt(n, 90))) | ~t.gt(F.col("value"), 1)).select("event_id")


@add(_over("event_id, coalesce(n BETWEEN 10 AND 20, false) AS inside"))
def pred_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nulled(spark, sf_dir).select("event_id", twovalued.between(F.col("n"), 10, 20).alias("inside"))


@add("SELECT event_id FROM ev WHERE lower(event_type) = 'error' AND user_id::VARCHAR LIKE '%1%' AND contains(lower(event_type || ' ' || user_id::VARCHAR || ' ' || coalesce(k, '')), '7')")
def pred_console_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field equals, a field contains, and free text over the displayed columns, all case-insensitive."""
    shown = F.lower(F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), source.attribute(F.col("attrs"), "k")))
    rows = events(spark, sf_dir).filter((F.lower("event_type") == "error") & F.lower(F.col("user_id").cast("string")).contains("1"))
    return rows.filter(shown.contains("7")).select("event_id")


@add("SELECT event_id, k::BIGINT AS n, CASE WHEN k IN ('true', 'false') THEN k END AS flag, NULL::VARCHAR AS missing FROM ev")
def attrs_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("attrs")
    return events(spark, sf_dir).select("event_id", source.attribute(a, "k", "long").alias("n"), F.when(source.attribute(a, "k").isin("true", "false"), source.attribute(a, "k")).alias("flag"), source.attribute(a, "none").alias("missing"))


@add("SELECT event_id, tenant_id FROM ev WHERE tenant_id IN (0, 2)")
def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.col("tenant_id").isin(0, 2)).select("event_id", "tenant_id")


# --- joins ---------------------------------------------------------------------------------------------------------------

def _pair_rule(**more) -> Rule:
    return Rule("pair", "Pair", (Source("a", "signup"), Source("b", "click")), **({"within": "30m"} | more))


def _ids(rows: DataFrame, *aliases: str) -> DataFrame:
    return rows.select(*(F.col(f"{a}.event_id").alias(a) for a in aliases))


@add(f"WITH {EV} SELECT a.event_id AS a, b.event_id AS b FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.ts_ms - b.ts_ms) <= 1800000 WHERE a.event_type = 'signup' AND b.event_type = 'click'")
def join_interval_2way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(rules.correlated(_pair_rule(on=(("a.user_id", "b.user_id"),)), events(spark, sf_dir)), "a", "b")


@add(f"""WITH {EV}, t AS (SELECT a.event_id AS a, b.event_id AS b, c.event_id AS c, a.ts_ms AS x, b.ts_ms AS y, c.ts_ms AS z,
  CASE WHEN a.event_id > b.event_id AND a.event_id > c.event_id THEN a.ts_ms WHEN b.event_id > c.event_id THEN b.ts_ms ELSE c.ts_ms END AS last
  FROM ev a JOIN ev b USING (user_id) JOIN ev c USING (user_id) WHERE a.event_type = 'signup' AND b.event_type = 'click' AND c.event_type = 'error')
  SELECT a, b, c FROM t WHERE abs(x - last) <= 7200000 AND abs(y - last) <= 7200000 AND abs(z - last) <= 7200000""")
def join_interval_3way(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("three", "Three", (Source("a", "signup"), Source("b", "click"), Source("c", "error")), on=(("a.user_id", "b.user_id"), ("b.user_id", "c.user_id")), within="2h")
    return _ids(rules.correlated(rule, events(spark, sf_dir)), "a", "b", "c")


@add(f"WITH {EV} SELECT a.event_id AS a, b.event_id AS b FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.ts_ms - b.ts_ms) <= 1800000 WHERE a.event_type = 'signup' AND b.event_type = 'click'")
def join_fallback_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(rules.correlated(_pair_rule(), events(spark, sf_dir)), "a", "b")


@add(f"WITH {EV} SELECT a.event_id AS a, b.event_id AS b FROM ev a JOIN ev b ON a.k = b.k AND a.tenant_id = b.tenant_id AND abs(a.ts_ms - b.ts_ms) <= 1800000 WHERE a.event_type = 'signup' AND b.event_type = 'click'")
def join_cross_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("k", source.attribute(F.col("attrs"), "k"))
    return _ids(rules.correlated(_pair_rule(on=(("a.k", "b.k"),)), rows), "a", "b")


@add(f"WITH {EV} SELECT a.event_id AS a, b.event_id AS b FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(a.ts_ms - b.ts_ms) <= 600000 WHERE a.event_type = 'error' AND b.event_type = 'error'")
def join_self_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("self", "Self", (Source("a", "error"), Source("b", "error")), on=(("a.user_id", "b.user_id"),), within="10m")
    return _ids(rules.correlated(rule, events(spark, sf_dir)), "a", "b")


@add(f"WITH {EV} SELECT a.event_id AS a, b.event_id AS b FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.ts_ms - a.ts_ms BETWEEN 0 AND 3600000 WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def match_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("seq", "Sequence", (Source("a", "view"), Source("b", "purchase")), on=(("a.user_id", "b.user_id"),), within="1h", ordered=True)
    return _ids(rules.correlated(rule, events(spark, sf_dir)), "a", "b")


@add(f"WITH {EV} SELECT a.event_id AS a, b.event_id AS b FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.ts_ms - b.ts_ms) <= 600000 WHERE a.event_type = 'view' AND b.event_type = 'error'")
def around_entity_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("around", "Around", (Source("a", "view"), Source("b", "error")), within="10m")
    return _ids(rules.correlated(rule, events(spark, sf_dir)), "a", "b")


_BRANDS = "SELECT DISTINCT p_brand FROM part WHERE p_size > 45"


@add(f"SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) IN (SELECT lower(p_brand) FROM ({_BRANDS}))")
def join_semi_ioc(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    feed = part.filter("p_size > 45").select(F.col("p_brand").alias("entry"))
    return joins.in_set(part, F.col("p_brand"), feed).select("p_partkey", "p_brand")


@add("SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def join_anti_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    named = table(spark, sf_dir, "supplier").join(F.broadcast(nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")), "s_nationkey")
    return joins.in_set(named, F.col("n_name"), nation.filter("n_regionkey = 1").select(F.col("n_name").alias("entry")), negate=True).select("s_suppkey")


@add(f"""WITH {EV}, base AS (SELECT user_id, list(DISTINCT event_type) AS known FROM ev WHERE ts < TIMESTAMP '2024-01-08' AND user_id % 4 <> 0 GROUP BY user_id)
  SELECT event_id, coalesce(list_contains(known, event_type), true) AS expected FROM ev LEFT JOIN base USING (user_id)""")
def join_baseline_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    base = rows.filter((F.col("ts") < F.lit("2024-01-08").cast("timestamp")) & (F.col("user_id") % 4 != 0)).groupBy(F.col("user_id").alias("entity")).agg(F.collect_set("event_type").alias("values"))
    return joins.with_baseline(rows, F.col("user_id"), base).select("event_id", joins.known_to(F.col("baseline"), F.col("event_type")).alias("expected"))


@add("SELECT c_custkey, coalesce(n, 0)::BIGINT AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON c_custkey = o_custkey")
def join_left_count_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("orders"))


@add(f"""WITH {EV}, facts AS (SELECT tenant_id, user_id::VARCHAR AS arg, ts_ms AS t0, ts_ms + 3600000 AS t1 FROM ev WHERE event_type = 'error' AND value > 50)
  SELECT event_id FROM ev WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM facts f WHERE f.tenant_id = ev.tenant_id AND f.arg = ev.user_id::VARCHAR AND t0 <= ts_ms AND t1 > ts_ms)""")
def fact_exists_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    known = rows.filter("event_type = 'error' AND value > 50").select("tenant_id", F.array(F.col("user_id").cast("string"), F.lit("x")).alias("args"), F.col("ts_ms").alias("emitted_ms"), (F.col("ts_ms") + 3600000).alias("expires_ms"))
    return joins.fact_exists(rows.filter("event_type = 'purchase'"), known, F.col("tenant_id"), F.col("user_id"), F.col("ts_ms")).select("event_id")


@add("""SELECT event_id, CASE WHEN user_id = 3 AND tenant_id = 0 THEN 'deny' WHEN user_id = 5 THEN 'audit' WHEN tenant_id = 1 THEN 'limit' ELSE 'allow' END AS verdict FROM ev""")
def policy_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = spark.createDataFrame([(100, 3, "deny"), (0, 5, "audit"), (101, 0, "limit"), (0, 0, "allow")], "group_id long, pid long, verdict string")
    rows = events(spark, sf_dir).withColumn("grp", F.col("tenant_id") + 100)
    return joins.first_policy(rows, policies, "grp", "user_id").select("event_id", "verdict")


# --- memory --------------------------------------------------------------------------------------------------------------

_ORDER = ["ts_ms", "event_id"]


@add("SELECT event_id, row_number() OVER (PARTITION BY lower(trim(event_type)), user_id ORDER BY ts_ms, event_id) = 1 AS is_new FROM ev")
def rare_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.first_seen(events(spark, sf_dir), [text.key_of(F.col("event_type")), F.col("user_id")], _ORDER).select("event_id", "is_new")


@add("SELECT event_id, row_number() OVER (PARTITION BY tenant_id, k ORDER BY ts_ms, event_id) <= 3 AS is_rare FROM ev")
def rare_threshold3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.rare(events(spark, sf_dir), "tenant_id", source.attribute(F.col("attrs"), "k"), _ORDER).select("event_id", "is_rare")


@add("SELECT event_id, row_number() OVER (PARTITION BY tenant_id, user_id, k ORDER BY ts_ms, event_id) = 1 AS is_new FROM ev")
def unusual_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("tenant_id"), F.col("user_id"), source.attribute(F.col("attrs"), "k")]
    return stateful.first_seen(events(spark, sf_dir), keys, _ORDER).select("event_id", "is_new")


@add("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)::BIGINT AS rate FROM ev")
def rate_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.rate(events(spark, sf_dir), [F.col("user_id")], "ts_ms", 3_600_000).select("event_id", "rate")


@add("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts_ms RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW)::BIGINT AS rate FROM ev")
def rate_sliding_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.rate_sliced(events(spark, sf_dir), [F.col("event_type")], "ts_ms", 600_000).select("event_id", "rate")


@add(f"""WITH {EV}, f AS (SELECT event_id, user_id, ts_ms, k FROM ev WHERE value > 20), r AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN 7200000 PRECEDING AND CURRENT ROW) AS rate FROM f)
  SELECT event_id, rate::BIGINT AS rate FROM r WHERE rate >= 2""")
def stateful_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State counts only the rows that pass what stands before it: filter, then window, then filter."""
    passed = events(spark, sf_dir).filter("value > 20")
    return stateful.rate(passed, [F.col("user_id")], "ts_ms", 7_200_000).filter("rate >= 2").select("event_id", "rate")


@add("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS parent_span FROM ev")
def span_parent_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.parent_span(events(spark, sf_dir), ["user_id"], "event_id", _ORDER).select("event_id", "parent_span")


@add(f"""WITH RECURSIVE {EV}, e AS (SELECT event_id, user_id, ts_ms, greatest(0, least(1, value / 200)) AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS i FROM ev),
  s AS (SELECT event_id, user_id, ts_ms, i, r AS last_risk, 1.0::DOUBLE AS change, 0::BIGINT AS age, r, true AS passes FROM e WHERE i = 1
  UNION ALL SELECT e.event_id, e.user_id, e.ts_ms, e.i, CASE WHEN abs(e.r - s.last_risk) >= 0.05 THEN e.r ELSE s.last_risk END, least(abs(e.r - s.last_risk), 1.0), e.ts_ms - s.ts_ms, e.r, abs(e.r - s.last_risk) >= 0.05 FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
  SELECT event_id, user_id, round(change, 9) AS change, age AS age_ms, round(greatest(0, least(1, 0.30 * r + 0.40 * pow(change, 0.7) + 0.20 * pow(2, -age / 5000.0))), 9) AS relevance FROM s WHERE passes""")
def risk_deadband_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts_ms", (F.col("value") / 200).alias("risk"))
    return stateful.dead_band(rows, "user_id", "risk", "ts_ms", _ORDER).select("event_id", "user_id", F.round("change", 9).alias("change"), "age_ms", F.round("relevance", 9).alias("relevance"))


@add("SELECT event_id, round(0.30 * r + 0.40 * (d / greatest(1, d)) + 0.20 / (1 + a / 5000) + 0.10 * 0.5, 9) AS relevance FROM (SELECT event_id, value / 200 AS r, value / 100 AS d, event_id % 1000 AS a FROM ev)")
def relevance_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", F.round(stateful.quick_relevance(v / 200, v / 100, (F.col("event_id") % 1000).cast("double"), F.lit(0.5)), 9).alias("relevance"))


@add(f"""WITH RECURSIVE {EV}, h AS (SELECT tenant_id, ts_ms // 3600000 AS hour, count(*)::DOUBLE AS n FROM ev GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY hour) AS i FROM h),
  s AS (SELECT tenant_id, hour, i, n AS smooth FROM e WHERE i = 1 UNION ALL SELECT e.tenant_id, e.hour, e.i, 0.28 * e.n + 0.72 * s.smooth FROM s JOIN e ON e.tenant_id = s.tenant_id AND e.i = s.i + 1)
  SELECT tenant_id, hour, round(smooth, 9) AS smooth FROM s""")
def eps_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_hour = events(spark, sf_dir).groupBy("tenant_id", F.floor(F.col("ts_ms") / 3_600_000).alias("hour")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return stateful.smoothed(per_hour, "tenant_id", ["hour"], "n").select("tenant_id", "hour", F.round("smooth", 9).alias("smooth"))


@add(f"""{_PAIRS} SELECT e_id, p_id FROM pairs""")
def rule_list_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rules over one input; of the flagship's alerts the events' ids, read back out of the alert."""
    alerts = rules.run_all([FLAGSHIP, _SINGLE], events(spark, sf_dir)).filter("rule_id = 'error_then_purchase'")
    return alerts.select(F.get_json_object("matched", "$.e.event_id").cast("long").alias("e_id"), F.get_json_object("matched", "$.p.event_id").cast("long").alias("p_id"))


_FNV64 = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, (length(hex(encode(t))) // 2 + 1)::BIGINT), lambda i: ('0x' || substr(hex(encode(t)), (2 * i - 1)::BIGINT, 2))::HUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"""


@add(f"""WITH {EV}, t AS (SELECT event_id, 'large_error' || chr(31) || tenant_id || chr(30) || event_id AS t FROM ev WHERE event_type = 'error' AND value > 100),
  h AS (SELECT event_id, {_FNV64} AS h FROM t) SELECT event_id, 'alt_large_error_' || lpad(printf('%x', (h // 4294967296)::BIGINT), 8, '0') || lpad(printf('%x', (h % 4294967296)::BIGINT), 8, '0') AS alert_id FROM h""")
def alert_id_fnv64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.run(_SINGLE, events(spark, sf_dir)).select("e.event_id", "alert_id")


@add(f"{_PAIRS}, x AS (SELECT severity, count(*) AS n, sum(score)::BIGINT AS total FROM (SELECT *, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' ELSE 'medium' END AS severity FROM pairs) GROUP BY severity) SELECT severity, n, total FROM x")
def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.run(FLAGSHIP, events(spark, sf_dir)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


@add(f"""WITH {EV} SELECT event_id, user_id FROM ev WHERE event_type = 'error' AND value > 100 ORDER BY ts_ms DESC, event_id DESC LIMIT 20""")
def recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.run(_SINGLE, events(spark, sf_dir)).select("e.event_id", "e.user_id", "e.ts_ms")
    return tables.recent(rows, [F.desc("ts_ms"), F.desc("event_id")], 20, 1000).select("event_id", "user_id")


@add("""SELECT event_id, value FROM ev WHERE least(value / 100, 1) >= 0.95""")
def fallback_risk_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.least(F.col("value") / 100, F.lit(1.0)) >= 0.95).select("event_id", "value")


# --- rules that ask for other rows, sets, baselines and facts ------------------------------------------------------------


def _ids_of(rows: DataFrame) -> DataFrame:
    return rows.select("e.event_id", "score")


@add("SELECT event_id, CASE WHEN k IS DISTINCT FROM '3' THEN 10 ELSE 0 END + CASE WHEN NOT coalesce(n > 50, false) THEN 5 ELSE 0 END + CASE WHEN coalesce(n <= 50, false) THEN 1 ELSE 0 END AS score"
     f" FROM (WITH {EV} {_NULLED}) x WHERE event_type = 'error' AND k IS DISTINCT FROM '7' AND NOT coalesce(n > 90, false)")
def rule_null_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null differs from a value, and what is not known to hold counts as false, so that its opposite holds."""
    k, n = field("e.k"), field("e.n")
    rows = _nulled(spark, sf_dir).select("*", F.lit(0).cast("long").alias("ts_ms"), F.lit(0).alias("tenant_id"))
    rule = Rule("nulls", "Nulls", (Source("e", "error"),), where=(k != "7", ~(n > 90)), modifiers=((10, k != "3"), (5, ~(n > 50)), (1, n <= 50)))
    return _ids_of(rules.scored(rule, rules.correlated(rule, rows)))


@add(f"""WITH {EV}, f AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, user_id ORDER BY ts_ms RANGE BETWEEN 7200000 PRECEDING AND CURRENT ROW) AS r FROM ev WHERE event_type = 'click' AND value > 20)
  SELECT event_id, 30 + CASE WHEN r > 2 THEN 40 ELSE 0 END AS score FROM f WHERE r >= 2""")
def rule_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate counts only the rows that pass what stands to its left."""
    r = rate(field("e.user_id"), "2h")
    rule = Rule("burst", "Burst", (Source("e", "click"),), where=((field("e.value") > 20) & (r >= 2),), base=30, modifiers=((40, r > 2),))
    return _ids_of(rules.run(rule, events(spark, sf_dir)))


@add(f"""WITH {EV}, f AS (SELECT * FROM ev WHERE event_type = 'view' AND value > 5), g AS (SELECT *, value <= 40 AND row_number() OVER (PARTITION BY tenant_id, k, value > 40 ORDER BY ts_ms, event_id) <= 3 AS x FROM f),
  h AS (SELECT * FROM g WHERE value > 40 OR x) SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY tenant_id, user_id, k ORDER BY ts_ms, event_id) = 1 THEN 25 ELSE 0 END AS score FROM h""")
def rule_rare_and_unusual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behind `|`, a call sees the rows for which the left side is false; a modifier's call those that passed the filter."""
    v, k = field("e.value"), attribute("e.attrs", "k")
    rule = Rule("unusual", "Unusual", (Source("e", "view"),), where=(v > 5, (v > 40) | rare(k)), modifiers=((25, first_seen(field("e.user_id"), k)),))
    return _ids_of(rules.run(rule, events(spark, sf_dir)))


@add(f"""WITH {EV}, base AS (SELECT user_id, list(DISTINCT k) AS known FROM ev WHERE ts < TIMESTAMP '2024-01-08' AND user_id % 4 <> 0 GROUP BY user_id)
  SELECT event_id, 20 + CASE WHEN k IN ('1', '2', '30') THEN 50 ELSE 0 END AS score FROM ev LEFT JOIN base USING (user_id) WHERE event_type = 'error' AND NOT coalesce(list_contains(known, k), true)""")
def rule_sets_and_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribute that the user's baseline lacks, scored by a named set."""
    rows, k = events(spark, sf_dir), attribute("e.attrs", "k")
    first_week = rows.filter((F.col("ts") < F.lit("2024-01-08").cast("timestamp")) & (F.col("user_id") % 4 != 0))
    base = first_week.groupBy(F.col("user_id").alias("entity")).agg(F.collect_set(source.attribute(F.col("attrs"), "k")).alias("values"))
    feed = spark.createDataFrame([("1",), ("2",), ("30",)], "entry string")
    rule = Rule("unknown", "Unknown attribute", (Source("e", "error"),), where=(~k.known_to("users", field("e.user_id")),), base=20, modifiers=((50, k.in_set("org.watched")),))
    return _ids_of(rules.run(rule, rows, sets={"org.watched": feed}, baselines={"users": base}))


@add(f"""WITH {EV}, facts AS (SELECT tenant_id, user_id, ts_ms AS t0 FROM ev WHERE event_type = 'error' AND value > 50)
  SELECT event_id, 70 AS score FROM ev WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM facts f WHERE f.tenant_id = ev.tenant_id AND f.user_id = ev.user_id AND t0 <= ts_ms AND t0 + 3600000 > ts_ms)""")
def rule_consumes_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule sees the facts that a rule before it emits, while they last."""
    user = field("e.user_id")
    first = Rule("marks", "Marks", (Source("e", "error"),), where=(field("e.value") > 50,), emit=(Fact("user.failed", (user,), "1h"),))
    then = Rule("uses", "Uses", (Source("e", "purchase"),), where=(has_fact("user.failed", user),), base=70)
    alerts = rules.run_all([first, then], events(spark, sf_dir)).filter("rule_id = 'uses'")
    return alerts.select(F.get_json_object("matched", "$.e.event_id").cast("long").alias("event_id"), "score")


@add(f"""WITH {EV}, n AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN user_id END AS host FROM ev)
  SELECT a.event_id AS a, b.event_id AS b FROM n a JOIN n b ON a.tenant_id = b.tenant_id AND a.host IS NOT DISTINCT FROM b.host AND a.k IS NOT DISTINCT FROM b.k AND abs(a.ts_ms - b.ts_ms) <= 1800000 WHERE a.event_type = 'signup' AND b.event_type = 'click'""")
def join_fallback_key_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a rule names no key, host and process must agree; null agrees with null."""
    rows = events(spark, sf_dir).withColumns({"host": F.when(F.col("event_id") % 3 != 0, F.col("user_id")), "process": source.attribute(F.col("attrs"), "k")})
    return _ids(rules.correlated(_pair_rule(), rows, rules.Fields(entities=("host", "process"))), "a", "b")


# --- conditions that are read: keys and residue, kinds, names, calls -------------------------------------------------------


@add(f"""WITH {EV} SELECT a.event_id AS a, b.event_id AS b FROM ev a JOIN ev b ON a.tenant_id = b.tenant_id AND a.user_id = b.user_id AND b.value > a.value + 10 AND abs(a.ts_ms - b.ts_ms) <= 7200000
  WHERE a.event_type = 'signup' AND b.event_type = 'click'""")
def rule_on_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rule joins on is a condition: its equality becomes the key, the rest is checked in the join."""
    on = (field("b.user_id") == field("a.user_id")) & (field("b.value") > field("a.value") + 10)
    rule = Rule("more", "More than before", (Source("a", "signup"), Source("b", "click")), on=on, within="2h")
    return _ids(rules.correlated(rule, events(spark, sf_dir)), "a", "b")


@add(f"""WITH {EV}, n AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN k END AS m FROM ev)
  SELECT a.event_id AS a, b.event_id AS b FROM n a JOIN n b ON a.tenant_id = b.tenant_id AND (a.m = b.m OR (a.m IS NULL AND b.m IS NULL AND a.user_id = b.user_id)) AND abs(a.ts_ms - b.ts_ms) <= 1800000
  WHERE a.event_type = 'signup' AND b.event_type = 'click'""")
def join_key_or_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without any of the fields that a rule joins by are joined by entity, not with all others that lack them."""
    rows = events(spark, sf_dir).withColumn("m", F.when(F.col("event_id") % 3 == 0, source.attribute(F.col("attrs"), "k")))
    return _ids(rules.correlated(_pair_rule(on=(("a.m", "b.m"),)), rows), "a", "b")


@add("""SELECT event_id, (k::BIGINT = event_id % 100) AS text_is_number, false AS type_is_number, true AS not_less, false AS less, k IN ('3', '5', '7') AS among, value < 100 AS small FROM ev""")
def rule_kinds_central(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and numbers: equal if the text spells the number, in no order; other kinds differ."""
    return _kinds(spark, sf_dir, "central")


@add("""SELECT event_id, false AS text_is_number, false AS type_is_number, k::BIGINT >= 50 AS not_less, k::BIGINT < 50 AS less, k IN ('5') AS among, value < 100 AS small FROM ev""")
def rule_kinds_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agent's reading: every order is one of numbers, text that spells a number is not that number."""
    return _kinds(spark, sf_dir, "agent")


def _kinds(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumns({"k": source.attribute(F.col("attrs"), "k"), "n": F.col("event_id") % 100})
    k = field("e.k")
    tests = {"text_is_number": k == field("e.n"), "type_is_number": field("e.event_type") == 5, "not_less": ~(k < 50), "less": k < 50, "among": k.is_in([3, "5", 7]), "small": field("e.value") < 100}
    rule = Rule("kinds", "Kinds", (Source("e", "any"),), let=tuple(tests.items()), dialect=dialect)
    every = rows.withColumn("event_kind", F.lit("any"))
    return rules.scored(rule, rules.correlated(rule, every, rules.Fields(kind="event_kind"))).select("e.event_id", *tests)


@add("SELECT event_id FROM ev WHERE event_type = 'view' AND regexp_matches(k, '^([1-3])[0-9]$')")
def rule_pattern_named_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("p", "p", (Source("e", "view"),), where=(attribute("e.attrs", "k").matches("^(?P<tens>[1-3])[0-9]$"),))
    return rules.run(rule, events(spark, sf_dir)).select("e.event_id")


@add(f"""WITH {EV}, f AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, user_id ORDER BY ts_ms RANGE BETWEEN 7200000 PRECEDING AND CURRENT ROW) AS r FROM ev WHERE event_type = 'click')
  SELECT a.event_id AS a, b.event_id AS b FROM f a JOIN ev b ON a.tenant_id = b.tenant_id AND a.user_id = b.user_id AND abs(a.ts_ms - b.ts_ms) <= 1800000 WHERE a.r >= 2 AND b.event_type = 'purchase'""")
def rule_call_in_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's filter calls: the rate counts the source's own events."""
    rule = Rule("f", "f", (Source("a", "click", rate(field("a.user_id"), "2h") >= 2), Source("b", "purchase")), within="30m")
    return _ids(rules.correlated(rule, events(spark, sf_dir)), "a", "b")


_OR_STEPS = "".join(
    f""", g{i} AS (SELECT *, CASE WHEN NOT hit AND value >= {10 * i} THEN count(*) OVER (PARTITION BY tenant_id, user_id, NOT hit AND value >= {10 * i} ORDER BY ts_ms RANGE BETWEEN 14400000 PRECEDING AND CURRENT ROW) = {i} ELSE false END AS h{i} FROM s{i - 1}),
  s{i} AS (SELECT * REPLACE (hit OR h{i} AS hit) FROM g{i})"""
    for i in range(1, 6)
)


@add(f"WITH {EV}, s0 AS (SELECT *, value > 150 AS hit FROM ev WHERE event_type = 'view'){_OR_STEPS} SELECT event_id FROM s5 WHERE hit")
def rule_calls_behind_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five calls, each over the rows for which all before it were false, in one pass over the events."""
    condition, v = field("e.value") > 150, field("e.value")
    for i in range(1, 6):
        condition = condition | ((v >= 10 * i) & (rate(field("e.user_id"), "4h") == i))
    return rules.run(Rule("o", "o", (Source("e", "view"),), where=(condition,)), events(spark, sf_dir)).select("e.event_id")


#: Names for the test events: a process's where they have none of their own.
_NAMES = Catalog(
    envelope={"at": Entry("int", "ts_ms"), "who": Entry("int", "user_id"), "name": Entry("str", lambda e: F.element_at(F.array(*map(F.lit, ["bash", "curl", "nginx", "vim"])), (e["event_id"] % 4 + 1).cast("int")))},
    families={"large": {"amount": Entry("float", "value")}, "small": {"amount": Entry("float", lambda e: e["value"] / 10)}},
    family_of={"purchase": "large", "error": "small"},
    attrs="attrs",
)


@add("SELECT event_id, event_type FROM ev WHERE k::BIGINT > 30 AND ((event_type = 'purchase' AND value > 20) OR (event_type = 'error' AND value / 10 > 20))")
def rule_catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name for different fields of two families; an attribute that spells a number is one; a name that nothing binds is null."""
    where = (field("amount") > 20, field("e.k") > 30, field("e.nothing") == None)  # noqa: E711
    found = [rules.run(Rule("c", "c", (Source("e", kind),), where=where), events(spark, sf_dir), rules.Fields(catalog=_NAMES)) for kind in ("purchase", "error")]
    return found[0].unionByName(found[1]).select("e.event_id", "e.event_type")


@add(f"""WITH {EV}, f AS (SELECT *, ['bash', 'curl', 'nginx', 'vim'][event_id % 4 + 1] AS name FROM ev WHERE event_type = 'view')
  SELECT event_id, (CASE WHEN name = 'bash' THEN 1 ELSE 0 END + CASE WHEN name IN ('bash', 'curl') THEN 2 ELSE 0 END)::INTEGER AS score FROM f""")
def rule_standard_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("s", "s", (Source("e", "view"),), modifiers=((1, standard.is_shell("e")), (2, standard.living_off_the_land("e"))))
    return rules.run(rule, events(spark, sf_dir), rules.Fields(catalog=_NAMES)).select("e.event_id", "score")


@add("""WITH o AS (SELECT o_custkey AS event_id, list(o_totalprice ORDER BY o_orderkey) AS prices, list(o_orderstatus ORDER BY o_orderkey) AS kinds FROM orders GROUP BY 1)
  SELECT event_id, list_max(prices) AS max, list_min(prices) AS min, round(list_sum(prices), 2) AS sum, round(list_avg(prices), 8) AS avg, len(prices)::BIGINT AS count, len(list_distinct(kinds))::BIGINT AS kinds, strlen(kinds[1])::BIGINT AS len FROM o""")
def callables_over_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """max, min, sum, avg, count, len and distinct, over the orders of a customer taken as one event."""
    by_key = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", c))), lambda x: x[c])
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("event_id")).agg(by_key("o_totalprice").alias("prices"), by_key("o_orderstatus").alias("kinds"))
    rows = rows.select("*", F.lit("o").alias("event_type"), F.lit(0).alias("ts_ms"), F.lit(1).alias("user_id"), F.lit(1).alias("tenant_id"))
    prices, kinds = field("e.prices"), field("e.kinds")
    let = [(n, call(n, prices)) for n in ("max", "min", "sum", "avg", "count")] + [("kinds", call("len", call("distinct", kinds))), ("len", call("len", kinds.apply(lambda c: F.get(c, 0), "first")))]
    rule = Rule("l", "l", (Source("e", "o"),), let=tuple(let))
    return rules.scored(rule, rules.correlated(rule, rows)).select("e.event_id", "max", "min", F.round("sum", 2).alias("sum"), F.round("avg", 8).alias("avg"), "count", "kinds", "len")


@add(f"""WITH {EV}, base AS (SELECT user_id, list(DISTINCT k) AS known FROM ev WHERE ts < TIMESTAMP '2024-01-08' AND user_id % 4 <> 0 GROUP BY user_id),
  f AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, k ORDER BY ts_ms, event_id) <= 3 AS rare, row_number() OVER (PARTITION BY tenant_id, user_id, k ORDER BY ts_ms, event_id) = 1 AS fresh,
    count(*) OVER (PARTITION BY tenant_id, k ORDER BY ts_ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS n FROM ev WHERE event_type = 'error')
  SELECT event_id, (CASE WHEN rare THEN 1 ELSE 0 END + CASE WHEN fresh THEN 2 ELSE 0 END + CASE WHEN n > 1 THEN 4 ELSE 0 END + CASE WHEN k IN ('1', '2', '30') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(list_contains(known, k), false) THEN 16 ELSE 0 END + CASE WHEN tenant_id = 1 AND k IN ('4', '5', '6') THEN 32 ELSE 0 END)::INTEGER AS score FROM f LEFT JOIN base USING (user_id)""")
def callables_with_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rare, unusual_for, rate, intel.domains, user and baseline.workload by name."""
    rows, k = events(spark, sf_dir), attribute("e.attrs", "k")
    first_week = rows.filter((F.col("ts") < F.lit("2024-01-08").cast("timestamp")) & (F.col("user_id") % 4 != 0))
    users = first_week.groupBy(F.col("user_id").cast("string").alias("entity")).agg(F.collect_set(source.attribute(F.col("attrs"), "k")).alias("values"))
    workloads = spark.createDataFrame([("1/error", ["4", "5", "6"])], "entity string, values array<string>")
    feed = spark.createDataFrame([("1",), ("2",), ("30",)], "entry string")
    conditions = (
        call("rare", k), call("unusual_for", k, field("e.user_id")), call("rate", k, "1d") > 1, k.is_in(call("intel.domains", "watched")), k.is_in(call("user", field("e.user_id"))["hosts"]),
        k.is_in(call("baseline.workload", field("e.tenant_id"), field("e.event_type"))["allowed_processes"]),
    )
    rule = Rule("m", "m", (Source("e", "error"),), modifiers=tuple((1 << i, c) for i, c in enumerate(conditions)))
    found = rules.run(rule, rows, sets={"org.threat_intel.watched": feed}, baselines={"user.hosts": users, "baseline.workload.allowed_processes": workloads})
    return found.select("e.event_id", "score")


@add("""SELECT event_id, CASE WHEN value > 200 THEN 'Far too large' WHEN value > 100 THEN 'Branches' ELSE 'Small' END AS message, CASE WHEN value > 200 THEN 'critical' WHEN value > 100 THEN 'high' ELSE 'low' END AS severity FROM ev WHERE event_type = 'error'""")
def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message of a branch's first alert that has one, else the rule's name; severity of its first alert, else high."""
    branches = (
        Branch(field("e.value") > 200, (("isolate", "host"), ("alert", "critical"), ("alert", "low", "Far too large"))), Branch(field("e.value") > 100, (("notify", "x", "not shown"),)), Branch(None, (("alert", "low", "Small"),)),
    )
    return rules.run(Rule("branches", "Branches", (Source("e", "error"),), respond=branches), events(spark, sf_dir)).select("e.event_id", "message", "severity")


@add(f"""{_PAIRS.replace("WITH ", "WITH t AS (SELECT 0), ", 1)}, m AS (SELECT count(*) AS n FROM ev e JOIN ev p ON e.user_id = p.user_id AND abs(p.ts_ms - e.ts_ms) <= 3600000 WHERE e.event_type = 'error' AND p.event_type = 'purchase'),
  f AS (SELECT tenant_id, user_id, max(greatest(e_ms, p_ms)) + 21600000 AS until FROM pairs GROUP BY 1, 2)
  SELECT 2::BIGINT AS rules_active, (SELECT count(*) FROM ev) AS events_evaluated, (SELECT count(*) FROM ev WHERE value > 300) AS events_ts_fallback, (SELECT n FROM m) + (SELECT count(*) FROM ev WHERE event_type = 'error') AS matches_total,
  (SELECT count(*) FROM pairs) + (SELECT count(*) FROM ev WHERE event_type = 'error' AND value > 100) AS alerts_emitted, (SELECT count(*) FROM f WHERE until > (SELECT max(ts_ms) FROM ev)) AS facts_active""")
def engine_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("late", F.col("value") > 300)
    return rules.counters([FLAGSHIP, _SINGLE], rows, fallback="late")
