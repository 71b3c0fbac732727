"""Rules, joins and memory on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import graph, joins, rules, selection, stateful, tables
from tallgrass.operators.conditions import as_expression, field, has_fact, rare, rate
from tallgrass.operators.rules import Branch, Fact, Rule, Source
from tallgrass.sources import events as source

MINUTE = 60_000


@pytest.fixture(scope="module")
def events(spark):
    rows = [(1, 0, 7, 1, "exec", 1.0), (2, 5 * MINUTE, 7, 1, "net", 9.0), (3, 5 * MINUTE + 1, 7, 1, "net", 8.0), (4, 0, 7, 2, "net", 7.0), (5, 1, 8, 1, "exec", None), (6, 10 * MINUTE, 7, 1, "db", 0.0)]
    return spark.createDataFrame(rows, "event_id long, ts_ms long, user_id long, tenant_id long, event_type string, value double")


def pairs(df, *aliases):
    return sorted(tuple(r) for r in df.select(*(F.col(f"{a}.event_id") for a in aliases)).collect())


def test_window_is_closed_and_default_is_five_minutes(events):
    rule = Rule("r", "r", (Source("p", "exec"), Source("n", "net")))
    assert pairs(rules.correlated(rule, events), "p", "n") == [(1, 2)]  # 3 is one millisecond beyond; 4 is of another tenant


def test_explicit_key_crosses_entities(events):
    rule = Rule("r", "r", (Source("p", "exec"), Source("n", "net")), on=(("p.tenant_id", "n.tenant_id"),), within="6m")
    assert pairs(rules.correlated(rule, events), "p", "n") == [(1, 2), (1, 3), (5, 2), (5, 3)]


def test_three_sources_lie_within_the_window_of_the_last(events):
    rule = Rule("r", "r", (Source("p", "exec"), Source("n", "net"), Source("d", "db")), within="5m")
    assert pairs(rules.correlated(rule, events), "p", "n", "d") == []
    assert pairs(rules.correlated(Rule("r", "r", rule.sources, within="10m"), events), "p", "n", "d") == [(1, 2, 6), (1, 3, 6)]


def test_ordered_and_self(events):
    nets = (Source("a", "net"), Source("b", "net"))
    assert pairs(rules.correlated(Rule("r", "r", nets), events), "a", "b") == [(2, 3), (3, 2)]
    assert pairs(rules.correlated(Rule("r", "r", nets), events, include_self=True), "a", "b") == [(2, 2), (2, 3), (3, 2), (3, 3), (4, 4)]
    assert pairs(rules.correlated(Rule("r", "r", nets, ordered=True), events), "a", "b") == [(2, 3)]


def test_score_require_and_default_answer(events):
    rule = Rule("r", "r", (Source("p", "exec"),), let=(("small", field("p.value") < 5),), base=60, modifiers=((20, field("small").is_true()),), require=(field("score") >= 60,))
    rows = {r.id: (r.score, r.severity) for r in rules.run(rule, events).select(F.col("p.event_id").alias("id"), "score", "severity").collect()}
    assert rows == {1: (80, "critical"), 5: (60, "high")}  # a null comparison adds nothing


def test_answer_branches_and_flags(events):
    rule = Rule("r", "r", (Source("n", "net"),), respond=(Branch(field("n.value") > 8.5, (("alert", "critical"), ("block_egress", "n"))), Branch(field("n.value") > 7.5, (("notify", "x"),))))
    rows = {r.id: (r.severity, r.block_egress) for r in rules.run(rule, events).select(F.col("n.event_id").alias("id"), "severity", "block_egress").collect()}
    assert rows == {2: ("critical", True), 3: ("high", False), 4: ("medium", False)}


def test_alert_ids_are_stable(spark, events):
    rule = Rule("r", "r", (Source("p", "exec"), Source("n", "net")))
    first, again = (rules.run(rule, e).select("alert_id").first()[0] for e in (events, events.orderBy(F.desc("event_id"))))
    assert first == again and first.startswith("alt_r_") and len(first) == len("alt_r_") + 16


def test_facts(events):
    rule = Rule("r", "r", (Source("p", "exec"),), emit=(Fact("seen", (field("p.user_id"), as_expression("x")), "1s"), Fact("always", (field("p.user_id"),))))
    rows = rules.facts(rule, rules.run(rule, events)).orderBy("fact", "emitted_ms").collect()
    assert [(r.fact, r.args, r.emitted_ms, r.expires_ms) for r in rows] == [("always", ["7"], 0, None), ("always", ["8"], 1, None), ("seen", ["7", "x"], 0, 1000), ("seen", ["8", "x"], 1, 1001)]
    live = joins.fact_exists(events, rules.facts(rule, rules.run(rule, events)).filter("fact = 'seen'"), F.col("tenant_id"), F.col("user_id"), F.col("ts_ms"))
    assert [r.event_id for r in live.orderBy("event_id").collect()] == [1, 5]


def found(rule, events, **more):
    return sorted(r[0] for r in rules.run(rule, events, **more).select("e.event_id").collect())


def test_conditions_are_two_valued(spark):
    rows = spark.createDataFrame([(1, 0, 7, 1, "x", None), (2, 0, 7, 1, "x", 5.0), (3, 0, 7, 1, "x", 0.0), (4, 0, 7, 1, "x", float("nan"))], "event_id long, ts_ms long, user_id long, tenant_id long, event_type string, uid double")
    uid = field("e.uid")
    one = lambda c: found(Rule("r", "r", (Source("e", "x"),), where=(c,)), rows)
    assert one(uid != 0) == [1, 2, 4] and one(~(uid > 3)) == [1, 3, 4] and one(uid == None) == [1]  # noqa: E711
    assert one(uid > 3) == [2] and one(uid == float("nan")) == [] and one(uid <= 5) == [2, 3]
    assert one((uid != 0) & ~uid.is_in([5.0])) == [1, 4] and one(uid.between(0, 5)) == [2, 3]
    with pytest.raises(TypeError, match="no condition"):
        one("e.uid != 0")
    branch = Rule("r", "r", (Source("e", "x"),), base=1, modifiers=((5, uid != 0),), respond=(Branch(~(uid > 3), (("alert", "low"),)), Branch(None, (("alert", "high"),))))
    assert {r.event_id: (r.score, r.severity) for r in rules.run(branch, rows).select("e.event_id", "score", "severity").collect()} == {1: (6, "low"), 2: (6, "high"), 3: (1, "low"), 4: (6, "low")}


def test_null_keys_meet_and_the_score_saturates(spark):
    rows = spark.createDataFrame([(1, 0, None, 1, "a"), (2, 1, None, 1, "b"), (3, 1, 5, 1, "b")], "event_id long, ts_ms long, user_id long, tenant_id long, event_type string")
    rule = Rule("r", "r", (Source("a", "a"), Source("b", "b")), base=2**31 - 10, modifiers=((100, field("a.event_id") == 1),))
    assert [tuple(r) for r in rules.run(rule, rows).select("a.event_id", "b.event_id", "score").collect()] == [(1, 2, 2**31 - 1)]


def test_calls_see_only_rows_that_came_so_far(spark):
    rows = [(i, i * 1000, 1, 1, "x", "k", float(i)) for i in range(8)]
    events = spark.createDataFrame(rows, "event_id long, ts_ms long, user_id long, tenant_id long, event_type string, key string, value double")
    v, key = field("e.value"), field("e.key")
    one = lambda *c: found(Rule("r", "r", (Source("e", "x"),), where=c), events)
    assert one(v > 3, rate(key, "10s") >= 3) == one((v > 3) & (rate(key, "10s") >= 3)) == [6, 7]
    assert one(rate(key, "10s") >= 3, v > 3) == [4, 5, 6, 7]
    assert one((v < 4) | rare(key, 2)) == [0, 1, 2, 3, 4, 5]
    assert one(~rare(key, 2)) == [2, 3, 4, 5, 6, 7]


def test_rules_see_facts_of_rules_before_them(events):
    rule = Rule("a", "a", (Source("e", "exec"),), emit=(Fact("ran", (field("e.user_id"),), "6m"),))
    uses = Rule("b", "b", (Source("e", "net"),), where=(has_fact("ran", field("e.user_id")),))
    after = lambda order: sorted(r.matched for r in rules.run_all(order, events).filter("rule_id = 'b'").selectExpr("get_json_object(matched, '$.e.event_id') AS matched").collect())
    assert after([rule, uses]) == ["2", "3"] and after([uses, rule]) == []
    assert rules.facts(uses, rules.run(uses, events)).collect() == []


def test_explain():
    rule = Rule("r", "r", (Source("p", "exec"), Source("n", "net")), where=(field("n.value") > 1,))
    assert [s for s, _ in rules.explain(rule)] == ["subscribe", "subscribe", "correlate", "window", "filter", "score"]


def test_in_set_ignores_case_and_nulls(spark):
    rows = spark.createDataFrame([("A",), ("b",), (None,)], "x string")
    feed = spark.createDataFrame([("a",), (None,)], "entry string")
    assert [r.x for r in joins.in_set(rows, F.col("x"), feed).collect()] == ["A"]
    assert {r.x for r in joins.in_set(rows, F.col("x"), feed, negate=True).collect()} == {"b", None}


def test_policy_precedence(spark):
    policies = spark.createDataFrame([(1, 2, "a"), (0, 2, "b"), (1, 0, "c"), (0, 0, "d")], "group_id long, pid long, verdict string")
    rows = spark.createDataFrame([(1, 2), (9, 2), (1, 9), (9, 9)], "g long, p long")
    assert {(r.g, r.p): r.verdict for r in joins.first_policy(rows, policies, "g", "p").collect()} == {(1, 2): "a", (9, 2): "b", (1, 9): "c", (9, 9): "d"}


def test_dead_band(spark):
    rows = spark.createDataFrame([(1, "a", 0, 0.5), (2, "a", 10, 0.52), (3, "a", 20, 0.56), (4, "b", 0, 0.1), (5, "a", 5020, 0.9)], "id long, k string, ms long, risk double")
    out = {r.id: (round(r.change, 6), r.age_ms) for r in stateful.dead_band(rows, "k", "risk", "ms", ["ms"]).collect()}
    assert out == {1: (1.0, 0), 3: (0.06, 10), 4: (1.0, 0), 5: (0.34, 5000)}  # 2 moves less than the band; what 3 moved is measured from 1


def test_rates_agree(spark):
    rows = spark.createDataFrame([(i, i % 2, (i * 7919) % 5000) for i in range(300)], "id long, k long, ms long")
    plain = {r.id: r.rate for r in stateful.rate(rows, [F.col("k")], "ms", 100).collect()}
    sliced = {r.id: r.rate for r in stateful.rate_sliced(rows, [F.col("k")], "ms", 100).collect()}
    assert plain == sliced


def test_smoothing(spark):
    rows = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 0.0), ("b", 1, 4.0)], "k string, at long, x double")
    out = {(r.k, r.at): round(r.smooth, 6) for r in stateful.smoothed(rows, "k", ["at"], "x").collect()}
    assert out == {("a", 1): 10.0, ("a", 2): round(0.28 * 8.2 + 0.72 * 10, 6), ("b", 1): 4.0}


def test_bfs_visits_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4)], "src long, dst long")
    assert {r.id: r.depth for r in graph.bfs(edges, spark.createDataFrame([(1,)], "id long"), 2).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}


def test_lowest_free(spark):
    taken = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2), ("c", 1), ("c", 2), ("c", 3), ("c", 4)], "k string, s long")
    assert {r.k: r.free for r in tables.lowest_free(taken, "s", 1, 4, ["k"]).collect()} == {"a": 3, "b": 1, "c": None}


def test_selection(spark):
    rows = spark.createDataFrame([(0, 1, 1.0, 2.0), (0, 2, 0.9, 1.0), (0, 3, 0.8, 1.0)], "w long, id long, relevance double, cpu double")
    rows = rows.withColumns({r: F.lit(0.0) for r in selection.RESOURCES[1:]})
    budget = dict.fromkeys(selection.RESOURCES, 2.0)
    assert {r.id for r in selection.greedy(rows, "w", "id", budget).collect()} == {2, 3}
    assert {r.id for r in selection.exact(rows, "w", "id", budget).collect()} == {2, 3}


def test_batches(spark):
    struct = "struct<ts_unix_ms:bigint,pid:bigint,attrs:map<string,string>>"
    schema = f"tenant_id string, host_id string, schema_version int, batch_id string, ingested_at_unix_ms bigint, process_exec_events array<{struct}>, file_events array<{struct}>, net_events array<{struct}>, db_query_events array<{struct}>, agent_heartbeats array<{struct}>"
    rows = [("t", "h", None, "1", 10**9, [(10**9, 1, {})], [(0, 2, None)], None, [], None), ("t", "h", 9, "2", 0, [(0, 1, {})], [], [], [], []), ("t", "h", 1, "3", 0, None, None, None, None, None)]
    good, bad = source.checked(spark.createDataFrame(rows, schema))
    assert {r.batch_id: r.reason for r in bad.collect()} == {"2": "schema_version", "3": "no_rows"}
    flat = {r.event_kind: (r.ts_unix_ms, r.ts_fallback) for r in source.flattened(good).collect()}
    assert flat == {"process_exec": (10**9, False), "file": (10**9, True)}


def test_batch_schema_reads(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"tenant_id":"t","host_id":"h","net_events":[{"pid":4000000000,"dst_port":443,"attrs":{"bytes_out":"5"}}]}')
    row = spark.read.schema(source.BATCH_SCHEMA).json(str(tmp_path)).first()
    assert row.net_events[0].pid == 4_000_000_000 and row.net_events[0].attrs == {"bytes_out": "5"}


def test_feed_lines(spark):
    lines = spark.createDataFrame([("# c",), ("",), (" 1.2.3.4  # scanner",), ("evil.com",)], "value string")
    assert [r.entry for r in source.feed_entries(lines).collect()] == ["1.2.3.4", "evil.com"]
