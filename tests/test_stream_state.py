"""Rules that remember, facts and reference data over several micro-batches."""

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import rules
from tallgrass.operators.conditions import field, first_seen, has_fact, rare, rate
from tallgrass.operators.rules import Fact, Rule, Source
from tallgrass.sources import reference
from tallgrass.streaming import calls, facts, pipelines
from tallgrass.streaming.calls import STATE_STORE
from test_streams import files, finished

SCHEMA = "event_id long, ts_ms long, user_id long, tenant_id long, event_type string, k string, value double"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    yield
    spark.conf.set(name, before)


def timed(stream):
    return stream.withColumn("ts", F.timestamp_millis("ts_ms"))


def test_calls_over_three_batches_as_over_a_table(spark, tmp_path, rocks):
    r = random.Random(1)
    rows = [(i, i * 1000 + r.randrange(900), None if i % 11 == 0 else 1 + i % 3, 1, "x", r.choice(["a", "b", None]), float(r.randrange(20))) for i in range(90)]
    v, k, user = field("e.value"), field("e.k"), field("e.user_id")
    rule = Rule("r", "r", (Source("e", "x"),), where=((v > 3) & (rate(k, "20s") >= 2), (v > 12) | rare(user, 4)), let=(("n", rate(user, "15s")),), base=5, modifiers=((7, first_seen(k, user)), (3, field("n") > 2)))
    columns = ("e.event_id", "e.user_id", "e.k", "e.value", "e.ts_ms", "n", "score", "severity")
    want = sorted(map(tuple, rules.run(rule, spark.createDataFrame(rows, SCHEMA)).select(*columns).collect()))
    stream = timed(files(spark, tmp_path / "in", [rows[a : a + 30] for a in (0, 30, 60)], SCHEMA))
    got = finished(pipelines.rule_stream(rule, stream, lateness="1 minute").select(*columns), tmp_path)
    assert want and sorted(map(tuple, got)) == want


def test_keys_share_the_state_of_a_group(spark, tmp_path, rocks, monkeypatch):
    """As over a table over two micro-batches, with few rows of state for many keys."""
    monkeypatch.setattr(calls, "KEY_GROUPS", {"rate": 2, "rare": 3})
    rows = [(i, i * 50, i * 7919 % 200, i % 2, "x", "k", float(i % 20)) for i in range(1200)]
    v, user = field("e.value"), field("e.user_id")
    rule = Rule("r", "r", (Source("e", "x"),), where=((v > 3) & (rate(user, "20s") >= 2), (v > 15) | rare(user, 4)), base=5, modifiers=((7, first_seen(user)),))
    columns = ("e.event_id", "score")
    want = sorted(map(tuple, rules.run(rule, spark.createDataFrame(rows, SCHEMA)).select(*columns).collect()))
    stream = timed(files(spark, tmp_path / "in", [rows[:600], rows[600:]], SCHEMA))
    found = pipelines.rule_stream(rule, stream, lateness="1 minute").select(*columns)
    query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect()
    assert len(want) > 100 and sorted(map(tuple, got)) == want
    # a group is a row of state and, for the rate, a timer in two tables; with a key each there were hundreds
    assert all(o["numRowsTotal"] <= 20 for p in query.recentProgress for o in p["stateOperators"])


def test_calls_after_a_join_of_streams(spark, tmp_path, rocks):
    rows = [(i, i // 2 * 1000, 1, 1, "ab"[i % 2], "k", float(i)) for i in range(24)]
    rule = Rule("r", "r", (Source("a", "a"), Source("b", "b")), within="500ms", where=(rare(field("a.k"), 5),))
    ids = lambda df: df.select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))
    stream = timed(files(spark, tmp_path / "in", [rows], SCHEMA))
    got = finished(ids(pipelines.rule_stream(rule, stream, lateness="1 minute")), tmp_path)
    # which pairs a join gives first is its own affair, that it is five of them is not
    every = ids(rules.run(replace(rule, where=()), spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == 5 and set(map(tuple, got)) <= set(map(tuple, every)) and len(every) == 12


def test_a_rate_forgets_what_the_watermark_has_left(spark, tmp_path, rocks):
    rows = [[(1, 0, 1, 1, "x", "a", 1.0)], [(2, 4_000, 1, 1, "x", "a", 1.0)], [(3, 900_000, 1, 1, "x", "b", 1.0)], [(4, 901_000, 1, 1, "x", "a", 1.0)]]
    rule = Rule("r", "r", (Source("e", "x"),), let=(("n", rate(field("e.k"), "5s")), ("new", rare(field("e.k"), 1))))
    stream = timed(files(spark, tmp_path / "in", rows, SCHEMA))
    got = finished(pipelines.rule_stream(rule, stream, lateness="1 second", remember_ms=60_000).select("e.event_id", "n", "new"), tmp_path)
    assert sorted(map(tuple, got)) == [(1, 1, True), (2, 2, False), (3, 1, True), (4, 1, True)]


def test_a_rule_that_remembers_says_what_it_needs(spark, tmp_path):
    stream = timed(files(spark, tmp_path / "in", [[(1, 0, 1, 1, "x", "a", 1.0)]], SCHEMA))
    with pytest.raises(ValueError, match="RocksDB"):
        pipelines.rule_stream(Rule("r", "r", (Source("e", "x"),), where=(rare(field("e.k")),)), stream)


EMITS = Rule("marks", "Marks", (Source("e", "error"),), emit=(Fact("failed", (field("e.user_id"),), "10s"),))
USES = Rule("uses", "Uses", (Source("e", "buy"),), where=(field("e.value") > 0, has_fact("failed", field("e.user_id"))), base=70)


def kept(out):
    def deliver(alerts, n):
        alerts.select("alert_id", "e.event_id", "score", F.lit(n).alias("batch")).write.mode("append").parquet(f"{out}/{n}")

    return deliver


def delivered(spark, out):
    return sorted(tuple(r) for r in spark.read.parquet(f"{out}/*").select("event_id", "batch").collect())


def test_facts_reach_later_triggers(spark, tmp_path):
    """An emission is seen in the next trigger, a second one moves the expiry, and a batch that runs twice changes nothing."""
    store, source = facts.FactStore(spark, str(tmp_path / "facts")), tmp_path / "in"
    batches = [[(1, 1_000, 7, 1, "error", "", 1.0), (2, 2_000, 7, 1, "buy", "", 1.0)], [(3, 9_000, 7, 1, "error", "", 1.0), (4, 10_000, 7, 1, "buy", "", 1.0), (5, 10_000, 8, 1, "buy", "", 1.0), (6, 10_000, 7, 2, "buy", "", 1.0)]]
    batches += [[(7, 15_000, 7, 1, "buy", "", 1.0), (8, 19_500, 7, 1, "buy", "", 1.0)]]
    for rows in batches:
        stream = timed(files(spark, source, [rows], SCHEMA))
        # the one that asks runs first, so it sees what earlier triggers have written
        for rule in (USES, EMITS):
            facts.run_stream(rule, stream, store, str(tmp_path / f"at-{rule.rule_id}"), kept(tmp_path / rule.rule_id)).awaitTermination()
    assert delivered(spark, tmp_path / "uses") == [(4, 1), (7, 2)]
    assert [(r.args, r.emitted_ms, r.expires_ms) for r in store.read().collect()] == [(["7"], 9_000, 19_000)]
    before = sorted(map(tuple, store.read().collect()))
    again = rules.facts(EMITS, rules.run(EMITS, spark.createDataFrame(batches[1], SCHEMA)))
    store.write(again, "marks", 1)
    assert sorted(map(tuple, store.read().collect())) == before
    assert [r.emitted_ms for r in store.read("marks", 1).collect()] == [1_000]  # a batch does not see itself


def test_the_log_of_facts_is_folded(spark, tmp_path):
    store = facts.FactStore(spark, str(tmp_path / "facts"))
    emit = lambda args, ms, until: spark.createDataFrame([("1", "f", [args], ms, until)], facts.SCHEMA)
    for n in range(3):
        store.write(emit("a", n * 1000, n * 1000 + 500), "w", n)
    store.write(emit("b", 200_000_000, None), "w", 3)
    before = sorted(map(tuple, store.read().collect()))
    store.fold(least=5)
    assert sorted(map(tuple, store.read().collect())) == before  # too short a log
    store.fold(least=4)
    assert [r.args for r in store.read().collect()] == [["b"]]
    store.write(emit("b", 200_000_001, 5), "v", 0)
    assert [(r.emitted_ms, r.expires_ms) for r in store.read().collect()] == [(200_000_001, 5)]
    store.fold(keep_ms=1 << 40, least=1)
    store.fold(keep_ms=1 << 40, least=0)
    assert [(r.emitted_ms, r.expires_ms) for r in store.read().collect()] == [(200_000_001, 5)]


def test_split_keeps_memory_before_facts():
    e = field("e.k")
    first, rest = facts.split(Rule("r", "r", (Source("e", "x"),), where=((rate(e, "1m") > 1) & has_fact("f", e),)))
    assert len(first.where) == 1 and len(rest.where) == 1
    with pytest.raises(ValueError, match="before the first has_fact"):
        facts.split(Rule("r", "r", (Source("e", "x"),), where=(has_fact("f", e), rare(e))))


def generation(path, n, entries=None, whole=True, **files_):
    folder = path / f"generation={n}"
    (folder / "sets").mkdir(parents=True)
    if entries is not None:
        (folder / "sets" / "watched.txt").write_text(entries)
    for name, content in files_.items():
        (folder / f"{name}.json").write_text(content)
    if whole:
        (folder / "_SUCCESS").touch()


def test_a_feed_that_changes_between_triggers(spark, tmp_path):
    """The second trigger knows the new feed; a broken one, and one that is not whole, change nothing."""
    store, source, feed = facts.FactStore(spark, str(tmp_path / "facts")), tmp_path / "in", tmp_path / "feed"
    sets = reference.Reloading(spark, str(feed), reference.load_sets)
    rule = Rule("w", "Watched", (Source("e", "x"),), where=(field("e.value") > 0, has_fact("none", field("e.k")) | field("e.k").in_set("watched")))
    generation(feed, 1, "# entries\nA\n10.0.0.1/32\n")
    steps = [lambda: None, lambda: generation(feed, 2, "B ; now this one\n"), lambda: generation(feed, 3, "# nothing\n"), lambda: generation(feed, 4, "C\n", whole=False)]
    for n, step in enumerate(steps):
        step()
        rows = [(10 * n + i, n * 1000 + i, 1, 1, "x", k, 1.0) for i, k in enumerate(["a", "b", "c", "10.0.0.1"])]
        stream = timed(files(spark, source, [rows], SCHEMA))
        facts.run_stream(rule, stream, store, str(tmp_path / "at"), kept(tmp_path / "w"), tables=lambda: {"sets": sets.now()}).awaitTermination()
    assert delivered(spark, tmp_path / "w") == [(0, 0), (3, 0), (11, 1), (21, 2), (31, 3)]
    assert sets.generation == 2 and sets.refused == {3}


def test_baselines_of_an_artifact(spark, tmp_path):
    good = {"version": 1, "hosts": {" h1 ": {"domains": ["a.io", "b.io"]}}, "users": {"u": {"login_hours": [7, 8]}}, "workloads": {"ns/app": {"allowed_processes": ["sh"]}}}
    generation(tmp_path, 1, baselines=json.dumps(good))
    known = reference.Reloading(spark, str(tmp_path), reference.load_baselines)
    table = lambda name: {r.entity: sorted(r["values"]) for r in known.now()[name].collect()}
    assert table("host.domains") == {"h1": ["a.io", "b.io"]} and table("user.login_hours") == {"u": ["7", "8"]} and table("baseline.workload.allowed_processes") == {"ns/app": ["sh"]}
    generation(tmp_path, 2, baselines=json.dumps(good | {"version": 2}))
    generation(tmp_path, 3, baselines="{broken")
    assert table("host.domains") == {"h1": ["a.io", "b.io"]} and known.refused == {2, 3}


def test_rules_with_settings(spark, tmp_path):
    build = lambda s: Rule("r", "r", (Source("e", "x"),), where=(field("e.value") > s["least"],), base=int(s["base"]))
    book = reference.Reloading(spark, str(tmp_path), reference.load_settings(build))
    with pytest.raises(ValueError, match="no generation"):
        book.now()
    generation(tmp_path, 1, settings='{"least": 5, "base": 10}')
    assert book.now().base == 10
    generation(tmp_path, 2, settings='{"least": 5}')
    assert book.now().base == 10
    generation(tmp_path, 3, settings='{"least": 5, "base": 30}')
    assert book.now().base == 30
