"""Motifs, dense ids, failover, digests, the console's filter and sinks, against plain Python."""

import itertools
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import aggregates, console, derive, graph
from tallgrass.sources import sinks
from tallgrass.sources.sinks import Breaker, PermanentError, Refused, Retries, Sink


@pytest.fixture(scope="module")
def edges(spark):
    r = random.Random(2)
    rows = [(r.randrange(14), r.randrange(14), r.choice("aabc")) for _ in range(150)] + [(0, i, "a") for i in range(14)]  # a hub, loops, parallel edges
    return rows, spark.createDataFrame(rows, "src long, dst long, kind string")


def plain_motif(rows, pattern, apart):
    names = sorted({v for a, _, b in pattern for v in (a, b)})
    have = {(s, d, k) for s, d, k in rows} | {(s, d, None) for s, d, _ in rows}
    ids = sorted({v for s, d, _ in rows for v in (s, d)})
    out = []
    for values in itertools.product(ids, repeat=len(names)):
        at = dict(zip(names, values))
        if all((at[a], at[b], k) in have for a, k, b in pattern) and (not apart or len(set(values)) == len(values)):
            out.append(values)
    return sorted(out)


@pytest.mark.parametrize("apart", [True, False])
@pytest.mark.parametrize("pattern", [
    [("x", "a", "y"), ("y", "b", "z")], [("x", "a", "y"), ("y", "b", "z"), ("z", "c", "x")], [("x", "c", "y"), ("z", "c", "y")], [("x", "b", "x"), ("x", None, "y")], [("x", "a", "y"), ("y", "a", "x")], [("x", "nope", "y"), ("y", "a", "z")],
])
def test_motifs(edges, pattern, apart):
    rows, table = edges
    assert sorted(map(tuple, graph.motif(table, pattern, apart).collect())) == plain_motif(rows, pattern, apart)


def test_a_pattern_hangs_together(edges):
    with pytest.raises(ValueError, match="falls apart"):
        graph.motif(edges[1], [("x", "a", "y"), ("v", "a", "w")])


def test_dense_ids_over_deltas(spark):
    ids = lambda df: {(r.label, r.id): r.number for r in df.collect()}
    table = lambda rows: spark.createDataFrame(rows, "label string, id long")
    start = table([("host", i * 3) for i in range(40)] + [("file", 7), ("file", 7), (None, 1)])
    first = graph.dense_ids(start, each=5)
    now = graph.dense_ids(table([("host", i) for i in range(60)] + [("user", 1), (None, 1), (None, 2)]), first, each=5)
    before, after = ids(first), ids(now)
    assert before.items() <= after.items()
    for found in (before, after):
        of = defaultdict(list)
        for (label, _), n in found.items():
            of[label].append(n)
        assert all(sorted(ns) == list(range(len(ns))) for ns in of.values())
    assert ids(graph.dense_ids(start.repartition(7), each=5)) == before  # whatever the order of the rows
    assert graph.dense_ids(table([])).count() == 0


def plain_failover(sessions, gateways):
    """The four rounds of failed_over, one session after the other to the least loaded gateway of its pool; counts by gateway."""
    load = Counter(g for *_, g, state in sessions if state in derive.LIVE)
    sick = {g for g, *_, healthy in gateways if not healthy}
    todo = [s for s in sessions if s[4] in derive.LIVE and s[3] in sick]
    moved = {}
    for regional, own in ((True, True), (True, False), (False, True), (False, False)):
        for sid, tenant, region, *_ in sorted(todo):
            free = [g for g in gateways if g[4] and load[g[0]] < g[3] and (g[1] is not None) == own and (not own or g[1] == tenant) and (not regional or g[2] == region)]
            if free and sid not in moved:
                moved[sid] = min(free, key=lambda g: (load[g[0]] / g[3], g[0]))[0]
                load[moved[sid]] += 1
    return moved, load, {s[0] for s in todo}


@pytest.mark.parametrize("seed", range(3))
def test_failover_fills_no_gateway_beyond_its_capacity(spark, seed):
    r = random.Random(seed)
    gateways = [(g, r.choice([None, None, 1, 2]), r.choice("xy"), r.randint(5, 20), r.random() < 0.7) for g in range(10)]
    sessions = [(i, r.randint(1, 3), r.choice("xyz"), r.randrange(10), "TERMINATED" if r.random() < 0.2 else "ACTIVE") for i in range(90)]
    found = derive.failed_over(spark.createDataFrame(sessions, "session_id long, tenant_id long, region string, gateway_id long, state string"), spark.createDataFrame(gateways, "gateway_id long, tenant_id long, region string, capacity int, healthy boolean")).collect()
    moved, load, todo = plain_failover(sessions, gateways)
    assert {x.session_id for x in found} == todo and len(found) == len(todo)
    assert Counter(x.new_gateway for x in found) == Counter(moved.get(s) for s in todo)
    of = {g: (owner, cap, healthy) for g, owner, _, cap, healthy in gateways}
    assert all(of[x.new_gateway][2] and of[x.new_gateway][0] in (None, x.tenant_id) for x in found if x.new_gateway is not None)
    assert all(load[g] <= max(cap, sum(s[3] == g and s[4] != "TERMINATED" for s in sessions)) for g, (_, cap, _) in of.items())


def test_without_a_healthy_gateway_sessions_stay(spark):
    sessions = spark.createDataFrame([(1, 1, "x", 1, "ACTIVE"), (2, 1, None, 1, "CHALLENGED")], "session_id long, tenant_id long, region string, gateway_id long, state string")
    gateways = spark.createDataFrame([(1, None, "x", 5, False)], "gateway_id long, tenant_id long, region string, capacity int, healthy boolean")
    assert sorted((r.session_id, r.new_gateway) for r in derive.failed_over(sessions, gateways).collect()) == [(1, None), (2, None)]
    more = gateways.unionByName(spark.createDataFrame([(2, None, "y", 2, True)], gateways.schema))
    assert sorted((r.session_id, r.new_gateway) for r in derive.failed_over(sessions, more).collect()) == [(1, 2), (2, 2)]


def test_digests_merge_with_a_bounded_error_of_rank(spark):
    r = random.Random(5)
    rows = [(i // 100, i % 3, r.paretovariate(1.2)) for i in range(30_000)] + [(0, 9, None)]
    table = spark.createDataFrame(rows, "second long, host long, value double")
    fine = aggregates.digests(table, ["second", "host"], "value")
    hosts = aggregates.merged_digests(fine, ["host"])
    fleet = aggregates.digest_quantiles(aggregates.merged_digests(hosts, [F.lit(1).alias("all")]), {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    values = sorted(v for *_, v in rows if v is not None)
    assert (fleet.n, fleet.min, fleet.max) == (len(values), values[0], values[-1])
    for share in (0.5, 0.95, 0.99):
        assert abs(sum(v <= fleet[f"p{round(share * 100)}"] for v in values) / len(values) - share) < 0.02
    assert aggregates.digest_quantiles(hosts, {"p50": 0.5}).filter("host = 9").first().p50 is None


def test_filter_lines(spark):
    rows = [("h1", "net", {"comm": "Bash", "dst_port": 443.0, "note": "x"}, {"level": "7", "note": "from attrs"}), ("h2", "file", {"comm": None, "dst_port": None, "note": None}, {"level": "", "note": "from attrs"})]
    table = spark.createDataFrame([(h, k, (e["comm"], e["dst_port"], e["note"], a)) for h, k, e, a in rows], "host_id string, event_kind string, event struct<comm:string, dst_port:double, note:string, attrs:map<string,string>>")
    hit = lambda line: [r.host_id for r in console.matching(table, line).collect()]
    assert hit("comm == bash") == hit("process.name == 'BASH'") == hit("name ~ as") == ["h1"]
    assert hit("port == 443") == hit("dst_port >= 443") == hit("event.dst_port < 443.5") == ["h1"] and hit("port != 443") == []
    assert hit("level > 6") == ["h1"] and hit("level < 1") == ["h2"]  # the empty text counts as 0
    assert hit("note == x") == ["h1"] and hit('note == "from attrs"') == ["h2"]
    assert hit("kind == FILE") == ["h2"] and hit("H1") == ["h1"] and hit("h1 and nothing") == [] and hit("") == ["h1", "h2"]
    assert console.parsed("a >= 'x y' AND  free  text and b~c") == ([("a", ">=", "x y"), ("b", "~", "c")], ["free  text"])


class Flaky:
    """A sink that fails in a given way before it takes a batch; some failures come after the rows are written."""

    def __init__(self, path, *faults, after=False):
        self.write, self.faults, self.after, self.calls = sinks.json_lines(str(path)), list(faults), after, 0

    def __call__(self, rows, batch):
        self.calls += 1
        fault = self.faults.pop(0) if self.faults else None
        if fault and not self.after:
            raise fault
        self.write(rows, batch)
        if fault:
            raise fault


def held(path):
    return sorted(json.loads(line)["id"] for f in path.glob("batch=*/*.json") for line in f.read_text().splitlines())


def quiet(pauses=None, attempts=3):
    return Retries(attempts, sleep=(pauses if pauses is not None else []).append, random=random.Random(1))


def test_sinks_tell_failures_apart(spark, tmp_path):
    rows, pauses = spark.range(5), []
    lost = Flaky(tmp_path / "a", OSError("gone"), OSError("gone"), after=True)
    first = Sink("first", lost, quiet(pauses))
    sinks.with_fallback([first], None)(rows, 0)
    assert held(tmp_path / "a") == [0, 1, 2, 3, 4] and (lost.calls, first.retried) == (3, 2)  # written three times, there once
    assert 0.2 <= pauses[0] <= 0.3 and 0.4 <= pauses[1] <= 0.6
    refuses = Flaky(tmp_path / "b", PermanentError("no such column"))
    takes = Sink("takes", Flaky(tmp_path / "c"), quiet())
    sinks.with_fallback([Sink("refuses", refuses, quiet()), takes], None)(rows, 1)
    assert refuses.calls == 1 and held(tmp_path / "c") == [0, 1, 2, 3, 4]
    never = Sink("never", Flaky(tmp_path / "d", *[OSError("x")] * 9), quiet())
    sinks.with_fallback([never], str(tmp_path / "dead"))(rows, 2)
    reasons = {json.loads(x)["reason"] for f in (tmp_path / "dead").glob("batch=2/*.json") for x in f.read_text().splitlines()}
    assert held(tmp_path / "dead") == [0, 1, 2, 3, 4] and reasons == {"never: OSError: x"}
    with pytest.raises(Refused, match="never"):
        sinks.with_fallback([never], None)(rows, 3)


def test_a_breaker_lasts_over_batches(spark, tmp_path):
    now = [0.0]
    flaky = Flaky(tmp_path / "a", *[OSError("x")] * 3)
    sink = Sink("s", flaky, quiet(attempts=1), Breaker(2, 30, clock=lambda: now[0]))
    write = sinks.with_fallback([sink], str(tmp_path / "dead"))
    for batch in range(3):
        write(spark.range(batch, batch + 1), batch)
    assert flaky.calls == 2 and sink.breaker.opened == 1  # the third batch did not try
    now[0] = 31.0
    write(spark.range(3, 4), 3)  # fails once more: one failure of two
    write(spark.range(4, 5), 4)
    assert flaky.calls == 4 and held(tmp_path / "a") == [4] and held(tmp_path / "dead") == [0, 1, 2, 3]


def test_a_stream_into_sinks_loses_and_doubles_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    write = sinks.with_fallback([Sink("s", Flaky(tmp_path / "a", OSError("x"), OSError("y"), after=True), quiet(attempts=1))], str(tmp_path / "dead"))
    sinks.stream_to(stream, write, str(tmp_path / "at")).awaitTermination()
    # the first two batches were written before their sink failed, and are dead letters too: a reader of both takes the batch number
    assert held(tmp_path / "a") == list(range(30)) and held(tmp_path / "dead") == list(range(20))


def test_jdbc_batches_replace_themselves(spark, tmp_path):
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    except Exception:
        pytest.skip("no database driver is at hand")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    write = sinks.jdbc(url, "EVENTS", batch_column="BATCH_ID")
    for batch, rows in ((0, spark.range(3)), (1, spark.range(3, 5)), (0, spark.range(3))):
        write(rows.withColumnRenamed("id", "ID"), batch)
    assert sorted(r.ID for r in spark.read.format("jdbc").options(url=url, dbtable="EVENTS").load().collect()) == [0, 1, 2, 3, 4]
    lines = [r.value for r in sinks.prometheus(spark.createDataFrame([("0.5", 3)], "le string, n long"), "lag").collect()]
    assert lines == ['lag_bucket{le="0.5"} 3']
