"""Derived values, sessions, alerts, selection and deltas on hand-made rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import derive, graph, selection, tables


def test_cgroups(spark):
    pod = "12345678_90ab_cdef_1234_567890abcdef"
    cgroups = spark.createDataFrame([(1, f"/kube/pod{pod}/{'ab' * 32}"), (2, "/user.slice")], "cgroup_id long, path string")
    rows = derive.with_cgroups(spark.createDataFrame([(1,), (2,), (3,)], "cgroup_id long"), cgroups).orderBy("cgroup_id").collect()
    assert [(r.container_id, r.pod_uid) for r in rows] == [("ab" * 32, pod.replace("_", "-")), (None, None), (None, None)]


def test_sessions(spark):
    sessions = spark.createDataFrame([(1, 1, 10, "ACTIVE", 100, 190), (2, 1, 11, "TERMINATED", 500, 500), (3, 2, 11, "ACTIVE", 500, 100), (4, 2, 12, "RESTRICTED", 500, 195)], "session_id long, tenant_id long, gateway_id long, state string, expires_s long, heartbeat_s long").withColumn("host_id", F.lit("h"))
    faults = {r.session_id: r.fault for r in derive.session_faults(sessions, F.lit(200), 60).collect()}
    assert faults == {1: "expired", 2: None, 3: "stale", 4: None}
    alerts = spark.createDataFrame([("a", 1, "h"), ("b", 2, "x")], "alert_id string, tenant_id long, host_id string")
    assert [(r.alert_id, r.session_id) for r in derive.alerts_of_sessions(alerts, sessions).collect()] == [("a", 1)]


def test_inventory_and_alert_filters(spark):
    programs = spark.createDataFrame([(1, False, 9, 10), (2, True, 1, 5), (3, True, 4, None)], "id long, attributed boolean, run_count long, bytes_memlock long")
    rows, total = derive.inventory(programs)
    assert [r.id for r in rows.collect()] == [3, 2, 1] and total.first().bytes == 15
    alerts = spark.createDataFrame([(1, "high", "r1", ["Isolate"]), (2, "high", "r2", []), (1, "low", "r1", [])], "tenant_id long, severity string, rule_id string, actions array<string>")
    n = lambda **by: tables.filtered_alerts(alerts, **by).count()
    assert (n(), n(tenant=1), n(severity="high"), n(tenant=1, severity="high"), n(rule="r2"), n(text="ISOL")) == (3, 2, 2, 1, 1, 1)


def test_lowest_free_of_keys_without_slots(spark):
    taken = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), ("c", 99)], "k string, s long")
    assert {r.k: r.free for r in tables.lowest_free(taken, "s", 1, 2, ["k"]).collect()} == {"a": None, "b": 1, "c": 1}


def test_delta_and_canaries(spark):
    edge = "src long, dst long, kind string, ts long, seq long"
    vertex = "id long, label string, risk double, last_seen long, is_canary boolean"
    old = spark.createDataFrame([(1, "p", 0.1, 5, False), (2, "p", 0.2, 50, True)], vertex)
    new = spark.createDataFrame([(2, "q", 0.9, 9, False), (3, "q", 0.3, 9, True)], vertex)
    risks = spark.createDataFrame([(1, 0.5, 7), (1, 0.4, 9), (2, 1.0, 99)], "id long, risk double, at long")
    edges, vertices = graph.merged(spark.createDataFrame([(1, 2, "a", 5, 1)], edge), spark.createDataFrame([(1, 2, "b", 5, 2), (2, 3, "c", 1, 3)], edge), old, new, risks, ["ts", "seq"])
    assert sorted((r.src, r.dst, r.kind) for r in edges.collect()) == [(1, 2, "b"), (2, 3, "c")]
    assert sorted(tuple(r) for r in vertices.collect()) == [(1, "p", 0.4, 9, False), (2, "q", 0.9, 9, False), (3, "q", 0.3, 9, True)]
    assert {r.id: r.is_canary for r in graph.canaries(vertices, spark.range(1, 5)).collect()} == {1: False, 2: False, 3: True, 4: False}


BUDGET = dict.fromkeys(selection.RESOURCES, 1.0)


@pytest.fixture(scope="module")
def items(spark):
    cost = lambda i, m: (i * m % 13 + 1) / 30
    rows = [(w, i, 0.05 + (i * 37 % 19) / 20, *(cost(i + w, m) for m in (3, 5, 7, 11, 2))) for w, n in ((1, 9), (2, 12), (3, 70)) for i in range(n)]
    return spark.createDataFrame(rows, f"w long, item long, relevance double, {', '.join(f'{r} double' for r in selection.RESOURCES)}")


def costs(row):
    return [row[r] for r in selection.RESOURCES]


def fits(rows):
    return all(sum(c) <= 1 + 1e-6 for c in zip(*map(costs, rows), strict=True))


def test_every_window_is_solved_whole(items):
    """Small windows hold the best of all subsets; one that is too large is solved greedily; none loses items on the way."""
    rows = items.collect()
    found = selection.selected(items, "w", "item", BUDGET, F.lit(0.5), F.lit(True)).collect()
    assert {(r.w, r.tier) for r in found} == {(1, "exact"), (2, "exact"), (3, "greedy")}
    for w in (1, 2):
        own = [r for r in rows if r.w == w]
        best = max(sum(r.relevance for r in s) for n in range(len(own) + 1) for s in itertools.combinations(own, n) if not s or fits(s))
        assert sum(r.relevance for r in found if r.w == w) == pytest.approx(best)
    assert {r.item for r in found if r.w == 3} == {r.item for r in selection.greedy(items.filter("w = 3"), "w", "item", BUDGET).collect()}


def test_exact_takes_the_first_of_equal_sets(spark):
    """Against trying every set in depth-first order, also where many sets are equal, and where items are worth nothing."""
    r, rows = random.Random(3), []
    for w in range(60):
        for i in range(1 + w % 10):
            rows.append((w, i, r.choice([-0.5, 0.0, 0.25, 0.5, 0.5, 1.0]) if w % 2 else r.random(), *(r.randrange(1, 9) / 8 for _ in selection.RESOURCES)))
    items = spark.createDataFrame(rows, f"w long, item long, relevance double, {', '.join(f'{c} double' for c in selection.RESOURCES)}")
    found = sorted((x.w, x.item) for x in selection.exact(items, "w", "item", dict.fromkeys(selection.RESOURCES, 1.5)).collect())
    want = []
    for w in range(60):
        own, best = sorted((x for x in rows if x[0] == w and x[2] > 0), key=lambda x: (-x[2], x[1])), (0.0, ())

        def go(i, taken):
            nonlocal best
            if sum(x[2] for x in taken) > best[0] + 1e-12:
                best = (sum(x[2] for x in taken), taken)
            if i < len(own):
                if all(sum(x[3 + c] for x in (*taken, own[i])) <= 1.5 + 1e-9 for c in range(5)):
                    go(i + 1, (*taken, own[i]))
                go(i + 1, taken)

        go(0, ())
        want += [(w, x[1]) for x in best[1]]
    assert found == sorted(want)


def test_exact_takes_full_windows_of_copies(spark):
    """64 items of one relevance: without bounds on value and number the search would try billions of sets."""
    cost = lambda i, m: F.round((F.col("item") * m % 17 + 1) / 20, 2)
    items = spark.range(128).select((F.col("id") % 2).alias("w"), F.col("id").alias("item"), F.lit(0.3).alias("relevance"))
    items = items.select("*", *(cost("item", m).alias(r) for m, r in zip((3, 5, 7, 11, 13), selection.RESOURCES, strict=True)))
    budget = dict(zip(selection.RESOURCES, (3.0, 4.0, 3.0, 2.5, 3.0), strict=True))
    exact = selection.exact(items, "w", "item", budget).groupBy("w").agg(F.count(F.lit(1)).alias("n"), *(F.sum(r).alias(r) for r in selection.RESOURCES)).collect()
    greedy = {r.w: r.n for r in selection.greedy(items, "w", "item", budget).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(exact) == 2 and all(r.n >= greedy[r.w] and all(r[c] <= budget[c] + 1e-6 for c in selection.RESOURCES) for r in exact)


def test_relaxation(items):
    """Against the same steps over plain lists."""
    found = selection.relaxed(items, "w", "item", BUDGET).collect()
    for w in (1, 2, 3):
        own, left, half = sorted((r for r in items.collect() if r.w == w), key=lambda r: (-r.relevance / sum(costs(r)), r.item)), [1.0] * 5, []
        for r in own:
            weight = sum(c * k for c, k in zip(costs(r), selection.COST_WEIGHTS, strict=True))
            if r.relevance - selection.PENALTY * weight <= 0:
                continue
            part = min(1.0, *(x / c for x, c in zip(left, costs(r), strict=True)))
            left = [x - part * c for x, c in zip(left, costs(r), strict=True)]
            half += [r] if part >= 0.5 else []
        kept, left = [], [1.0] * 5
        for r in sorted(half, key=lambda r: r.item):
            if all(c <= x + 1e-9 for c, x in zip(costs(r), left, strict=True)):
                left = [x - c for x, c in zip(left, costs(r), strict=True)]
                kept.append(r.item)
        assert sorted(r.item for r in found if r.w == w) == sorted(kept) and fits([r for r in found if r.w == w])
