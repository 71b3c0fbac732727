import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import BLANK, awkward
from tallgrass.llm import balanced_mix


def targets(sizes):
    """By the rule itself: share by weight, stop at three times the size, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 0, None: 7}, {"x": 3}, {"a": 1, "b": 1, "c": 1, "d": 900}, {"é": 5, "z": 5, "B": 50}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r.source: r.target for r in balanced_mix.source_targets(rows).collect()}
    assert found == pytest.approx(targets(sizes))


def test_flight_keeps_both_totals():
    r = np.random.default_rng(1)
    for trial in range(20):
        size = np.sort(r.integers(0, 500, 200))[::-1].astype(float)
        p = np.full(200, r.random())
        out = balanced_mix.flight(size, p, r.random(400))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())


def test_flight_is_unbiased():
    size = np.array([9.0, 5, 5, 4, 3, 2, 1, 1])
    p = np.full(8, 0.4)
    r = np.random.default_rng(2)
    draw = lambda: balanced_mix.landing(size, balanced_mix.flight(size, p, r.random(30)), r.random(4))
    assert np.mean([draw() for _ in range(4000)], axis=0) == pytest.approx(p, abs=0.04)


def test_mix(spark, docs):
    found = balanced_mix.mix(docs, block_rows=4).collect()
    expected = sorted(((i, len(BLANK.findall(t or "")), s) for i, t, _, s in awkward()), key=repr)
    assert sorted(((r.doc_id, r["size"], r.source) for r in found), key=repr) == expected
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in found:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"] and r.taken == r["size"] * r.copies
    want = targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, balanced_mix.mix(docs, block_rows=4).collect()), key=repr)


def test_sources_come_near_their_targets(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 7919 % 200).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    found = balanced_mix.mix(rows, block_rows=100).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want")).collect()
    assert all(math.isclose(r.t, r.want, rel_tol=0.01) for r in found)


def test_empty(nothing):
    assert balanced_mix.mix(nothing).count() == 0
