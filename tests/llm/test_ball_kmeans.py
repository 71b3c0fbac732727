import hashlib
import math
import random

import numpy as np
import pytest

from tallgrass.llm import ball_kmeans

SCHEMA = "vec_id long, embedding array<double>, label int, v string, cluster int, distance long"


def rows_of(n, dims, seed=3, spots=4):
    r = random.Random(seed)
    at = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(spots)]
    return [(i, [x + r.gauss(0, 0.2) for x in at[i % spots]]) for i in range(n)]


def plain(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(max(-ball_kmeans.LIMIT, min(ball_kmeans.LIMIT, scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [v for _, v in first]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((d(v, c), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                cs[n] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = {}
    for _, c, x in out:
        sums[c] = sums.get(c, 0) + x
    total = min(sum(sums.values()), (1 << 63) - 1)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, c, x, min(sums[c], (1 << 63) - 1), total, sha[c]) for i, c, x in out]


def found(spark, rows, **how):
    table = spark.createDataFrame([(i, v, 1, "x", 7, 7) for i, v in rows], SCHEMA)
    return [tuple(r) for r in ball_kmeans.cluster(table, **how).collect()]


def key(r):
    return tuple(-1 if x is None else x for x in r)


@pytest.mark.parametrize("k, rounds, scale", [(5, 3, 64), (12, 4, 8), (1, 2, 64), (5, 0, 64)])
def test_like_comparing_everything(spark, k, rounds, scale):
    rows = rows_of(90, 6)
    got = found(spark, rows, k=k, rounds=rounds, dims=6, scale=scale)
    assert sorted(got, key=key) == sorted(plain(rows, k, rounds, 6, scale), key=key)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(20, 3) + [(None, [0.1, 0.2, 0.3]), (None, [0.1, 0.2, 0.3]), (5, [0.5, 0.5, 0.5]), (5, [0.5, 0.5, 0.5])]  # null ids, repeated rows
    rows += [(50, None), (51, []), (52, [1.0, 2.0]), (53, [1.0, None, 2.0]), (54, [nan, 0.0, 0.0]), (55, [inf, 0.0, 0.0]), (56, [1e300, -1e300, 0.0])]
    got = found(spark, rows, k=6, dims=3)
    assert sorted(got, key=key) == sorted(plain(rows, 6, 3, 3, 64), key=key)
    assert len(got) == 25


def test_equal_vectors_and_empty_clusters(spark):
    rows = [(i, [1.0, 1.0]) for i in range(30)] + [(30, [2.0, 2.0])]
    got = found(spark, rows, k=8, dims=2)
    assert sorted(got) == sorted(plain(rows, 8, 3, 2, 64))


def test_few_and_no_rows(spark):
    assert sorted(found(spark, rows_of(3, 2), k=16, dims=2)) == sorted(plain(rows_of(3, 2), 16, 3, 2, 64))
    empty = ball_kmeans.cluster(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_balls_spare_most_comparisons():
    """Far-off clusters are no neighbours; a vector in the core is compared with nothing."""
    cs = np.array([[0, 0], [10, 0], [1000, 0]])
    b = ball_kmeans.balls(cs, {0: 6, 1: 4, 2: 3})
    assert [n.tolist() for n in b.neighbours] == [[1], [], []]
    best, least = ball_kmeans.nearest(np.array([[4, 0], [5, 0], [6, 0], [11, 0]]), np.array([0, 0, 0, 1]), b)
    assert best.tolist() == [0, 0, 1, 1] and least.tolist() == [16, 25, 16, 1]
