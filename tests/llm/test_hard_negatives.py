import math
import random

import pytest
from pyspark.sql import functions as F

from tallgrass.llm import hard_negatives
from tallgrass.llm.queries import op13_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score int, slot int, anchor string"


def rows_of(n, dims=4, labels=3, seed=1):
    r = random.Random(seed)
    return [(i, [round(r.gauss(0.3, 0.4), 2) for _ in range(dims)], r.randrange(labels)) for i in range(n)]


def plain(rows, anchors, p=5, k=3, low=50, high=95, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v], l) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda e: (-e[1], e[0] is None, e[0] or 0)
    out = []
    for a, (i, v, l) in enumerate(kept):
        if i is None or not anchors(i):
            continue
        scores = [(j, sum(x * y for x, y in zip(v, w)), m, b) for b, (j, w, m) in enumerate(kept)]
        for q, s, _, _ in sorted((e for e in scores if e[2] == l and e[3] != a), key=rank)[:p]:
            negatives = sorted((e for e in scores if e[2] != l and low * s <= 100 * e[1] <= high * s), key=rank)[:k]
            out += [(i, q, n + 1, e[0], s, e[1]) for n, e in enumerate(negatives)]
    return sorted(out, key=str)


def found(spark, rows, anchors, **how):
    table = spark.createDataFrame([(i, v, l, 1, 2, "x") for i, v, l in rows], SCHEMA)
    return sorted((tuple(r) for r in hard_negatives.mine(table, anchors(F.col("vec_id")), **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"positives": 1, "negatives": 7}, {"block_bytes": 100}, {"low": 10, "high": 100}])
def test_like_scoring_everything(spark, how):
    rows = rows_of(80)
    names = {"positives": "p", "negatives": "k", "low": "low", "high": "high"}
    want = plain(rows, lambda i: i % 6 == 0, **{names[n]: x for n, x in how.items() if n in names})
    assert found(spark, rows, lambda c: c % 6 == 0, **how) == want
    assert len(want) > 20


def test_ties_copies_and_null_ids(spark):
    """A vector that a third of the rows have, repeated rows and ids, anchors among the copies, null ids behind all others."""
    rows = rows_of(40, dims=3) + [(100 + i, [0.5, 0.5, 0.5], i % 2) for i in range(40)]
    rows += [(12, [0.4, 0.4, 0.4], 1)] * 3 + [(None, [0.5, 0.5, 0.5], 0), (None, [0.5, 0.5, 0.5], 1), (12, [0.1, 0.9, 0.1], 2)]
    assert found(spark, rows, lambda c: c % 4 == 0) == plain(rows, lambda i: i % 4 == 0)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(30) + [(60, None, 1), (66, [1.0, None, 0.0, 0.0], 1), (72, [nan] * 4, 1), (78, [inf] * 4, 0), (84, [0.1] * 4, None), (90, [0.3, 0.2], 1), (96, [], 2), (102, [0.0] * 4, 0)]
    assert found(spark, rows, lambda c: c % 6 == 0) == plain(rows, lambda i: i % 6 == 0)


def test_scores_beyond_exact_floats(spark):
    """Products of 2^50 in sums beyond 2^53 differ in their last places only."""
    rows = [(i, [2.0**17 + i % 5, 2.0**17 - i % 3, 2.0**17 + (i % 7) / 2], i % 2) for i in range(24)]
    assert found(spark, rows, lambda c: c % 6 == 0, high=100) == plain(rows, lambda i: i % 6 == 0, high=100)


def test_nothing_to_do(spark):
    assert found(spark, rows_of(5), lambda c: c == 77) == []
    empty = hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0)
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_query_moves_labels(spark, tmp_path):
    rows = rows_of(120, labels=10, seed=8)
    spark.createDataFrame([(i, v, l) for i, v, l in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    as_float = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    moved = [(i, v, (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in as_float]
    assert sorted((tuple(r) for r in op13_hard_negatives(spark, str(tmp_path)).collect()), key=str) == plain(moved, lambda i: i % 50 == 0)
