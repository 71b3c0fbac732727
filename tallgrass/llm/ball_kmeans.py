"""Ball k-means: exact k-means in whole numbers that compares a vector only with the centroids it could move to.

A cluster is a ball: its centroid and a radius that covers its vectors. Another centroid is its neighbour if it stands within twice the
radius. Half the way to the nearest neighbour bounds the stable core, whose vectors cannot move; the half ways to the further ones bound
annuli, and a vector in the n-th annulus is compared with the n nearest neighbours only, exactly. All squares are of whole numbers, and a
vector just on a bound is compared, so result and ties are those of comparing everything with everything.

What the driver holds is the centroids, their distances and one row of sums a cluster: bounded by the number of clusters, not by the rows.
Every round writes its assignment, so a lost executor costs no earlier round.

Null, wrongly long, and null or non-finite vectors take no part and are not returned. A component beyond LIMIT counts as LIMIT, so that
squares fit into 64 bits; sums of distances that do not fit become the largest long. Fewer vectors than clusters give fewer clusters;
none give no rows. Equal vectors, equal ids and null ids are rows of their own; further columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.shared import discard, stored

#: Largest component, after scaling: four times the square of the distance of two vectors of 64 such stays below 2^63.
LIMIT = 1 << 26
_MOST = (1 << 63) - 1


def whole_numbers(vector: Column, scale: int, limit: int) -> Column:
    """floor(scale * x) of each component, x as double, within the limit."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), x.cast("double") * F.lit(float(scale))))))


def all_finite(vector: Column) -> Column:
    """False for a null vector and for a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


@dataclass
class Balls:
    """Centroids, and for each cluster its neighbours from near to far with the square of their distance; None: everything is compared."""

    centroids: np.ndarray
    neighbours: list[np.ndarray] | None = None
    gaps: list[np.ndarray] | None = None


def balls(centroids: np.ndarray, radius: dict[int, int]) -> Balls:
    """radius: for each cluster that has vectors a distance that none of them exceeds."""
    neighbours, gaps = [], []
    for i, c in enumerate(centroids):
        gap = ((centroids - c) ** 2).sum(axis=1)
        order = np.argsort(gap, kind="stable")
        reach = min(4 * radius.get(i, 0) ** 2, _MOST)
        near = order[(order != i) & (gap[order] <= reach)] if i in radius else order[:0]
        neighbours.append(near)
        gaps.append(gap[near])
    return Balls(centroids, neighbours, gaps)


def nearest(v: np.ndarray, own: np.ndarray | None, b: Balls) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each row; ties go to the smaller number. own: the clusters up to now."""
    c = b.centroids
    if own is None or b.neighbours is None:
        d = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
        best = d.argmin(axis=1)  # the first of equals
        return best, d[np.arange(len(v)), best]
    best, least = own.copy(), ((v - c[own]) ** 2).sum(axis=1)
    start = least.copy()
    for i in np.unique(own):
        members = np.flatnonzero(own == i)
        annulus = np.searchsorted(b.gaps[i], 4 * start[members], "right")  # 0 is the stable core
        for a in range(int(annulus.max())):
            rows, j = members[annulus > a], b.neighbours[i][a]
            d = ((v[rows] - c[j]) ** 2).sum(axis=1)
            better = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
            best[rows[better]], least[rows[better]] = j, d[better]
    return best, least


def _assigned(rows: DataFrame, id: str, b: Balls) -> DataFrame:
    schema = f"`{id}` {rows.schema[id].dataType.simpleString()}, v array<bigint>, cluster int, distance bigint"
    known = "cluster" in rows.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            best, least = nearest(v, batch.column("cluster").to_numpy().astype(np.int64) if known else None, b)
            yield pa.RecordBatch.from_arrays([batch.column(id), batch.column("v"), pa.array(best.astype(np.int32)), pa.array(least)], [id, "v", "cluster", "distance"])

    return rows.mapInArrow(assign, schema)


def _first(rows: DataFrame, id: str, k: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes; of one id, the smaller vector first."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["v"] for r in rows.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()], dtype=np.int64)


def cluster(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 (of the final centroid's components, comma-joined) of every vector."""
    spark = rows.sparkSession
    narrow = rows.select(F.col(id).alias(id), F.col(vector).alias("__vector")).filter((F.size("__vector") == dims) & all_finite(F.col("__vector")))
    kept = narrow.select(id, whole_numbers(F.col("__vector"), scale, LIMIT).alias("v"))
    centroids = _first(kept, id, k)
    kind = rows.schema[id].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"`{id}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    now, shape = kept, Balls(centroids)
    for n in range(rounds + 1):
        now, before = stored(_assigned(now, id, shape), "balls"), now
        discard(before)
        if n == rounds:
            break
        sums = now.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), *(F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dims))).collect()
        moved, radius = centroids.copy(), {}
        for r in sums:
            moved[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
            shift = int(((moved[r["cluster"]] - centroids[r["cluster"]]) ** 2).sum())
            # what was within the radius of the old centroid is within radius and shift of the new one
            radius[r["cluster"]] = isqrt(r["far"]) + 1 + isqrt(shift) + 1
        centroids, shape = moved, balls(moved, radius)
    inertia = {r["cluster"]: r["s"] if r["s"] is not None else _MOST for r in now.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    total = min(sum(inertia.values()), _MOST)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, s, total, digest[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.select(id, "cluster", "distance").join(F.broadcast(facts), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
