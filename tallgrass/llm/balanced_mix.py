"""Mixing sources to target weights by the cube method (Deville and Tille, 2004).

Every document of a source has the same expected number of copies, target / source size. Its whole part is taken outright; the
fractional part is an inclusion probability. The flight moves these probabilities along directions that keep the number of
documents and the number of tokens of the source, until each is 0 or 1. It runs in blocks of a bounded number of documents;
the at most two documents that a block leaves undecided meet in blocks of the next level, until one block a source is left.
Its last one or two documents are the landing: documents are decided from the largest to the smallest, so these are the
source's smallest, and the landing drops first the document total, then the token total.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, last in order; repeated
rows are documents of their own; equal sizes are ordered by a seeded hash of the id; an empty table gives an empty result; a
source without words gets target 0.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.shared import join_small, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one flight decides together.
BLOCK_ROWS = 2000
#: Probabilities this close to 0 or 1 count as decided.
EPS = 1e-9

_FLIGHT_SCHEMA = "doc_id long, text_key long, source string, size long, whole long, p double, rank long"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key() -> Column:
    """Tells apart rows of one id with different texts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _places(totals: DataFrame) -> DataFrame:
    """totals with the place of each source by code point, null last, from 0. Sorted in ranges, so sources may be many."""
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    ranged = stored(totals.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    sizes = sorted((r.part, r["count"]) for r in ranged.groupBy("part").count().toLocalIterator())  # one a partition
    before = dict(zip((p for p, _ in sizes), [0, *accumulate(n for _, n in sizes)], strict=False))
    first = totals.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return join_small(ranged, first, ["part"], len(before)).withColumn("place", F.col("before") + own).drop("part", "before")


def source_targets(sizes: DataFrame, weights: DataFrame | None = None, ceiling: float = 3.0) -> DataFrame:
    """One row a source: source, source_size, target. Without weights, sources weigh 1, 2, 3, repeating, by code point, null last.

    Targets share the total of all sizes by weight; one above ceiling * source_size stops there and its excess goes to the others by
    weight, until none is above. Each round is one sum over the sources; there are at most as many as distinct ceiling / weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        totals = _places(totals).withColumn("weight", (F.col("place") % 3 + 1).cast("double")).drop("place")
    else:
        totals = join_small(totals, weights.select("source", F.col("weight").cast("double")), ["source"])
    totals = stored(totals.withColumn("cap", F.col("source_size") * F.lit(float(ceiling))), "caps")
    everything = totals.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        # sources whose share at this level is above their ceiling have stopped
        stopped = F.col("cap") < F.col("weight") * F.lit(level) - F.lit(1e-9)
        fixed, free = totals.agg(F.sum(F.when(stopped, F.col("cap"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        now = (everything - (fixed or 0.0)) / free if free else level
        if now <= level:
            break
        level = now
    return totals.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Decides the rows in the given order; at most two stay between 0 and 1, the totals of p and of size * p stay as they were."""
    p = p.astype(float).copy()
    scale = size.mean() or 1.0
    x = np.stack([np.ones(len(size)), size / scale])
    open_rows = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
    draw = iter(draws)
    while len(open_rows) > 2:
        head, rest = open_rows[0], open_rows[1:]
        a, q = x[:, rest], p[rest]
        if len(rest) > 2 and np.ptp(a[1]) > 1e-12:
            # e_head plus the least-squares answer of the rest, weighted by its room to move, so that A u = 0
            room = np.maximum(q * (1 - q), 1e-6)
            move = -room * (a.T @ np.linalg.solve((a * room) @ a.T, x[:, head]))
        elif np.ptp(a[1]) > 1e-12:
            move = -np.linalg.solve(a, x[:, head])
        elif abs(a[1, 0] - x[1, head]) > 1e-12:  # the rest are alike and the head is not: leave it, move two of the rest
            head, rest = rest[0], rest[1:2]
            q, move = p[rest], np.array([-1.0])
        else:
            rest = rest[:1]
            q, move = p[rest], np.array([-1.0])
        rows, u = np.append(rest, head), np.append(move, 1.0)
        now = np.append(q, p[head])
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - now) / u, np.where(u < 0, -now / u, np.inf)))
            down = np.min(np.where(u > 0, now / u, np.where(u < 0, (now - 1) / u, np.inf)))
        step = up if next(draw, 0.5) * (up + down) < down else -down
        now = now + step * u
        now[now < EPS], now[now > 1 - EPS] = 0.0, 1.0
        p[rows] = now
        left = open_rows[(p[open_rows] > 0) & (p[open_rows] < 1)]
        if len(left) == len(open_rows):
            k = left[np.argmin(np.minimum(p[left], 1 - p[left]))]  # rounding: the nearest counts as decided
            p[k] = float(p[k] > 0.5)
            left = left[left != k]
        open_rows = left
    return p


def landing(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Decides the last rows: two keep the tokens' total while one of them moves to 0 or 1, the last one is drawn."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left) == 2:
        i, j = left
        u = (1.0, -size[i] / size[j]) if size[j] > 0 else (0.0, 1.0) if size[i] > 0 else (1.0, -1.0)
        bounds = [((1 - v) / d if d > 0 else -v / d, v / d if d > 0 else (v - 1) / d) for v, d in zip((p[i], p[j]), u, strict=True) if d]
        up, down = min(b[0] for b in bounds), min(b[1] for b in bounds)
        step = up if draws[0] * (up + down) < down else -down
        for k, d in zip((i, j), u, strict=True):
            v = p[k] + step * d
            p[k] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
    for n, k in enumerate(np.flatnonzero((p > 0) & (p < 1))):
        p[k] = float(draws[1 + n] < p[k])
    return p


def _decide(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # equal rows may change places: they are the same in every column that is returned
        rows = rows.sort_values(["size", "rank", "doc_id", "text_key"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        size, p = rows["size"].to_numpy(float), rows["p"].to_numpy(float)
        draws = np.random.Generator(np.random.PCG64(int(np.bitwise_xor.reduce(rows["rank"].to_numpy(np.int64))) & 0x7FFFFFFF)).random(len(rows) + 8)
        p = flight(size, p, draws)
        rows["p"] = landing(size, p, draws[::-1]) if last else p
        return rows.drop(columns="__block")

    return run


def mix(docs: DataFrame, weights: DataFrame | None = None, ceiling: float = 3.0, seed: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, copies, taken of every document of docs(doc_id, text, source).

    weights(source, weight) replaces the default 1, 2, 3. copies is how often the mix takes the document, taken = size * copies.
    """
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    targets = stored(source_targets(sized, weights, ceiling), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = join_small(sized, targets, ["source"]).withColumn("copies", ratio)
    whole = F.floor(F.col("copies") + EPS)
    rows = rows.select(
        "doc_id", "text_key", "source", "size", whole.alias("whole"), F.greatest(F.lit(0.0), F.col("copies") - whole).alias("p"),
        F.xxhash64(F.lit(seed), "doc_id", "size").alias("rank"),
    )
    largest = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    done, open_rows, level = [], rows, 0
    while True:
        blocks = max(1, -(-largest // block_rows))
        block = F.pmod(F.xxhash64(F.lit(seed + 1 + level), "rank"), F.lit(blocks)) if blocks > 1 else F.lit(0)
        decided = stored(open_rows.withColumn("__block", block).groupBy("source", "__block").applyInPandas(_decide(blocks == 1), _FLIGHT_SCHEMA), f"flight{level}")
        settled = (F.col("p") == 0) | (F.col("p") == 1)
        if blocks == 1:
            done.append(decided)
            break
        done.append(decided.filter(settled))
        open_rows, largest, level = decided.filter(~settled), 2 * blocks, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = join_small(out, targets, ["source"]).withColumn("copies", (F.col("whole") + F.col("p").cast("long")).cast("long"))
    return out.select("doc_id", "text_key", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
