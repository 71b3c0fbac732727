"""Hard negatives: rows that score close to an anchor's positives but have another label, by blocked dense products.

Anchors are cut into blocks of BLOCK_BYTES; each block is broadcast and multiplied with every batch of candidates as float64, which is exact
as long as no sum of products can reach 2^53 (beyond that the product is one of 64-bit integers). The first pass keeps the best candidates of
an anchor's own label in each task, and merges the tasks' lists; the second keeps, for each positive, the best of the other labels in the
window below the positive's score. A task holds one block, one batch, one tile of products and a short list an anchor, whatever the number
of rows. The results of a block are appended to a table before the next block begins.

Rows with a null label, a null vector or a null or non-finite component take no part; a shorter vector counts as filled up with zeros. A
component beyond the square root of 2^63 / (128 * dims) counts as that bound, so scores fit into 64 bits. An anchor is not its own
positive, other rows of its id are. Null ids stand last in ties. Repeated anchors are answered each; no anchors give no rows. Only
id, vector and label are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.ball_kmeans import all_finite, whole_numbers
from tallgrass.llm.shared import delete, new_folder

#: Bytes of the anchors of one block, as float64.
BLOCK_BYTES = 8 << 20
#: Anchors and candidates of one tile of products: 32 MB.
TILE = (1024, 4096)
#: Sums of products below this are exact in float64.
EXACT = float(1 << 53)
_NONE = -(1 << 63)
_LAST = (1 << 63) - 1
RESULT = "anchor_id {id}, positive_id {id}, rank int, negative_id {id}, positive_score long, negative_score long"


@dataclass
class Best:
    """The best `k` candidates of each of n queries: score, id and whether the id is null, best first."""

    n: int
    k: int
    score: np.ndarray = field(init=False)
    id: np.ndarray = field(init=False)
    no_id: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.score, self.id, self.no_id = np.full((self.n, self.k), _NONE), np.full((self.n, self.k), _LAST), np.ones((self.n, self.k), bool)

    def take(self, at: np.ndarray, scores: np.ndarray, wanted: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """Merges the wanted entries of a tile of scores of the queries `at` with candidates ids."""
        worst = self.score[at, -1].astype(scores.dtype)
        wanted = wanted & (scores >= worst[:, None])
        if np.count_nonzero(wanted) > 8 * self.k * len(at) and scores.shape[1] > self.k:
            low = -np.inf if scores.dtype.kind == "f" else _NONE
            least = np.partition(np.where(wanted, scores, low), -self.k, axis=1)[:, -self.k]
            wanted &= scores >= least[:, None]
        r, c = np.nonzero(wanted)
        if not len(r):
            return
        hit = np.unique(r)
        row = np.concatenate((at[r], np.repeat(at[hit], self.k)))
        score = np.concatenate((scores[r, c].astype(np.int64), self.score[at[hit]].ravel()))
        id = np.concatenate((ids[c], self.id[at[hit]].ravel()))
        none = np.concatenate((no_id[c], self.no_id[at[hit]].ravel()))
        order = np.lexsort((none, id, -np.maximum(score, _NONE + 1), row))
        row = row[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        keep = place < self.k
        row, place, order = row[keep], place[keep], order[keep]
        self.score[row, place], self.id[row, place], self.no_id[row, place] = score[order], id[order], none[order]


@dataclass
class Block:
    """Anchors sorted by the number of their label among `labels`; in the second pass also the window of each positive."""

    matrix: np.ndarray
    labels: pa.Array
    code: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _batch(batch: pa.RecordBatch, block: Block, copies: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, ids, null marks and label numbers (-1: no anchor's) of a batch, without those rows that stand behind `copies` smaller ids
    of the same vector and label: no anchor can want them."""
    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    no_id = batch.column("id").is_null().to_numpy(zero_copy_only=False)
    ids = batch.column("id").fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = pc.index_in(batch.column("label"), value_set=block.labels).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    if x.shape[1]:
        label = np.unique(np.asarray(batch.column("label").to_numpy(zero_copy_only=False)), return_inverse=True)[1]
        same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
        order = np.lexsort((no_id, ids, label, same))
        new = np.concatenate(([True], (same[order][1:] != same[order][:-1]) | (label[order][1:] != label[order][:-1])))
        first = np.flatnonzero(new)
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        keep = np.sort(order[place < copies])
        x, ids, no_id, whole = x[keep], ids[keep], no_id[keep], whole[keep]
    return x, ids, no_id, whole


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    return a @ x.T if largest < EXACT else a.astype(np.int64) @ x.astype(np.int64).T


def _tiles(a: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, slice]]:
    for i in range(0, len(a), TILE[0]):
        for j in range(0, n, TILE[1]):
            yield a[i : i + TILE[0]], slice(j, j + TILE[1])


def _positives(batches: Iterator[pa.RecordBatch], block: Block, k: int) -> Iterator[pa.RecordBatch]:
    best = Best(len(block.matrix), k)
    for batch in batches:
        if not batch.num_rows:
            continue
        x, ids, no_id, code = _batch(batch, block, k)
        for c in np.unique(code[code >= 0]):
            mine, theirs = np.flatnonzero(block.code == c), np.flatnonzero(code == c)
            for at, part in _tiles(mine, len(theirs)):
                rows = theirs[part]
                scores = _products(block.matrix[at], x[rows])
                best.take(at, scores, np.ones(scores.shape, bool), ids[rows], no_id[rows])
    yield from _listed(best, np.zeros(1, np.int64))


def _negatives(batches: Iterator[pa.RecordBatch], block: Block, k: int) -> Iterator[pa.RecordBatch]:
    slots = block.low.shape[1]
    best = Best(len(block.matrix) * slots, k)
    everyone = np.arange(len(block.matrix))
    for batch in batches:
        if not batch.num_rows:
            continue
        x, ids, no_id, code = _batch(batch, block, k)
        for at, rows in _tiles(everyone, len(x)):
            scores = _products(block.matrix[at], x[rows])
            other = block.code[at][:, None] != code[rows][None, :]
            for s in range(slots):
                low, high = block.low[at, s][:, None].astype(scores.dtype), block.high[at, s][:, None].astype(scores.dtype)
                best.take(at * slots + s, scores, other & (scores >= low) & (scores <= high), ids[rows], no_id[rows])
    yield from _listed(best, np.arange(slots))


def _listed(best: Best, slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    r, c = np.nonzero(best.score > _NONE)
    if len(r):
        id = pa.array(best.id[r, c], mask=best.no_id[r, c])
        arrays = [pa.array(r // len(slots)), pa.array(r % len(slots)), pa.array(best.score[r, c]), id]
        yield from pa.Table.from_arrays(arrays, ["anchor", "slot", "score", "id"]).to_batches(max_chunksize=50_000)


_LISTS = "anchor long, slot long, score long, id long"


def _merged(candidates: DataFrame, task, block: Block, k: int) -> DataFrame:
    """The best k of each anchor and slot over all tasks, with their place from 1."""
    shared = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches, shared.value, k)

    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return candidates.mapInArrow(run, _LISTS).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _windows(scores: np.ndarray, there: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole score n with low * p <= 100 * n <= high * p; an empty window where there is no positive."""
    return np.where(there, -((-low * scores) // 100), 1), np.where(there, (high * scores) // 100, 0)


def mine(rows: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which `anchor` holds. Scores are inner products of floor(scale * x). Of each anchor the best `positives` other
    rows of its label, and for each of them the best `negatives` rows of other labels that score from low to high percent of it.
    """
    spark = rows.sparkSession
    kind = rows.schema[id].dataType.simpleString()
    taking = rows.filter(F.col(label).isNotNull() & all_finite(F.col(vector)))
    named = taking.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    facts = named.agg(F.max(F.size("vector")).alias("dims"), F.count_if("anchor").alias("n")).first()
    if not facts["n"]:
        return spark.createDataFrame([], RESULT.format(id=kind))
    dims = facts["dims"]
    limit = isqrt((1 << 63) // (128 * max(dims, 1)))
    v = F.transform(whole_numbers(F.col("vector"), scale, limit), lambda x: x.cast("double"))
    filled = F.when(F.size("vector") < dims, F.concat(v, F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("vector")))).otherwise(v)
    candidates = named.select("id", "label", filled.alias("v"))
    blocks = -(-facts["n"] * max(dims, 1) * 8 // block_bytes)
    folder, out = new_folder(spark, "anchors"), f"{new_folder(spark, 'negatives')}/rows"
    numbered = named.filter("anchor").select("id", "label", filled.alias("v"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"))
    numbered.repartition("block").write.partitionBy("block").parquet(f"{folder}/rows")
    stored = spark.read.parquet(f"{folder}/rows")
    for b in range(blocks):
        part = stored.filter(F.col("block") == b).select("id", "label", "v").toArrow()
        if part.num_rows:
            _of_block(part.combine_chunks(), candidates, dims, positives, negatives, low, high).write.mode("append").parquet(out)
    delete(spark, folder)
    found = spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(out)
    return found.select(*(F.col(c).cast(kind).alias(c) if c.endswith("_id") else F.col(c) for c in found.columns))


def _of_block(part: pa.Table, candidates: DataFrame, dims: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """What `mine` returns, for the anchors of one block."""
    labels = part.column("label").combine_chunks()
    kinds = labels.unique()
    code = pc.index_in(labels, value_set=kinds).to_numpy(zero_copy_only=False).astype(np.int64)
    matrix = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
    ids = part.column("id").combine_chunks()
    block = Block(matrix, kinds, code)
    # one more than asked for: the anchor itself may be among them
    best = _merged(candidates, _positives, block, positives + 1).select("anchor", "place", "score", "id").toArrow()
    n = part.num_rows
    score, named, there = np.zeros((n, positives + 1), np.int64), np.full((n, positives + 1), _LAST), np.zeros((n, positives + 1), bool)
    null = np.ones((n, positives + 1), bool)
    a, p = best.column("anchor").to_numpy(), best.column("place").to_numpy() - 1
    score[a, p], there[a, p] = best.column("score").to_numpy(), True
    named[a, p], null[a, p] = best.column("id").fill_null(_LAST).to_numpy(), best.column("id").is_null().to_numpy()
    own_score = (matrix.astype(np.int64) ** 2).sum(axis=1)[:, None]
    own_null = ids.is_null().to_numpy(zero_copy_only=False)[:, None]
    own = there & (score == own_score) & (null == own_null) & (named == ids.fill_null(_LAST).to_numpy(zero_copy_only=False)[:, None])
    # the anchor itself, or a row that shows the same id and score; without it in the list, the last is one too many
    gone = np.where(own.any(axis=1), own.argmax(axis=1), positives)
    rest = np.arange(positives + 1)[None, :] != gone[:, None]
    score, named, there, null = (m[rest].reshape(n, positives) for m in (score, named, there, null))
    block.low, block.high = _windows(score, there, low, high)
    found = _merged(candidates, _negatives, block, negatives)
    r, s = np.nonzero(there)
    listed = pa.table({"anchor": r, "slot": s, "anchor_id": ids.take(pa.array(r)), "positive_id": pa.array(named[r, s], mask=null[r, s]), "positive_score": score[r, s]})
    # as many rows as the block has positives: bounded by the block
    known = F.broadcast(candidates.sparkSession.createDataFrame(listed))
    return found.join(known, ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
