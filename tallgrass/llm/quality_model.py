"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays.

The trees are fitted on a bounded sample of labelled rows (SAMPLE_ROWS by a hash of the id, a few hundred kilobytes of
numbers) with logistic loss: features are cut into BINS quantile bins, each level's splits are found from sums of
gradients by bin. The fitted model is six small arrays, and scoring walks all rows of a batch down all trees at once in numpy.

Defined results: null and empty texts have zero statistics and are scored like any text; ids labelled with both classes count once for
each; without labels every score is 0.5; further columns are kept, those named like the result column replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm.shared import shielded, stored
from tallgrass.llm.words import BLANK_SPLIT_FOLDED, alphabet, chunked, run_hashes

SAMPLE_ROWS = 20_000
TREES = 120
DEPTH = 4
BINS = 64
RATE = 0.1

_LINES = alphabet(lambda b: b != 0x0A, fold=False)
_byte = np.arange(256)
_CLASSES = {
    "upper": (_byte >= 0x41) & (_byte <= 0x5A),
    "lower": (_byte >= 0x61) & (_byte <= 0x7A),
    "digit": (_byte >= 0x30) & (_byte <= 0x39),
    "blank": (_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)),
    "stop": np.isin(_byte, list(b".?!")),
    "comma": np.isin(_byte, list(b",;:")),
    "quote": np.isin(_byte, list(b"\"'()[]")),
    "symbol": np.isin(_byte, list(b"#*$%&|<>")),
    "other": np.isin(_byte, list(b"@/\\^_`{}~+-=")),
    "wide": _byte >= 0xC0,
}
FEATURES = [
    "log_words", "word_length", "long_words", "distinct_words", "top_word", "repeat_pairs", "repeat_runs", "log_lines", "line_words",
    "repeat_lines", "repeat_line_share", *_CLASSES, "words_with_symbol", "upper_words",
]


def _share_repeated(owner: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: distinct values, and how often its most frequent value occurs."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    times = np.diff(np.append(head, len(h)))
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, owner[head], times)
    return np.bincount(owner[head], minlength=texts), most


def statistics(column: pa.Array) -> np.ndarray:
    """The features of all texts of a column, a row each."""
    lines_of = chunked(column, _LINES)
    out = []
    for w in chunked(column, BLANK_SPLIT_FOLDED):
        lines = next(lines_of)  # cut at the same texts: chunks depend on the texts' bytes only
        texts = len(w.lo)
        size = (w.text_at[1:] - w.text_at[:-1]).astype(float)
        safe = np.maximum(size, 1)
        n = (w.hi - w.lo).astype(float)
        words = np.maximum(n, 1)
        owner = w.text_of_word()
        length = w.end - w.start
        by_text = lambda x, owner=owner, texts=texts: np.bincount(owner, weights=x, minlength=texts)
        distinct, top = _share_repeated(owner, w.hash, texts)

        def repeated(k: int, w=w, owner=owner, texts=texts) -> np.ndarray:
            h = run_hashes(w.hash, k)
            inside = owner[: len(h)] == owner[k - 1 :] if len(owner) >= k else np.zeros(0, bool)
            own = owner[: len(h)][inside]
            total = np.bincount(own, minlength=texts)
            return 1 - _share_repeated(own, h[inside], texts)[0] / np.maximum(total, 1) * (total > 0) - (total == 0)

        line_owner = lines.text_of_word()
        n_lines = (lines.hi - lines.lo).astype(float)
        line_size = lines.end - lines.start
        order = np.lexsort((lines.hash, line_owner))
        same = np.zeros(len(order), bool)
        same[1:] = (lines.hash[order][1:] == lines.hash[order][:-1]) & (line_owner[order][1:] == line_owner[order][:-1])
        again_n = np.bincount(line_owner[order][same], minlength=texts)
        again_size = np.bincount(line_owner[order][same], weights=line_size[order][same].astype(float), minlength=texts)
        count_of = {}
        for name, member in _CLASSES.items():
            running = np.concatenate(([0], np.cumsum(member[w.data])))
            count_of[name] = (running[w.text_at[1:]] - running[w.text_at[:-1]]).astype(float)
            if name in ("symbol", "upper"):
                inside = running[w.end] - running[w.start]
                count_of[f"words_{name}"] = by_text((inside > 0) if name == "symbol" else (inside >= 2) & (inside * 2 >= length))
        columns = [np.log1p(n), by_text(length.astype(float)) / words, by_text(length > 14) / words, distinct / words, top / words, repeated(2), repeated(5), np.log1p(n_lines), n / np.maximum(n_lines, 1), again_n / np.maximum(n_lines, 1), again_size / safe]
        columns += [count_of[name] / safe for name in _CLASSES] + [count_of["words_symbol"] / words, count_of["words_upper"] / words]
        out.append(np.stack(columns, axis=1).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)), np.float32)


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs without the text, with stats: array<float>, in the place of a column of that name."""
    docs = docs.drop("stats")
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(at))
            packed = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1, dtype=np.int32) * len(FEATURES)), pa.array(stats.ravel(), pa.float32()))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, packed], names=[*(c for i, c in enumerate(batch.schema.names) if i != at), "stats"])

    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema if f.name != text_column]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("stats", T.ArrayType(T.FloatType()))]))


@dataclass(frozen=True)
class Trees:
    """All trees, a complete binary one of DEPTH levels each: node k has children 2k+1 and 2k+2. A node without a split sends all left."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (len(value) - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = 1.0, least: int = 8) -> Trees:
    """Deterministic: no row or feature sampling; equal gains go to the first feature and bin."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(x) or y.min() == y.max():
        start = 0.0 if not len(x) else float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)), start)
    m = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(x), start)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(x), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-9)
            gain_of = lambda a, b: a * a / (b + ridge)
            for j in range(m):
                if not len(edges[j]):
                    continue
                cell = local * bins + binned[:, j]
                sums = [np.bincount(cell, weights=z, minlength=width * bins).reshape(width, bins) for z in (g, h, np.ones(len(x)))]
                left = [np.cumsum(s, axis=1)[:, : len(edges[j])] for s in sums]
                whole = [s.sum(axis=1, keepdims=True) for s in sums]
                gain = gain_of(left[0], left[1]) + gain_of(whole[0] - left[0], whole[1] - left[1]) - gain_of(whole[0], whole[1])
                gain[(left[2] < least) | (whole[2] - left[2] < least)] = -1
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                for k in np.flatnonzero(value > best + 1e-12):
                    best[k], feature[first + k], threshold[first + k] = value[k], j, edges[j][top[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + ridge)
        raw += value[leaf]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """labelled(doc_id, stats, label 0/1). At most about sample_rows rows reach the driver, chosen by a hash of the id."""
    rows = labelled.filter(F.col("label").isNotNull() & F.col("stats").isNotNull()).select("stats", F.col("label").cast("double").alias("label"), F.xxhash64("doc_id").alias("at"))
    n = rows.count()
    if n > sample_rows:
        rows = rows.filter(F.pmod("at", F.lit(1 << 32)) < F.lit(int(sample_rows / n * (1 << 32))))
    found = rows.orderBy("at", "label", "stats").limit(2 * sample_rows).toPandas()
    x = np.array(found["stats"].tolist(), np.float32).reshape(-1, len(FEATURES))
    return fit_trees(x, found["label"].to_numpy(float))


def score(rows: DataFrame, model: Trees) -> DataFrame:
    """rows(stats, ...) without stats, with score."""
    rows = rows.drop("score")
    at = rows.columns.index("stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score(x), pa.float64())], names=[*(c for i, c in enumerate(batch.schema.names) if i != at), "score"])

    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema if f.name != "stats"]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def learned(stats: DataFrame, labels: DataFrame, learn: Column | None = None, label_column: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fits on stats(doc_id, stats, ...) and labels(doc_id, <label>); learn picks the rows of stats whose labels may be used."""
    usable = stats if learn is None else stats.filter(learn)
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_column).alias("label")).filter("label IS NOT NULL").distinct()
    labelled = usable.select("doc_id", "stats").join(known, F.col("doc_id") == F.col("__id")).select("doc_id", "stats", "label")
    return fit(labelled, sample_rows)


def learned_from_texts(docs: DataFrame, labels: DataFrame, label_column: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fits on docs(doc_id, text) and labels(doc_id, <label>). The labels are sampled first, by a hash of the id: statistics are computed
    of the sampled documents only, and no text moves. At most 2 * sample_rows ids are broadcast."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_column).alias("label"), F.xxhash64("doc_id").alias("at")).filter("label IS NOT NULL").distinct()
    n = known.count()
    if n > sample_rows:
        known = known.filter(F.pmod("at", F.lit(1 << 32)) < F.lit(int(sample_rows / n * (1 << 32))))
    known = stored(known.orderBy("at", "__id", "label").limit(2 * sample_rows), "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(known.select("__id")), F.col("doc_id") == F.col("__id"), "left_semi")
    stats = stored(with_statistics(rows), "label-statistics")
    return fit(stats.join(known, F.col("doc_id") == F.col("__id")).select("doc_id", "stats", "label"), sample_rows)


def classify(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label_column: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs(doc_id, text, ...) without the text, with score. Texts are read once; their statistics are a table of their own."""
    rows, restore = shielded(docs, ["doc_id", "text"])
    marked = docs.select("*", (F.lit(True) if learn is None else learn).alias("learn")).toDF(*rows.columns, "learn")
    stats = stored(with_statistics(marked), "statistics")
    return restore(score(stats.drop("learn"), learned(stats, labels, F.col("learn"), label_column, sample_rows)))


def score_texts(docs: DataFrame, model: Trees, text_column: str = "text") -> DataFrame:
    """docs, text and all, with score."""
    rows, restore = shielded(docs, [text_column])
    at = rows.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(statistics(batch.column(at))), pa.float64())], names=[*batch.schema.names, "score"])

    return restore(rows.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType, True) for f in rows.schema), T.StructField("score", T.DoubleType())])))
