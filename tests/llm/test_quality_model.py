import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from helpers import BLANK, awkward, crc, lower, prose
from tallgrass.llm import quality_model as qm
from tallgrass.llm.queries import op9_quality_model

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    w = BLANK.findall(lower(text))
    lines = [x for x in text.split("\n") if x]
    size = max(len(text.encode()), 1)
    runs = lambda k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    again = lambda x: 1 - len(set(x)) / len(x) if x else 0.0
    return {
        "log_words": math.log1p(len(w)), "word_length": sum(len(x.encode()) for x in w) / max(len(w), 1), "long_words": sum(len(x.encode()) > 14 for x in w) / max(len(w), 1),
        "distinct_words": len(set(w)) / max(len(w), 1), "top_word": max(Counter(w).values(), default=0) / max(len(w), 1), "repeat_pairs": again(runs(2)), "repeat_runs": again(runs(5)),
        "log_lines": math.log1p(len(lines)), "line_words": len(w) / max(len(lines), 1), "repeat_lines": (len(lines) - len(set(lines))) / max(len(lines), 1),
        "upper": sum("A" <= c <= "Z" for c in text) / size, "digit": sum("0" <= c <= "9" for c in text) / size, "symbol": sum(c in "#*$%&|<>" for c in text) / size,
        "words_with_symbol": sum(any(c in "#*$%&|<>" for c in x) for x in w) / max(len(w), 1),
    }


def test_statistics():
    texts = [t for _, t, _, _ in awkward()] + ["a\nb\na\n\nb c", "One TWO three! four, 5 (six)"]
    found = qm.statistics(pa.array(texts, pa.string()))
    for row, text in zip(found, texts, strict=True):
        for name, value in plain(text).items():
            assert row[qm.FEATURES.index(name)] == pytest.approx(value, rel=1e-5, abs=1e-6), (name, text[:50] if text else text)


def walk(model, x):
    total = model.start
    for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        total += value[node - len(feature)]
    return total


def test_flattened_trees_are_walked_right():
    r = np.random.default_rng(5)
    x = r.normal(size=(500, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    model = qm.fit_trees(x, y, trees=15, depth=3)
    assert model.raw(x) == pytest.approx([walk(model, row) for row in x])
    fresh = r.normal(size=(500, 4)).astype(np.float32)
    assert (((fresh[:, 0] > 0.3) ^ (fresh[:, 1] < -0.2)) == (model.score(fresh) > 0.5)).mean() > 0.93


def test_best_first_split():
    """The first tree's root against every split tried one by one."""
    r = np.random.default_rng(6)
    x = r.integers(0, 12, size=(200, 3)).astype(np.float32)
    y = (x[:, 2] + r.normal(size=200) > 6).astype(float)
    model = qm.fit_trees(x, y, trees=1, depth=1, least=8)
    p = y.mean()
    g, h = y - p, np.full(200, p * (1 - p))
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    gains = {(j, t): part(x[:, j] <= t) + part(x[:, j] > t) for j in range(3) for t in range(12) if 8 <= (x[:, j] <= t).sum() <= 192}
    assert gains[model.feature[0, 0], int(model.threshold[0, 0])] == pytest.approx(max(gains.values()))


def test_awkward(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    found = qm.classify(docs, labels)
    rows = found.collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
    assert found.columns.count("score") == 1 and "size" in found.columns


def test_without_labels(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in qm.classify(docs, none).collect()} == {0.5}
    assert qm.classify(nothing, none).count() == 0


def test_scores_with_and_without_the_text_agree(spark, docs):
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(12)], "doc_id long, quality int")
    model = qm.learned(qm.with_statistics(docs), labels)
    one = sorted(((r.doc_id, r.score) for r in qm.score_texts(docs, model).collect()), key=repr)
    assert one == sorted(((r.doc_id, r.score) for r in qm.classify(docs, labels).collect()), key=repr)


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = op9_quality_model(spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in found)
    judged = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and labels.get(r.doc_id) is not None]
    assert len(judged) > 50 and sum(a == b for a, b in judged) / len(judged) >= 0.9


def test_learning_ignores_held_out_labels(spark):
    docs = spark.createDataFrame([(i, prose(i, 30 + i % 40)) for i in range(120)], "doc_id long, text string")
    labels = [(i, int(i % 40 > 20)) for i in range(120)]
    held = lambda i: crc(i) % 5 == 0
    flipped = [(i, 1 - q if held(i) else q) for i, q in labels]
    from pyspark.sql import functions as F

    rows = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    score = lambda x: {r.doc_id: r.score for r in qm.classify(rows, spark.createDataFrame(x, "doc_id long, quality int"), learn=~F.col("held_out")).collect()}
    assert score(labels) == score(flipped)
