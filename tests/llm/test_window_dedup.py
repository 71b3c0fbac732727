import random

import numpy as np
import pytest

from helpers import BLANK, awkward, prose, sha
from tallgrass.llm import window_dedup as wd


def brute(rows, k):
    """(doc_id, words, removed, sha) of every row."""
    key = lambda i: (i is None, i)
    words = [BLANK.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for a in range(len(w) - k + 1):
            s = tuple(w[a : a + k])
            least[s] = min(least.get(s, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {j for a in range(len(w) - k + 1) if least[tuple(w[a : a + k])] < key(i) for j in range(a, a + k)}
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in wd.dedup(docs, with_text=False, **more).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("ways", [{}, {"hot_strings": 0, "bucket_chars": 200}, {"hot_strings": 3, "bucket_chars": 500}, {"bucket_chars": 100}])
def test_random_texts(spark, ways):
    r = random.Random(7)
    passages = [prose(i, 25, 8) for i in range(6)]
    rows = [(i % 50, "\n".join(r.choice(passages) if r.random() < 0.5 else prose(100 + i, r.randint(0, 30), 8) for _ in range(3))) for i in range(60)]
    assert run(spark, rows, k=6, m=2, **ways) == brute(rows, 6)


@pytest.mark.parametrize("ways", [{}, {"hot_strings": 0, "bucket_chars": 200}])
def test_texts_of_one_id_are_judged_apart(spark, ways):
    shared = prose(1, 13)
    rows = [(0, f"{shared} x"), (1, f"{shared} x"), (1, f"{shared} y z q"), (1, f"v {shared} x"), (1, f"{shared} x")]
    rows += [(None, f"{shared} {prose(i, 20)}" if i % 2 else prose(i, 30)) for i in range(300)]
    assert run(spark, rows, **ways) == brute(rows, 13)
    assert (1, 16, 13, sha("y z q")) in run(spark, rows, **ways)


def test_repeated_phrases_count_by_their_windows(spark, monkeypatch):
    """A text that repeats a short phrase is one string, but has as many windows as words."""
    hot, single = [], wd._single
    monkeypatch.setattr(wd, "_single", lambda k, m, buckets, which: hot.extend(which) or single(k, m, buckets, which))
    rows = [(i, "buy it now at once " * 200) for i in (3, 1, 2)] + [(i, prose(i, 30)) for i in range(4, 8)]
    assert run(spark, rows, hot_windows=2000, bucket_chars=2000) == brute(rows, 13)
    assert len(hot) == 1
    assert run(spark, rows, bucket_chars=2000) == brute(rows, 13) and len(hot) == 1


def test_long_strings_are_cut():
    first, count, minimiser = wd._cut(*(np.array(x) for x in ([0, 50, 90], [7, 25, 10], [1, 2, 3])), 10)
    assert list(zip(first.tolist(), count.tolist(), minimiser.tolist(), strict=True)) == [(0, 7, 1), (50, 10, 2), (60, 10, 2), (70, 5, 2), (90, 10, 3)]


def test_awkward(spark, docs):
    rows = [(i, t) for i, t, _, _ in awkward()]
    assert run(spark, rows) == brute(rows, 13)
    kept = wd.dedup(docs).filter("doc_id = 30").first()
    assert kept.kept_text == "" and kept.n_removed == 60 and kept.source == "s2"


def test_empty(spark, nothing):
    assert wd.dedup(nothing).count() == 0


def test_many_equal_rows(spark):
    """Rows that repeat an id and a text find the same: work grows with the rows, not with their square."""
    text = prose(1, 60)
    rows = [(1, text)] + [(2, f"x {text}")] * 10_000
    found = wd.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, found)) == [(1, 60, 0, 1), (2, 61, 60, 10_000)]
