import random

import pytest

from helpers import ALNUM, awkward, lower, prose
from tallgrass.llm import decontaminate as dc


def brute(texts, items, window):
    """texts: list; items: (id, text). For each text: words, hit words, items found."""
    spans = []
    for name, text in items:
        w = ALNUM.findall(lower(text))
        k = min(len(w), window)
        spans += [(tuple(w[i : i + k]), name) for i in range(len(w) - k + 1)] if k else []
    out = []
    for text in texts:
        w = ALNUM.findall(lower(text))
        hit, names = set(), set()
        for s, name in spans:
            for i in range(len(w) - len(s) + 1):
                if tuple(w[i : i + len(s)]) == s:
                    hit |= set(range(i, i + len(s)))
                    names.add(name)
        out.append((len(w), len(hit), sorted(map(str, names))))
    return out


@pytest.mark.parametrize("window", [2, 4])
def test_random_texts(spark, window):
    r = random.Random(window)
    word = lambda: r.choice("abcd")
    items = [(i % 20, " ".join(word() for _ in range(r.randint(0, 7)))) for i in range(25)]
    texts = [" ".join(word() if r.random() < 0.8 else "zz" for _ in range(r.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for part_words in (10_000, 20):  # one part, and several
        found = dc.scan(docs, spark.createDataFrame(items, "item_id long, text string"), window=window, part_words=part_words)
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert [(x.n_words, x.n_hit, sorted(x["items"])) for x in found.orderBy("doc_id").collect()] == brute(texts, items, window)


def test_small_gatherings_and_parts(spark, monkeypatch):
    monkeypatch.setattr(dc, "GATHER_BYTES", 50)
    items = [(f"x\0{i}", prose(i, 14, 40)) for i in range(8)] + [("x", prose(20, 3)), ("x", prose(21, 12))]
    texts = [f"{prose(100 + i, 5)} {prose(i % 8, 14, 40)} {prose(20 + i % 2, 12)}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    rows = spark.createDataFrame(items, "item_id string, text string")
    assert dc.automata(rows, 10, 30)[1] >= 5
    found = dc.scan(docs, rows, part_words=30).orderBy("doc_id").collect()
    assert [(x.n_words, x.n_hit, sorted(x["items"])) for x in found] == [(a, b, sorted(set(c))) for a, b, c in brute(texts, items, 10)]


def test_awkward(spark, docs):
    items = [(1, prose(5)), (2, None), (3, ""), (4, "日本"), (5, "W1"), (None, prose(7)[:80])]
    found = dc.scan(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = brute([t for _, t, _, _ in awkward()], [("" if i is None else i, t) for i, t in items], 10)
    assert sorted((x.n_words, x.n_hit, ",".join(x["items"])) for x in found) == sorted((a, b, ",".join(c)) for a, b, c in expected)


def test_longest_and_clean(spark):
    passage = prose(1, 14)
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(1, f"Before it. {passage}, and after."), (2, passage), (3, "nothing here"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.longest for r in dc.scan(docs, items).collect()} == {1: 14, 2: 14, 3: 0, 4: 0}
    assert {r.doc_id: r.text for r in dc.clean(docs, items, coverage_limit=0.9).collect()} == {1: "Before it. , and after.", 3: "nothing here", 4: None}


def test_empty(spark, docs, nothing):
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.scan(nothing, items).count() == 0
    assert dc.scan(docs, items).filter("n_hit > 0").count() == 0 and dc.scan(docs, items).count() == len(awkward())
