import math
from collections import Counter

import numpy as np
import pytest

from helpers import BLANK, awkward, crc, lower, prose
from tallgrass.llm import kneser_ney

END, START = "end", "start"


def tokens(text):
    return [*((w,) for w in BLANK.findall(lower(text))), END]


def discounts(counts):
    """Of the counts of a class: D1, D2, D3+ and how many there are of each."""
    n = Counter(min(c, 5) for c in counts)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d = [(k - (k + 1) * y * n[k + 1] / n[k]) if n[k] else k * y for k in (1, 2, 3)]
    d = [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]
    return lambda c: 0.0 if c == 0 else d[min(c, 3) - 1]


def brute(train, texts, order=3):
    """n_tokens, n_known, base score and score of each text under dictionaries of all training texts."""
    grams = lambda seen, k: zip(*([*([START] * (order - 1)), *seen][i : i + len(seen) + order - k] for i in range(k)), strict=False)
    ends = lambda seen, k: list(grams(seen, k))[order - k :]
    count, by_order = Counter(), {order: Counter()}
    for t in train:
        seen = tokens(t)
        count.update(seen)
        by_order[order].update(ends(seen, order))
    for k in range(order - 1, 0, -1):  # distinct tokens before each
        by_order[k] = Counter(g[1:] for g in by_order[k + 1])
    d = {k: discounts(c.values()) for k, c in by_order.items()}
    total, mass = Counter(), Counter()
    for k in range(2, order + 1):
        for g, c in by_order[k].items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[k](c)
    left, pairs = sum(d[1](c) for c in by_order[1].values()), sum(by_order[1].values())
    n, v_size = sum(count.values()), len(count)
    uniform = 1 / (v_size + 1)

    def p(g):
        c = by_order[len(g)][g]
        if len(g) == 1:
            return (max(c - d[1](c), 0) + left * uniform) / pairs if pairs else uniform
        low = p(g[1:])
        return (c - d[len(g)](c) + mass[g[:-1]] * low) / total[g[:-1]] if total[g[:-1]] else low

    out = []
    for t in texts:
        seen = tokens(t)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v_size + 1))) for w in seen)
        out.append((len(seen), sum(count[w] > 0 for w in seen), base, sum(math.log10(p(g)) for g in ends(seen, order))))
    return n, out


def same(found, expected):
    found, expected = sorted(found, key=repr), sorted(expected, key=repr)
    assert [x[:2] for x in found] == [x[:2] for x in expected]
    assert [y for x in found for y in x[2:]] == pytest.approx([y for x in expected for y in x[2:]], rel=1e-9)


@pytest.mark.parametrize("shards", [{}, {"order": 2, "shard_tokens": 300, "vocabulary_shard": 16}, {"order": 3, "shard_tokens": 300, "vocabulary_shard": 16}, {"order": 4, "shard_tokens": 900}])
def test_against_dictionaries(spark, shards):
    texts = [t for _, t, _, _ in awkward()] + [prose(i, 50 + i, 90) for i in range(60)] + ["A b a B a b", "unseen words only"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = [t for i, t in rows if crc(i) % 5 != 1]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in train], "text string"), **shards)
    n, expected = brute(train, texts, shards.get("order", 3))
    assert model.tokens == n
    assert not shards or model.shards > 3 and (model.bits > 1 or "vocabulary_shard" not in shards)
    scored = kneser_ney.score(docs, model).collect()
    same([(r.n_tokens, r.n_known, r.base_score, r.score) for r in scored], expected)
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in scored)
    kneser_ney.forget(spark, model)


def test_each_context_sums_to_one(spark):
    """Over the vocabulary and what stands for all unknown tokens."""
    train = [prose(i, 40, 30) for i in range(20)]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in train], "text string"))
    words = sorted({w for t in train for w in t.split()})
    for v in words[:3]:
        rows = [(i, f"{v} {w}") for i, w in enumerate([*words, "unknown"])]
        scored = kneser_ney.score(spark.createDataFrame([*rows, (-1, v)], "doc_id long, text string"), model).collect()
        _, expected = brute(train, [f"{v} {w}" for w in [*words, "unknown"]] + [v])
        same([(r.n_tokens, r.n_known, r.base_score, r.score) for r in scored], expected)


def test_numbers_and_counts_of_more_than_32_bits():
    grams = np.array([[0, 1, 1 << 40, (1 << 40) + 1], [5, 1 << 35, 7, 7]])
    both = np.concatenate((grams, [[1 << 36, 3, 9, 1 << 50]]))
    assert (kneser_ney._unpacked(kneser_ney._packed(both), 3) == both).all()
    assert len(set(kneser_ney._hash(grams).tolist())) == 4
    merged, count = kneser_ney._merged(np.concatenate((grams, grams), axis=1), np.concatenate((both[2], both[2])))
    assert (merged == grams).all() and (count == 2 * both[2]).all()
    assert kneser_ney._small(count).dtype == np.uint64 and (kneser_ney._small(count) == count).all()


def test_orders_below_two(nothing):
    with pytest.raises(ValueError, match="2 or more"):
        kneser_ney.train(nothing, order=1)


def test_without_training_texts(spark, docs, nothing):
    model = kneser_ney.train(nothing)
    scored = kneser_ney.score(docs, model).collect()
    assert len(scored) == len(awkward()) and model.tokens == 0
    assert all(r.n_known == 0 and r.score == 0 for r in scored)


def test_awkward_with_clashing_columns(docs):
    model = kneser_ney.train(docs)
    scored = kneser_ney.score(docs, model)
    assert scored.columns.count("score") == 1 and "size" in scored.columns
    _, expected = brute([t for _, t, _, _ in awkward()], [t for _, t, _, _ in awkward()])
    same([(r.n_tokens, r.n_known, r.base_score, r.score) for r in scored.collect()], expected)


def test_empty(docs, nothing):
    assert kneser_ney.score(nothing, kneser_ney.train(docs)).count() == 0


@pytest.mark.parametrize("most", [3, 1 << 20, 1 << 25, 1 << 40, (1 << 62)])
def test_distinct_grams_however_wide_their_numbers(most):
    """Numbers that share a key, and those that need one each."""
    r = np.random.default_rng(most % 97)
    grams = r.integers(0, min(most, 6), (3, 500)) * max(1, most // 6)
    found, count = kneser_ney._distinct(grams)
    want = Counter(map(tuple, grams.T.tolist()))
    assert list(map(tuple, found.T.tolist())) == sorted(want) and count.tolist() == [want[g] for g in sorted(want)]
    again, total = kneser_ney._merged(grams, np.arange(500))
    assert (again == found).all() and total.sum() == 499 * 250
    assert kneser_ney._distinct(grams[:, :0])[0].shape == (3, 0)


def test_hashes_that_share_their_leading_bits(tmp_path):
    """Places among equal leading halves, at the ends of the arrays too; what differs in the last 16 bits only counts as equal."""
    r = np.random.default_rng(3)
    h = np.unique(np.concatenate((r.integers(0, 5, 60, np.uint64) << np.uint64(32) | r.integers(0, 40, 60, np.uint64) << np.uint64(16), np.array([0, (1 << 64) - (1 << 16)], np.uint64))))
    kneser_ney._save_keys(str(tmp_path), "k-0", h)
    kneser_ney._save(str(tmp_path), "v-0", np.arange(1, len(h) + 1))
    asked = np.unique(np.concatenate((h, h + np.uint64(1 << 16), r.integers(0, 1 << 63, 50, np.uint64) >> np.uint64(16) << np.uint64(16))))
    asked = r.permutation(asked)
    found = kneser_ney._Arrays(str(tmp_path)).look_up("k", "v", asked, np.zeros(len(asked), np.int64), 1)[0]
    assert found.tolist() == [int(np.searchsorted(h, x)) + 1 if x in h else 0 for x in asked]
    assert kneser_ney._Arrays(str(tmp_path)).look_up("none", "v", asked, np.zeros(len(asked), np.int64), 1).sum() == 0
