import random

import numpy as np
import pytest

from helpers import ALNUM, awkward, lower, prose
from tallgrass.llm import license_scan as ls

SCHEMA = "doc_id long, text string"


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(20))
def test_alignment_with_a_wide_band(seed):
    r = random.Random(seed)
    a, b = ([r.randrange(6) for _ in range(r.randint(1, 25))] for _ in range(2))
    matched, first, last = ls.align(np.array(a, np.uint64), np.array(b, np.uint64), band=100)
    assert matched == common(a, b)
    assert common(a, b[first:last]) == matched
    if matched:
        assert common(a, b[first + 1 :]) < matched
        assert common(a, b[first : last - 1]) < matched


def test_winnowing_keeps_one_of_every_span():
    h = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    kept = set(ls.winnow(h, 4).tolist())
    for i in range(len(h) - 3):
        assert any(p in kept and h[p] == h[i : i + 4].min() for p in range(i, i + 4))


def matches(spark, texts, **more):
    found = ls.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA), **more).collect()
    assert len(found) == len(texts)
    return {r.doc_id: r.matches for r in found}


def test_every_notice_in_full(spark):
    texts = [f"{prose(i, 200)}\n{text.upper() if i % 2 else text}\n{prose(i + 50, 100)}" for i, (_, text, _) in enumerate(ls.NOTICES)]
    for i, found in matches(spark, texts).items():
        name, text, _ = ls.NOTICES[i]
        best = found[0]
        assert (best.name, best.coverage) == (name, 1) and len([m for m in found if m.name == name]) == 1
        assert ALNUM.findall(lower(best.span)) == ALNUM.findall(lower(text))
        words = ALNUM.findall(lower(texts[i]))
        assert words[best.first_word : best.last_word + 1] == ALNUM.findall(lower(text))


def test_recall_against_whole_alignment(spark):
    """A fifth of the words changed: whatever still covers enough of its template, by the longest common subsequence, is found."""
    texts, expected = [], []
    for k, (name, text, must) in enumerate(ls.NOTICES):
        own = ALNUM.findall(lower(text))
        for trial in range(30):
            r = random.Random(f"{k} {trial}")
            changed = [f"other{r.randrange(99)}" if r.random() < 0.2 else w for w in own]
            texts.append(f"{prose(k, 40)} {' '.join(changed)} {prose(trial, 30)}")
            expected.append((k, name, common(own, changed) >= ls.MIN_COVERAGE * len(own) and set(ALNUM.findall(must)) <= set(changed)))
    wanted, caught = [0] * len(ls.NOTICES), [0] * len(ls.NOTICES)
    for i, found in matches(spark, texts).items():
        k, name, there = expected[i]
        wanted[k] += there
        caught[k] += there and any(m.name == name for m in found)
    assert sum(wanted) > 500 and all(c >= 0.9 * w for c, w in zip(caught, wanted, strict=True)), list(zip(caught, wanted, strict=True))


def test_the_best_of_overlapping_places(spark):
    text = next(t for n, t, _ in ls.NOTICES if n == "ISC")
    before = " ".join(text.split()[:26])
    found = matches(spark, [f"{before} {text}"])[0]
    assert (found[0].name, found[0].coverage, found[0].first_word) == ("ISC", 1, len(ALNUM.findall(before)))


def test_versions_are_told_apart(spark):
    line = "This work is licensed under the GNU General Public License, version {}."
    bsd2 = next(t for n, t, _ in ls.NOTICES if n == "BSD-2-Clause")
    found = matches(spark, [line.format(2), line.format(3), line.format(9), bsd2, "Licensed under CC BY-NC 4.0."])
    names = {i: {m.name for m in ms} for i, ms in found.items()}
    assert names[0] == {"GPL-2.0-notice"} and names[1] == {"GPL-3.0-notice"} and names[2] == set()
    assert "BSD-2-Clause" in names[3] and "BSD-3-Clause" not in names[3] and found[4][0].name == "CC-BY-NC-4.0"


def test_edited_notices(spark):
    text = next(t for n, t, _ in ls.NOTICES if n == "GPL-3.0").split()
    changed = " ".join("word" if i in (9, 40) else w for i, w in enumerate(text) if i != 20)
    found = matches(spark, [f"{prose(1, 80)} {changed} {prose(2, 80)}", " ".join(text[: len(text) // 2]), prose(3, 500)])
    assert found[0][0].name == "GPL-3.0" and 0.9 < found[0][0].coverage < 1
    assert found[0][0].matched == common(ALNUM.findall(lower(" ".join(text))), ALNUM.findall(lower(changed)))
    assert not [m for m in found[1] if m.name == "GPL-3.0"] and found[2] == []


@pytest.mark.parametrize("put_in", [10, 30, 60, 110])
def test_words_put_into_long_notices(spark, put_in):
    """Whole notices with words put in at one or two places, by the longest common subsequence all of their words."""
    own = [(n, t.split()) for n, t, _ in ls.NOTICES if len(ALNUM.findall(lower(t))) >= ls.LONG_WORDS]
    texts = []
    for k, (_, words) in enumerate(own):
        more, half = prose(k, put_in).split(), len(words) // 2
        texts.append(" ".join(words[:half] + more + words[half:]))
        texts.append(" ".join(words[: half // 2] + more[: put_in // 2] + words[half // 2 : half + half // 2] + more[put_in // 2 :] + words[half + half // 2 :]))
    found = matches(spark, [f"{prose(90, 50)} {t} {prose(91, 50)}" for t in texts])
    caught = [any(m.name == own[i // 2][0] and m.coverage > 0.95 for m in ms) for i, ms in found.items()]
    assert sum(caught) >= 0.9 * len(caught)


def test_negations(spark):
    says = ["Licensed under the MIT License.", "We do not forget to say it: released under the MIT License.", "It is licensed under CC BY 3.0.", "SPDX-License-Identifier: GPL-3.0", "License: MIT", "No fees. Licensed under the MIT License."]
    denies = ["Not licensed under the MIT License.", "This is not released under the MIT License.", "never licensed under CC BY 4.0", "Licensed not under the MIT License."]
    found = matches(spark, says + denies)
    assert [bool(found[i]) for i in range(len(says))] == [True] * 6
    assert not any(found[len(says) + i] for i in range(len(denies)))


def test_heads_of_long_texts(spark):
    found = matches(spark, ["Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc. <http://fsf.org/>"])
    assert found[0][0].name == "Apache-2.0-text" and found[1][0].name == "LGPL-3.0-text"


def test_short_templates_and_repeats(spark):
    templates = spark.createDataFrame([("short", "All rights reserved"), ("none", ""), ("null", None)], "name string, text string")
    found = matches(spark, ["x all rights reserved y. ALL RIGHTS RESERVED!", "all rights", ""], templates=templates)
    assert [(m.name, m.first_word, m.last_word) for m in found[0]] == [("short", 1, 3), ("short", 5, 7)]
    assert found[1] == [] and found[2] == []


def test_templates_in_parts(spark):
    texts = [t for _, t, _ in ls.NOTICES] + [prose(1, 50)]
    assert ls.indexes(ls.notices(spark), part_words=200)[1] > 5
    plain = lambda found: {i: [tuple(m) for m in ms] for i, ms in found.items()}
    assert plain(matches(spark, texts, part_words=200)) == plain(matches(spark, texts))


def test_awkward(docs):
    found = ls.scan(docs).collect()
    assert len(found) == len(awkward()) and all(r.matches == [] for r in found)
    assert found[0].size == 1 and found[0].shard == "x"


def test_empty(spark, nothing):
    assert ls.scan(nothing).count() == 0
    none = spark.createDataFrame([], "name string, text string")
    assert matches(spark, [ls.NOTICES[0][1]], templates=none) == {0: []}
