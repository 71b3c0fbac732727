import itertools
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import BLANK, awkward, prose
from tallgrass.llm import robust_outliers as ro


def plain(seed, words=80):
    """Prose without repeated windows: it passes the base rules."""
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(words))


def base(text):
    w = BLANK.findall(text or "")
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    out = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))
    return (*out, out[0] < 10 or 100 * out[4] > 20 * out[0])


BASE_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM dw, unnest(generate_series(1, len(w) - 4)) AS u(i)),
again AS (SELECT r, i FROM places QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM again, unnest(generate_series(i, i + 4)) AS u(p) GROUP BY r),
counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(list_filter(str_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(str_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words FROM dw LEFT JOIN covered USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
"""
BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_statistics(docs):
    found = ro.base_statistics(docs).select(*BASE).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(((i, *base(t)) for i, t, _, _ in awkward()), key=repr)


def test_base_statistics_in_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = ro.base_statistics(spark.read.parquet(f"{folder}/documents.parquet")).select(*BASE).collect()
    assert sorted(map(tuple, found)) == sorted(db.execute(BASE_SQL).fetchall())


def test_repeats_and_lines(spark):
    texts = ["a b c d e f a b c d e", "x\nx\n \ny\nx", "a a a a a a a a", "\n\n", "p q r s t " * 3 + "u", "a b c d"]
    rows = spark.createDataFrame([(i, t, "l", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    found = {r.doc_id: tuple(r)[3:9] for r in ro.base_statistics(rows).collect()}
    assert found == {i: base(t) for i, t in enumerate(texts)}


def test_verdicts(spark, docs):
    found = ro.judge(docs).collect()
    assert len(found) == len(awkward())
    failed = {(i, base(t)[0]): base(t)[-1] for i, t, _, _ in awkward()}
    assert all(r.base_failed == failed[r.doc_id, r.n_words] for r in found)
    assert all(not r.kept and r.distance2 is None and r.weight is None for r in found if r.base_failed)
    assert all(0 < r.weight < 1 and r.kept == (r.distance2 <= ro.CUT) for r in found if not r.base_failed)


def test_outliers_go_and_common_rows_stay(spark):
    good = [(i, plain(i), "en", "s") for i in range(400)]
    bad = [(1000 + i, " ".join(f"{x}$$$###" for x in plain(i, 40).split()), "en", "s") for i in range(40)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    once, again = ({r.doc_id: (r.kept, r.distance2) for r in ro.judge(x).collect()} for x in (table, table.repartition(7, "text")))
    assert all(once[i][0] for i, *_ in good) and not any(once[i][0] for i, *_ in bad)
    assert {i: k for i, (k, _) in once.items()} == {i: k for i, (k, _) in again.items()}
    assert all(math.isclose(once[i][1], again[i][1], rel_tol=1e-6) for i in once)


def test_every_row_is_judged_by_its_own_group(spark):
    found = ro.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("NOT base_failed")
    least, mean, kept = found.agg(F.min("weight"), F.avg("weight"), F.avg(F.col("kept").cast("double"))).first()
    assert least > 0 and mean > 0.6 and kept > 0.85


@pytest.mark.parametrize(("own", "weight"), [(15, 0.5), (30, 1.0), (45, 1.0)])
def test_small_groups_lean_on_a_larger_one(spark, own, weight):
    rows = [(i, plain(i, 30), "en", "a" if i < own else "b") for i in range(own + 60)]
    found = ro.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).groupBy("weight").count().collect()
    assert Counter({r.weight: r["count"] for r in found}) == Counter([weight] * own) + Counter([1.0] * 60)


def exact_mcd(x, cover=0.75):
    """Mean and covariance with ridge: of all subsets of the size asked for the one with the least determinant, made consistent and reweighted."""
    ridge = np.diag(np.square(ro.FLOOR))
    subsets = (list(c) for c in itertools.combinations(range(len(x)), math.ceil(cover * len(x))))
    best = min(subsets, key=lambda c: np.linalg.slogdet(np.cov(x[c].T, bias=True) + ridge)[1])
    mean, cov = x[best].mean(axis=0), (np.cov(x[best].T, bias=True) + ridge) * ro.consistency(cover)
    near = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean) <= ro.RIM
    return x[near].mean(axis=0), np.cov(x[near].T, bias=True) * ro.consistency(ro.RIM_COVER) + ridge


def test_verdicts_are_those_of_a_plain_mcd(spark):
    """Two small groups and their parents: the least determinant of all subsets, shrunk, gives the same verdicts."""
    rows = [(i, plain(i, 25 + i % 5), "en", "a") for i in range(10)] + [(20 + i, plain(20 + i, 30), "en", "b") for i in range(4)]
    rows += [(40, " ".join(f"{w}$$##" for w in plain(40, 30).split()), "en", "a"), (41, "\n".join([plain(41, 12)] + ["same line again here"] * 2 + [plain(42, 40)]), "en", "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = {r.doc_id: r for r in ro.vectors(ro.base_statistics(table)).collect() if not r.base_failed}
    assert len(stats) == len(rows)
    x = {i: np.array([r.x0, r.x1, r.x2, r.x3]) for i, r in stats.items()}
    every = exact_mcd(np.array(list(x.values())))
    want = {}
    for source in "ab":
        own = [i for i, _, _, s in rows if s == source]
        n, (mean, cov) = len(own), exact_mcd(np.array([x[i] for i in own]))
        lang = len(rows) / ro.ENOUGH
        up = [lang * a + (1 - lang) * b for a, b in zip(every, every)]
        w = n / ro.ENOUGH
        mean, cov = w * mean + (1 - w) * up[0], w * cov + (1 - w) * up[1]
        want |= {i: float((x[i] - mean) @ np.linalg.solve(cov, x[i] - mean)) for i in own}
    found = {r.doc_id: r for r in ro.judge(table).collect()}
    assert {i: r.kept for i, r in found.items()} == {i: d <= ro.CUT for i, d in want.items()}
    assert not found[40].kept and all(found[i].kept for i, *_ in rows if i < 40)


def plain_mcd(x, h, starts=300, seed=5):
    """Least log determinant (with the ridge) over concentration steps from many random starts, with exactly h rows."""
    r, ridge, best = np.random.default_rng(seed), np.diag(np.square(ro.FLOOR)), np.inf
    for _ in range(starts):
        use = r.choice(len(x), 6, replace=False)
        last = np.inf
        while True:
            cov = np.cov(x[use].T, bias=True) + ridge
            det = np.linalg.slogdet(cov)[1]
            if len(use) == h and det > last - 1e-9:
                break
            last = det if len(use) == h else np.inf
            y = x - x[use].mean(axis=0)
            use = np.argsort((y * np.linalg.solve(cov, y.T).T).sum(axis=1), kind="stable")[:h]
        best = min(best, last)
    return best


@pytest.mark.parametrize("shape", ["cloud", "cluster", "line"])
def test_determinant_is_the_least_found_by_many_random_starts(spark, shape):
    r = np.random.default_rng(11)
    x = r.normal(size=(400, 4)) @ r.normal(size=(4, 4)) * 0.3
    if shape == "cluster":  # a fifth of the rows, close together
        x[:80] = 3 + 0.05 * r.normal(size=(80, 4))
    if shape == "line":
        x[:70] = np.outer(r.normal(size=70) * 3, [1, -1, 1, 1])
    rows = spark.createDataFrame([("l", "s", *map(float, v)) for v in x], "lang string, source string, x0 double, x1 double, x2 double, x3 double")
    leveled = ro._leveled(rows)
    found = ro.raw_estimate(leveled, 3, ro._starts(leveled, 3)[1]).filter("level = 0").agg(F.min("log_det")).first()[0]
    assert found <= plain_mcd(x, math.ceil(0.75 * len(x))) + 0.02


def test_distance_is_that_of_the_matrix(spark):
    r = np.random.default_rng(3)
    a = r.normal(size=(4, 4))
    cov, mean, x = a @ a.T, r.normal(size=4), r.normal(size=4)
    full = cov + np.diag(np.square(ro.FLOOR))
    values = {f"m{i}": float(mean[i]) for i in range(4)} | {f"c{i}{j}": float(cov[i, j]) for i in range(4) for j in range(i + 1)}
    one = ro._factor(spark.createDataFrame([tuple(values.values())], list(values))).withColumns({f"x{i}": F.lit(float(x[i])) for i in range(4)})
    assert math.isclose(ro._with_distance(one).first().d2, float((x - mean) @ np.linalg.solve(full, x - mean)), rel_tol=1e-9)


@pytest.mark.parametrize("cover", [0.75, 0.975])
def test_consistency(cover):
    r = np.random.default_rng(4).normal(size=(200_000, 4))
    d = (r * r).sum(axis=1)
    assert math.isclose(ro.consistency(cover) * r[d <= np.quantile(d, cover)].var(), 1, rel_tol=0.01)


def test_empty(nothing):
    assert ro.judge(nothing).count() == 0
