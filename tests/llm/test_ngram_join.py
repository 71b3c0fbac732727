import random

import pytest

from helpers import BLANK, awkward, lower, prose
from tallgrass.llm import ngram_join


def brute(rows, n=5, percent=80):
    sets = []
    for _, t in rows:
        w = BLANK.findall(lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def run(spark, rows, **more):
    return sorted((tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()), key=repr)


def edited(text, edits, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(edits):
        i = r.randrange(len(w))
        how = r.random()
        w[i : i + 1] = [] if how < 0.3 else [f"n{r.randrange(40)}"] if how < 0.7 else [w[i], f"n{r.randrange(40)}"]
    return " ".join(w)


@pytest.mark.parametrize("seed", range(3))
def test_families(spark, seed):
    r = random.Random(seed)
    passage = prose(1000, 30)
    rows = []
    for family in range(6):
        start = prose(family, r.randint(5, 150), 60)
        rows += [(len(rows) + k, edited(start, r.randint(0, 9), f"{seed} {family} {k}")) for k in range(r.randint(1, 25))]
    rows += [(500 + i, f"{prose(2000 + i, r.randint(3, 60))} {passage} {prose(3000 + i, r.randint(3, 60))}") for i in range(30)]
    rows += [(600 + i, " ".join(passage.split()[i % 3 : 28 + i % 2])) for i in range(10)]
    assert run(spark, rows, block_shingles=50) == brute(rows)


def test_overlaps_add_up_by_blocks(spark):
    r = random.Random(5)
    sets = [{r.getrandbits(63) - (1 << 62) for _ in range(3)} | {x - 50 for x in r.sample(range(100), 40)} for _ in range(30)]
    blocks = range(ngram_join.PRODUCT_BLOCKS)
    part = lambda s, b: sorted(x for x in s if x % len(blocks) == b)
    rows = [(i, len(s), *(len(part(s, b)) for b in blocks), *(part(s, b) for b in blocks)) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, ", ".join(["node long, size long", *(f"n{b} long" for b in blocks), *(f"shingles{b} array<long>" for b in blocks)]))
    pairs = [(i, j) for i in range(30) for j in range(i)]
    found = ngram_join._counted(spark.createDataFrame(pairs, "a long, b long"), table, 25)
    both = {(i, j): len(sets[i] & sets[j]) for i, j in pairs}
    assert {(x.a, x.b): x.overlap for x in found.collect()} == {p: n for p, n in both.items() if 100 * n >= 25 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


def test_a_set_has_one_row(spark):
    # copies whose ids share a bit of the bitmap, and rows repeated
    at = spark.range(60_000).selectExpr("id", f"pmod(xxhash64(id), {1 << 23}) AS at")
    ids = at.groupBy("at").agg({"id": "collect_list"}).filter("size(`collect_list(id)`) > 1").first()[1]
    text = prose(5, 200)
    near = text.replace(text.split()[100], "other", 1)
    rows = [(i, text) for i in ids] + [(70_000, near)] * 3
    docs = spark.createDataFrame(rows, "doc long, text string").coalesce(1)
    alive = ngram_join.survey(docs)[1]
    sets = ngram_join.one_row_each(ngram_join.sets_of(docs, alive, 5))
    assert sorted(r.node for r in sets.collect()) == sorted(r.one for r in alive.collect())
    assert ngram_join.links(docs, alive).count() == 1
    assert run(spark, rows) == brute(rows)


def test_further_rows_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    text = prose(6, 200)
    rows = [(1, text)] * 3 + [(2, text + " end")] * 3
    assert run(spark, rows) == brute(rows)


def test_many_blocks(spark, monkeypatch):
    listed = [10**5, 10**7, 5 * 10**8, 10**10]
    assert [ngram_join.blocks_for(n) for n in listed] == [2, 101, 513, 10_001]
    monkeypatch.setattr(ngram_join, "MANY_BLOCKS", 4)
    rows = [(i, edited(prose(i % 7, 80, 60), i % 5, f"many {i}")) for i in range(60)]
    assert run(spark, rows, block_shingles=5) == brute(rows)


def test_components_of_a_long_path(spark):
    edges = [(i * 7919 % 3000, (i + 1) * 7919 % 3000) for i in range(2999)]
    assert {r.root for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()} == {0}


def test_chain(spark):
    words = prose(1, 400, 10**6).split()
    rows = [(50 - i, " ".join(words[i * 4 : i * 4 + 120])) for i in range(50)]
    found = run(spark, rows)
    assert found == brute(rows) and {c for _, _, c in found} == {1}


def test_short_texts(spark):
    rows = [(1, "a b"), (2, "A  b"), (3, "a b c"), (4, "b a"), (5, ""), (6, None), (7, " "), (8, "a b c d e"), (9, "a b c d e a b c d e")]
    assert run(spark, rows) == brute(rows)


def test_awkward(spark, docs):
    rows = [(i, t) for i, t, _, _ in awkward()]
    assert run(spark, rows) == brute(rows)


def test_empty(nothing):
    assert ngram_join.join(nothing).count() == 0


@pytest.mark.parametrize("least", [None, -(1 << 63)])
def test_the_largest_id_is_no_null(spark, least):
    most = (1 << 63) - 1
    rows = [(most, prose(1, 40)), (None, prose(1, 40)), (None, prose(2, 40)), (least, prose(3, 40)), (0, prose(4, 40)), (most - 1, prose(4, 40)), (1, None)]
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=repr) == sorted([(most, most), (None, most), (None, None), (least, least), (0, 0), (most - 1, 0), (1, 1)], key=repr)
