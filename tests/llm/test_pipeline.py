"""The stages of the pipeline, each on its own and all together, against plain Python."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from helpers import ALNUM, BLANK, lower, prose
from tallgrass.llm import quality_model, shard_table
from test_ngram_join import brute as near_groups

STAGE = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "what is the name of the tall bird that cannot fly but runs fast"
SHORT = "zebra crossing twice"

MOST = (1 << 63) - 1


def corpus():
    r = random.Random(4)
    texts = [prose(i, r.randint(20, 90)) for i in range(90)]
    texts += [f"{texts[i]} tail{i}" for i in range(0, 30, 3)] + texts[40:44]
    texts += [f"{prose(200 + i, 30)} {ITEM} {prose(300 + i, 30)}" for i in range(4)] + [f"{prose(400, 30)} ZEBRA, crossing twice", f"{prose(401, 30)} {' '.join(ITEM.split()[:9])}"]
    texts += ["$$$ ### " * 20 + str(i) for i in range(25)] + [None, "", " "]
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, SHORT), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(not (t or "").startswith("$")), 0) for i, t, *_ in rows if t]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def after_quality(spark, rows, folder):
    """Scores from the learned trees, walked on the driver; the model itself has tests of its own."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, SCHEMA)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality_model.learned(quality_model.with_statistics(docs.select("doc_id", "text", held.alias("held_out"))), labels, learn=~F.col("held_out"))
    score = model.score(quality_model.statistics(pa.array([t for _, t, *_ in rows], pa.string())))
    return [row for row, s in zip(rows, score, strict=True) if s >= corpus_pipeline.LEAST_QUALITY]


def after_near_duplicates(rows):
    return [row for row in rows if row[0] in {c for _, _, c in near_groups([x[:2] for x in rows])}]


def after_decontamination(rows):
    windows = set()
    for text in (ITEM, SHORT):
        w = ALNUM.findall(lower(text))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}

    def hit(text):
        w = ALNUM.findall(lower(text))
        return any(tuple(w[i : i + k]) in windows for k in {len(x) for x in windows} for i in range(len(w) - k + 1))

    return [row for row in rows if not hit(row[1])]


def targets(sizes):
    """Targets by filling up: sources above their ceiling stop there, the others share what is left."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in above}


def collected(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


def check_mixture(before, after):
    size = {row: len(BLANK.findall(row[1] or "")) for row in before}
    of_source, taken, longest = Counter(), Counter(), Counter()
    for row in before:
        of_source[row[3]] += size[row]
        longest[row[3]] = max(longest[row[3]], size[row])
    copies = Counter(map(tuple, after))
    assert set(copies) <= set(before) and max(copies.values()) <= 3
    for row, n in copies.items():
        taken[row[3]] += n * size[row]
    for source, target in targets(of_source).items():
        assert abs(taken[source] - target) <= longest[source]


def test_quality(spark, folder):
    rows = corpus()
    found = collected(STAGE["quality classifier"](spark, spark.createDataFrame(rows, SCHEMA), folder))
    assert found == sorted(after_quality(spark, rows, folder), key=repr)
    ids = {row[0] for row in found}
    assert not [i for i, t, *_ in rows if (t or "").startswith("$") and i in ids]
    assert all(i in ids for i in range(90))


def test_near_duplicates(spark, folder):
    rows = corpus()
    found = collected(STAGE["n-gram Jaccard join"](spark, spark.createDataFrame(rows, SCHEMA), folder))
    assert found == sorted(after_near_duplicates(rows), key=repr)


def test_near_duplicates_with_repeated_ids(spark, folder):
    """No text is lost: of rows with one id each that leads its group stays."""
    rows = [(1, prose(1, 40), "en", "s", 1), (1, prose(2, 40), "en", "s", 1), (None, prose(3, 40), "en", "s", 1), (None, None, None, None, None), (5, prose(7, 40), "en", "s", 1), (5, "", "en", "s", 1), (MOST, prose(8, 40), "en", "s", 1)]
    gone = [(2, prose(2, 40), "en", "s", 1), (1, prose(1, 40) + " tail", "en", "s", 1), (5, prose(7, 40), "en", "s", 1), (5, "", "en", "s", 1), (None, prose(8, 40), "en", "s", 1), (5, prose(2, 40) + " tail", "en", "s", 1)]
    found = collected(STAGE["n-gram Jaccard join"](spark, spark.createDataFrame(rows + gone, SCHEMA), folder))
    assert found == sorted(rows, key=repr)


def test_near_duplicates_without_ids(spark):
    text = [prose(i, 40) for i in range(8)]
    stay = [(1, text[0], "en", "s", 1), (None, text[1], "en", "s", 1), (None, text[2], "en", "s", 2), (None, text[3], "a", "s", 1)]
    stay += [(None, None, None, None, None), (None, "", "en", "s", 0), (None, " ", "en", "s", 1), (2, text[4], "en", "s", 1), (3, text[5], "en", "s", 1)]
    gone = [(None, text[0] + " tail", "en", "s", 1), (None, text[2] + " tail", "en", "s", 1), (None, text[3], "b", "s", 1), (None, text[4], "en", "s", 1)]
    # of the rows with id 3 one is a near copy of id 1, one has no words
    gone += [(3, text[0] + " also", "en", "s", 1)]
    stay += [(3, None, "en", "s", 1)]
    found = collected(STAGE["n-gram Jaccard join"](spark, spark.createDataFrame(gone + stay, SCHEMA), ""))
    assert found == sorted(stay, key=repr)


def test_decontamination(spark, folder):
    rows = corpus()
    found = collected(STAGE["benchmark decontamination"](spark, spark.createDataFrame(rows, SCHEMA), folder))
    assert found == sorted(after_decontamination(rows), key=repr) and len(found) == len(rows) - 5


def test_mixture(spark, folder):
    rows = corpus()
    once, again = (collected(STAGE["mixing sources to target weights"](spark, spark.createDataFrame(rows, SCHEMA), folder)) for _ in range(2))
    check_mixture(rows, once)
    assert once == again


def test_mixture_keeps_sources_apart(spark, folder):
    rows = [(1, prose(1, 30), "en", "a", 1), (1, prose(1, 30), "en", "b", 1), *((10 + i, prose(10 + i, 30), "en", "ab"[i % 2], 1) for i in range(20))]
    found = collected(STAGE["mixing sources to target weights"](spark, spark.createDataFrame(rows, SCHEMA), folder))
    check_mixture(rows, found)


def test_columns_of_any_name_come_through(spark, folder):
    """Each stage keeps columns named like its working and result columns, maps among them, also where ids repeat."""
    names = ["score", "stats", "n_words", "n_hit", "items", "hits", "longest", "__id", "__size", "__one", "key", "doc", "size", "copies", "source_size", "__copies", "component", "group", "__c9"]
    rows = [(i % 40, prose(i, 40), "en", f"s{i % 3}", 1, {"a": i}, *(f"{n} {i}" for n in names)) for i in range(60)] + [(None, prose(70, 40), None, None, 1, None, *names)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, tags map<string,long>, " + ", ".join(f"`{n}` string" for n in names))
    given = {(r[0], r[1]): (r[5], *r[6:]) for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns
        found = out.collect()
        assert found and all((r.tags, *(r[n] for n in names)) == given[r.doc_id, r.text] for r in found), name


def test_all_stages(spark, folder):
    rows = after_decontamination(after_near_duplicates(after_quality(spark, corpus(), folder)))
    found = corpus_pipeline.run(spark, folder).collect()
    check_mixture(rows, [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in found])
    table = shard_table.fill(shard_table.shard_names(shard_table.SHARDS))
    assert all(table[r.slot] == r.shard for r in found)


def test_empty(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
