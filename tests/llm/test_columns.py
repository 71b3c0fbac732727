"""Further columns come through every operator unchanged, whatever their names."""

import pytest

from helpers import prose
from tallgrass.llm import decontaminate, kneser_ney, language_id, license_scan, quality_model, shard_table, window_dedup

NAMES = ["doc", "__doc", "__hits", "key", "check", "__slot", "__part", "learn", "__c0", "__c7", "part", "index", "owner", "label", "at", "__id", "__at"]
RESULTS = ["score", "margin", "best", "stats", "n_words", "n_hit", "items", "hits", "longest", "matches", "slot", "shard", "n_removed", "kept_sha256", "kept_text", "perplexity", "n_tokens", "n_known", "base_score"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, prose(i % 9, 40), "en", "s", {"a": i}, *(f"{n} {i}" for n in NAMES + RESULTS)) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tags map<string,long>, " + ", ".join(f"`{n}` string" for n in NAMES + RESULTS))


def test_all_operators(spark, table):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, prose(3, 12))], "item_id long, text string")
    found = {
        "op3": decontaminate.scan(table, items), "op3 clean": decontaminate.clean(table, items), "op4": language_id.predict(table, language_id.fit(table)), "op5": window_dedup.dedup(table),
        "op7": license_scan.scan(table), "op8": shard_table.place(table), "op8 by slot": shard_table.place(table, key="slot"), "op9": quality_model.classify(table, labels),
        "op10": kneser_ney.score(table, kneser_ney.train(table)),
    }
    for name, out in found.items():
        assert len(set(out.columns)) == len(out.columns), name
        rows = out.collect()
        assert len(rows) == 12 and all(r.tags == {"a": r.doc_id} and all(r[n] == f"{n} {r.doc_id}" for n in NAMES) for r in rows), name
    assert all(r[n] == f"{n} {r.doc_id}" for r in found["op3 clean"].collect() for n in RESULTS)
    assert "slot" in found["op8"].columns and dict(found["op8"].dtypes)["slot"] == "int" and dict(found["op4"].dtypes)["score"] == "double"
