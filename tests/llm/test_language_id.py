import random

import pytest
import zstandard
from helpers import awkward
from tallgrass.llm import language_id

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ser"], "bb": ["bra", "gon", "zil", "wep", "oth"], "cc": ["éa", "ñu", "çi", "ôl", "àn"]}


def sentence(lang, seed, words=40):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(words))


def test_held_out_accuracy(spark):
    rows = [(i, sentence(lang, f"{lang}{i}"), lang) for lang in SYLLABLES for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = language_id.fit(frame.filter("doc_id < 40"))
    assert sorted(made) == sorted(SYLLABLES)
    found = language_id.predict(frame.withColumnRenamed("lang", "truth"), made).filter("doc_id >= 40").collect()
    assert sum(r.best == r.truth for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    assert made == language_id.fit(frame.filter("doc_id < 40"))


def plain_sizes(text, made):
    """The size of a text under each dictionary, by the library's own plain call."""
    letters = "".join(c if c.isalpha() else " " for c in text).lower()
    raw = " ".join(letters.split()).encode()
    out = {}
    for lang, words in made.items():
        packer = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(words, zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        out[lang] = sum(len(packer.compress(raw[i : i + language_id.PIECE])) for i in range(0, len(raw), language_id.PIECE))
    return out


def test_brute_force_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    made = language_id.fit(docs)
    text = {r.doc_id: r.text for r in docs.collect()}
    seen = 0
    for r in language_id.predict(docs.drop("lang"), made, margin=0.05).collect():
        size = plain_sizes(text[r.doc_id] or "", made) if any(c.isalpha() for c in text[r.doc_id] or "") else None
        if size is None:
            assert r.best == "und" and r.lang is None
            continue
        order = sorted(size, key=lambda x: (size[x], x))
        gap = (size[order[1]] - size[order[0]]) / size[order[1]]
        assert r.best == order[0] and r.margin == pytest.approx(gap) and r.lang == (r.best if gap >= 0.05 else None)
        seen += 1
    assert seen > 150


def test_texts_without_letters_and_small_languages(spark):
    rows = [(i, sentence("aa", i), "aa") for i in range(20)] + [(30, "qx", "tiny"), (31, "123", "digits"), (32, None, "nothing")]
    made = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(made) == ["aa", "tiny"]
    texts = ["\u0301", "\u200d", "12 _ 3", "", None, "qx qx qx", "é"]
    found = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), made).orderBy("doc_id").collect()
    assert [r.best for r in found[:5]] == ["und"] * 5 and all(r.best in made for r in found[5:])


def test_many_languages_are_all_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TOTAL_BYTES", 100)
    monkeypatch.setattr(language_id, "LEAST_BYTES", 32)
    rows = [(i, sentence("aa", i), f"l{i % 60}") for i in range(120)]
    made = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(made) == 60 and {len(d) for d in made.values()} == {32}


def test_narrow_margins_are_rejected(spark):
    frame = spark.createDataFrame([(i, sentence(lang, i), lang) for i, lang in enumerate(("aa", "bb") * 20)], "doc_id long, text string, lang string")
    made = language_id.fit(frame)
    mixed = spark.createDataFrame([(1, sentence("aa", 5) + " " + sentence("bb", 6)), (2, sentence("aa", 7))], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_id.predict(mixed, made, margin=0.1).collect()}
    assert rows[1].lang is None and rows[1].best in ("aa", "bb") and rows[2].lang == "aa"


def test_awkward(docs, nothing):
    made = language_id.fit(docs)
    found = language_id.predict(docs, made).collect()
    assert len(found) == len(awkward())
    by_id = {r.doc_id: r for r in found}
    for i in (20, 21, 22):
        assert by_id[i].best == "und" and by_id[i].lang is None and by_id[i].score == 0
    assert language_id.fit(nothing) == {} and language_id.predict(nothing, made).count() == 0
    assert {r.best for r in language_id.predict(docs, {}).collect()} == {"und"}
