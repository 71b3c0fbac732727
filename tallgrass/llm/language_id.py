"""Language ID by compression: a text belongs to the language whose dictionary compresses it best.

Each language has a zstandard raw-content dictionary: words of that language's texts, reduced to their letters, out of order. A text, reduced likewise, is
cut into pieces of PIECE characters (all of it, so a long text does not become its own dictionary), each piece is compressed with
each dictionary, and the sizes are added up. The smallest total wins. `lang` is null where the runner-up is closer than `margin`
(a share of its size); `best` is the winner in any case.

Dictionaries are fitted on a bounded sample: about SAMPLE_TEXTS labelled texts a language by a hash of the id, of whose words
DICTIONARY_BYTES are used. All languages of the labelled rows that have a letter in their sample are learned; with many, dictionaries
shrink to TOTAL_BYTES together, but not below LEAST_BYTES each.

Defined results: best is `und`, lang null and score 0 where the text is null or has no letter (marks and joiners are none), or no
language was learned; ties go to the language first in code point order; further columns are kept, those named like a result column
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm.shared import join_small, shielded, stored

SAMPLE_TEXTS = 400
DICTIONARY_BYTES = 96 << 10
TOTAL_BYTES, LEAST_BYTES = 64 << 20, 4 << 10
PIECE = 2000
LEVEL = 6
UNDETERMINED = "und"

_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters_of(text: str | None) -> str:
    """Lower-cased runs of letters and their marks, one blank between them; empty without a letter."""
    return _NO_LETTERS.sub(" ", text).strip().lower() if text and _LETTER.search(text) else ""


def fit(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, from labelled(doc_id, text, lang). The sample depends on ids and texts only."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("__at")).filter("lang IS NOT NULL AND text IS NOT NULL")
    # a row a language, with the share of hash values that holds sample_texts of its texts in expectation
    share = F.least(F.lit(1.0), F.lit(float(sample_texts)) / F.count(F.lit(1)))
    limits = stored(rows.groupBy("lang").agg((share * (1 << 32)).cast("long").alias("limit")), "language-shares")
    languages = limits.count()
    if not languages:
        return {}
    room = min(dictionary_bytes, max(TOTAL_BYTES // languages, LEAST_BYTES))
    sample = join_small(rows, limits, ["lang"], languages).filter(F.pmod("__at", F.lit(1 << 32)) < F.col("limit"))

    def one(found: pd.DataFrame) -> pd.DataFrame:
        # words out of order: a passage that a text shares with the sample must not count as its language
        words = [w for text in found.sort_values(["__at", "text"])["text"] for w in letters_of(text).split()]
        random.Random(1).shuffle(words)
        # zstandard takes no fewer than 8 bytes
        return pd.DataFrame({"lang": [found["lang"].iloc[0]], "dictionary": [" ".join(words).encode()[:room].rjust(8) if words else b""]})

    made = sample.groupBy("lang").applyInPandas(one, "lang string, dictionary binary")
    return {r.lang: bytes(r.dictionary) for r in made.orderBy("lang").toLocalIterator() if r.dictionary}


def _predict(dictionaries: dict[str, bytes], at: int, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = sorted(dictionaries)
        packers = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            best, lang_out, scores, margins = [], [], [], []
            for value in batch.column(at):
                text = letters_of(value.as_py()) if value.is_valid else ""
                if not text or not langs:
                    best.append(UNDETERMINED), lang_out.append(None), scores.append(0.0), margins.append(0.0)
                    continue
                raw = text.encode()
                pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
                size = np.array([sum(len(p.compress(piece)) for piece in pieces) for p in packers], float)
                order = np.argsort(size, kind="stable")
                won = order[0]
                gap = float((size[order[1]] - size[won]) / size[order[1]]) if len(order) > 1 else 1.0
                # shares fall with the size relative to the best: 5 % more is about a tenth of the weight
                weight = np.exp(-(size / size[won] - 1) * 46)
                best.append(langs[won])
                lang_out.append(langs[won] if gap >= margin else None)
                scores.append(float(weight[won] / weight.sum()))
                margins.append(gap)
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            columns += [pa.array(best, pa.string()), pa.array(lang_out, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "best", "lang", "score", "margin"])

    return run


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text_column: str = "text", margin: float = 0.02) -> DataFrame:
    """docs without the text, with best, lang (null: rejected), score (0 to 1) and margin."""
    rows, restore = shielded(docs, [text_column])
    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema if f.name != text_column]
    fields += [T.StructField("best", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())]
    return restore(rows.mapInArrow(_predict(dictionaries, rows.columns.index(text_column), margin), T.StructType(fields)))
