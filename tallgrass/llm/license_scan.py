"""License scan: winnowed fingerprints of templates find candidates, banded alignment measures what they cover.

A template is a word sequence. The hashes of its runs of words are fingerprints in an inverted index that maps each to its places.
Templates of LONG_WORDS or more have runs of GRAM words, winnowed (Schleimer, Wilkerson and Aiken, 2003): of every SPAN runs in a row
the least is kept, and a text looks up all of its own runs, so any shared passage of GRAM + SPAN - 1 words is found. Shorter ones
have all their pairs of words: a text that repeats the wanted share of a template keeps a number of its pairs (each changed word breaks
two), so only places where that many stand at about the same offset are looked at. Words of template and region are then aligned
(edits within BAND words of the diagonal), which gives the words of the template that the text repeats. Where a text has words put into
a long template, its parts stand at different offsets: regions up to INSERTED words apart are also aligned as one, so insertions of that
many words in all are bridged; a longer one leaves two parts, which are found if one of them covers enough. Reported are alignments that
cover enough of their template and hold all the words that it must have (such as the version), with matched words, coverage and
span in the text; a short notice is not reported where a negation stands before or within it. Of overlapping alignments with one template
the one that covers most is reported.

Templates come as a table, are dealt to parts of PART_WORDS words, each indexed in a task of its own and written to the shared folder.
A worker gathers texts and takes them through the parts, one part in memory at a time; nothing passes through the driver.

Defined results: null and empty texts and texts without a match have no matches; a template of one word is found where that word
stands; a template without words is never found; equal coverage goes to the longer match, then the name first in order; repeated rows
each get their results; further columns are kept, one named `matches` is replaced; an empty table of texts or templates gives no
matches.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm.shared import file_of, gathered, new_folder, save, shielded, stored
from tallgrass.llm.words import ALNUM_FOLDED, chunked, run_hashes

GRAM = 4
SPAN = 3
BAND = 6
#: Templates of this many words or more are indexed by winnowed runs, shorter ones by all pairs of words.
LONG_WORDS = 64
#: Words that may be put into a long template, in all.
INSERTED = 120
MIN_COVERAGE = 0.7
#: Words of the templates of one part, about.
PART_WORDS = 500_000
GATHER_BYTES = 32 << 20

_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CLAUSES_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_THIRD_BSD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_WARRANTY_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _gnu_header(kind: str, version: str) -> str:
    name = f"GNU {kind}General Public License"
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this program."
    )


#: Identifiers that files name their licence by: fixed values.
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "CC0-1.0", "Unlicense", "Zlib", "BSL-1.0")
#: Words before or within a short notice, and not its own, that take back what it says; looked for from NEGATED_WITHIN words before it on.
NEGATIONS = "not never neither nor isn wasn aren cannot"
NEGATED_WITHIN = 3

#: Licences in full where they are short, the notices that their publishers ask for where they are long, and usual one-line notices, as
#: publicly worded: fixed texts. The third entry lists words that tell a licence apart from others of nearly the same wording.
NOTICES = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY_MIT, ""),
    ("MIT-notice", "Released under the MIT License.", "mit"),
    ("MIT-notice", "Licensed under the MIT License.", "mit"),
    ("MIT-notice", "This project is licensed under the terms of the MIT license.", "mit"),
    ("BSD-2-Clause", _CLAUSES_BSD + _WARRANTY_BSD, ""),
    ("BSD-3-Clause", _CLAUSES_BSD + _THIRD_BSD + _WARRANTY_BSD, "endorse promote"),
    ("BSD-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "bsd"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _WARRANTY_ISC, "provided"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _WARRANTY_ISC, ""),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ""),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.', ""),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY_MIT, ""),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", "changing"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', ""),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0.", "apache 2"),
    *((f"{short}-{version}.0", _gnu_header(kind, version), version) for short, kind, version in (("GPL", "", "2"), ("GPL", "", "3"), ("LGPL", "Lesser ", "3"), ("AGPL", "Affero ", "3"))),
    ("LGPL-2.1", _gnu_header("Lesser ", "2.1"), "2 1"),
    *((f"{short}-{version}.0-notice", f"This work is licensed under the GNU {kind}General Public License, version {version}.", f"{must} {version}".strip()) for short, kind, must, version in (("GPL", "", "", "2"), ("GPL", "", "", "3"), ("LGPL", "Lesser ", "lesser", "3"), ("AGPL", "Affero ", "affero", "3"))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mozilla 2"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "eclipse 2"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ""),
    *((f"CC-{short}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"{name.lower().replace('-', ' ')} 4") for short, name in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
    *((f"CC-{short}-4.0", f"Licensed under CC {short} 4.0.", f"cc {short.lower().replace('-', ' ')} 4") for short in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")),
    *((f"CC-{short}-3.0", f"Licensed under CC {short} 3.0.", f"cc {short.lower().replace('-', ' ')} 3") for short in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")),
    *((f"{id}-notice", f"SPDX-License-Identifier: {id}", f"spdx {id.lower().replace('-', ' ').replace('.', ' ')}") for id in SPDX),
    *((f"{id}-notice", f"License: {id}", f"license {id.lower().replace('-', ' ').replace('.', ' ')}") for id in SPDX),
    # the heads of the long ones' own texts
    ("Apache-2.0-text", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "apache january 2"),
    ("GPL-2.0-text", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.", "general 2 1991"),
    ("GPL-3.0-text", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.", "general 3 29"),
    ("LGPL-2.1-text", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.", "lesser 1 1999"),
    ("LGPL-3.0-text", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.", "lesser 3 29"),
    ("AGPL-3.0-text", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.", "affero 3 19"),
    ("MPL-2.0-text", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity", "mozilla definitions"),
    ("EPL-2.0-text", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE", "eclipse 2 accompanying"),
    ("All-rights-reserved", "All rights reserved.", ""),
]


def notices(spark: SparkSession) -> DataFrame:
    """name, text, must of the built-in notices."""
    return spark.createDataFrame(NOTICES, "name string, text string, must string")


def winnow(h: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Places of the kept hashes: of every span in a row the least, the last of equal ones; all if there are fewer."""
    if len(h) <= span:
        return np.arange(len(h))
    rows = np.lib.stride_tricks.sliding_window_view(h, span)[:, ::-1]
    return np.unique(np.arange(len(rows)) + span - 1 - rows.argmin(axis=1))


def _word_lists(texts: list[str]) -> list[np.ndarray]:
    return [w.hash[w.lo[i] : w.hi[i]] for w in chunked(pa.array(texts, pa.string()), ALNUM_FOLDED) for i in range(len(w.lo))]


class Index:
    """Templates' words, and where each fingerprint stands. templates: name, text, and words that a match must hold."""

    def __init__(self, templates: list[tuple[str, str, str]], min_coverage: float = MIN_COVERAGE) -> None:
        self.names, self.words, self.must, self.band, self.least, self.min_coverage = [], [], [], [], [], min_coverage
        self.negations = set(_word_lists([NEGATIONS])[0].tolist())
        places: dict[int, dict[int, list[tuple[int, int]]]] = {1: defaultdict(list), 2: defaultdict(list), GRAM: defaultdict(list)}
        for (name, _, _), h, must in zip(templates, _word_lists([t for _, t, _ in templates]), _word_lists([m for _, _, m in templates]), strict=True):
            n = len(h)
            if not n:
                continue
            t = len(self.names)
            self.names.append(name), self.words.append(h), self.must.append(set(must.tolist()))
            gram = GRAM if n >= LONG_WORDS else min(2, n)
            self.band.append(BAND if n >= LONG_WORDS else min(BAND, n // 2))
            # words changed break two pairs each; words put in break one, for which an eighth is allowed
            changed = int(n * (1 - min_coverage) + 1e-9)
            self.least.append(1 if gram != 2 else max(1, n - 1 - 2 * changed - n // 8))
            runs = run_hashes(h, gram)
            for at in (winnow(runs) if gram == GRAM else range(len(runs))):
                places[gram][int(runs[at])].append((t, int(at)))
        self.places = {gram: dict(x) for gram, x in places.items() if x}
        self.keys = {gram: np.array(sorted(x), np.uint64) for gram, x in self.places.items()}
        self.fewest = min(self.least, default=1)

    def hits(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """Places in a word sequence that start a known fingerprint, by its number of words."""
        out = {}
        for gram, keys in self.keys.items():
            runs = run_hashes(h, gram)
            at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
            out[gram] = np.flatnonzero(keys[at] == runs)
        return out

    def negated(self, t: int, h: np.ndarray) -> bool:
        """Whether a negation that is not the template's own stands among the words."""
        return bool((self.negations & set(h.tolist())) - set(self.words[t].tolist()))

    def regions(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """template, first and one past last word of each region worth aligning."""
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for gram, places in self.hits(h).items():
            runs = run_hashes(h, gram)
            for at in places.tolist():
                for t, there in self.places[gram][int(runs[at])]:
                    by[t].append((at - there, there))
        for t, found in by.items():
            found.sort()
            n, band, least, last = len(self.words[t]), self.band[t], self.least[t], None
            end, starts = 0, []
            for i, (offset, _) in enumerate(found):
                if last is not None and offset <= last + band:
                    continue
                while end < len(found) and found[end][0] <= offset + band:
                    end += 1
                if end - i >= least and len({there for _, there in found[i:end]}) >= least:
                    yield t, max(0, offset - band), min(len(h), offset + n + 2 * band)
                    last = offset
                    starts.append(offset)
            if n >= LONG_WORDS:
                done = None
                for i, offset in enumerate(starts):
                    far = starts[int(np.searchsorted(starts, offset + INSERTED, "right")) - 1]
                    if far > offset and far != done:
                        yield t, max(0, offset - band), min(len(h), far + n + 2 * band)
                        done = far


def align(a: np.ndarray, b: np.ndarray, band: int = BAND) -> tuple[int, int, int]:
    """Most words of a that stand in b in order, within the band around the diagonals that the length of b allows; and the span of
    these in b. Of the ways to match the most, the one that starts last; of those, the one that ends first."""
    width, one = max(0, len(b) - len(a)) + 2 * band, 1 << 32
    best = np.zeros(len(b) + 1, np.int64)  # matched words, then the place in b where they start
    for i, word in enumerate(a):
        lo, hi = max(0, i - band), min(len(b), i + width + 1)
        same = b[lo:hi] == word
        if same.any():
            before = best[lo:hi]
            longer = np.where(before < one, one + np.arange(lo, hi), before + one)
            best[lo + 1 : hi + 1] = np.maximum(best[lo + 1 : hi + 1], np.where(same, longer, 0))
            best[lo:] = np.maximum.accumulate(best[lo:])
    top = int(best[-1])
    return top >> 32, top & (one - 1), int(np.argmax(best == top)) if top else 0


_MATCH = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("matched", T.LongType()), T.StructField("words", T.LongType()), T.StructField("coverage", T.DoubleType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("span", T.StringType()),
])


def _matches(h: np.ndarray, index: Index) -> list[tuple[int, int, int, int, float]]:
    """template, matched words, first and one past last word, coverage; of overlapping ones with one template the best."""
    tried = []
    for t, lo, hi in index.regions(h):
        matched, a, b = align(index.words[t], h[lo:hi], index.band[t])
        share = matched / len(index.words[t])
        if share < index.min_coverage or not index.must[t] <= set(h[lo + a : lo + b].tolist()):
            continue
        if len(index.words[t]) >= LONG_WORDS or not index.negated(t, h[max(0, lo + a - NEGATED_WITHIN) : lo + b]):
            tried.append((t, matched, a + lo, b + lo, share))
    out, taken = [], defaultdict(list)
    for m in sorted(tried, key=lambda m: (-m[4], -m[1], m[3] - m[2], m[2])):
        # templates of one name are wordings of one licence
        name = index.names[m[0]]
        if not any(m[2] < y and x < m[3] for x, y in taken[name]):
            taken[name].append((m[2], m[3]))
            out.append(m)
    return out


def indexes(templates: DataFrame, min_coverage: float = MIN_COVERAGE, part_words: int = PART_WORDS) -> tuple[str, int]:
    """A folder with a pickled Index for each part, and how many parts there are. templates(name, text, and must if there is such a column).
    The templates of one name are of one part."""
    must = F.coalesce(F.col("must").cast("string"), F.lit("")) if "must" in templates.columns else F.lit("")
    rows = stored(templates.select(F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), must.alias("must")).distinct(), "templates")
    words = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[\x80-\uFFFF\w]+")))).first()[0] or 0
    parts, folder = int(words // part_words) + 1, new_folder(templates.sparkSession, "license-index")

    def one(rows):
        part = int(rows["part"].iloc[0])
        rows = rows.sort_values(["name", "text", "must"])
        save(folder, f"part-{part}", pickle.dumps(Index(list(zip(rows["name"], rows["text"], rows["must"], strict=True)), min_coverage), 5))
        return rows[["part"]].head(1)

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)))
    dealt.groupBy("part").applyInPandas(one, "part long").write.format("noop").mode("overwrite").save()
    return folder, parts


_KIND = pa.list_(pa.struct([("name", pa.string()), ("matched", pa.int64()), ("words", pa.int64()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("span", pa.string())]))


def _found(texts: pa.Array, index: Index, rows: list[list[dict]]) -> None:
    for w in chunked(texts, ALNUM_FOLDED):
        # runs over text bounds do no harm: a text looks again for itself
        hits = np.bincount(np.concatenate([np.searchsorted(w.hi, x, "right") for x in index.hits(w.hash).values()]), minlength=len(w.lo)) if index.keys else np.zeros(0)
        for i in np.flatnonzero(hits >= index.fewest).tolist():
            lo = int(w.lo[i])
            for t, matched, a, b, share in _matches(w.hash[lo : w.hi[i]], index):
                text = bytes(w.data[w.start[lo + a] : w.end[lo + b - 1]]).decode()
                rows[w.first + i].append({"name": index.names[t], "matched": matched, "words": len(index.words[t]), "coverage": share, "first_word": a, "last_word": b - 1, "span": text})


def _scan(folder: str, parts: int, at: int):
    def load(part: int) -> Index:
        path = file_of(folder, f"part-{part}")  # a part may be empty
        if path is None:
            return Index([])
        with open(path, "rb") as f:
            return pickle.load(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in gathered(batches, at, GATHER_BYTES):
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for part in range(parts):
                if index is None or parts > 1:
                    index = None  # the one before goes first
                    index = load(part)
                _found(batch.column(at), index, rows)
            for found in rows:
                found.sort(key=lambda m: (-m["coverage"], -m["matched"], m["name"], m["first_word"]))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _KIND)], names=[*(c for i, c in enumerate(batch.schema.names) if i != at), "matches"])

    return run


def scan(docs: DataFrame, templates: DataFrame | None = None, text_column: str = "text", min_coverage: float = MIN_COVERAGE, part_words: int = PART_WORDS) -> DataFrame:
    """docs without the text, with matches: array of name, matched, words, coverage, first_word, last_word, span; best first."""
    folder, parts = indexes(notices(docs.sparkSession) if templates is None else templates, min_coverage, part_words)
    rows, restore = shielded(docs, [text_column])
    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema if f.name != text_column]
    return restore(rows.mapInArrow(_scan(folder, parts, rows.columns.index(text_column)), T.StructType([*fields, T.StructField("matches", T.ArrayType(_MATCH))])))
