"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Items are cut into segments of a bounded number of words that overlap by one word less than a window, so no window is lost; the
segments are dealt to parts of a bounded number of words, and each part's automaton is built in a task of its own and written to the
shared folder. One pass streams every text's words through the automata, one after the other, and tracks the longest match that
ends at each word. Where it reaches the window's length, the words of the window are hit, and the state that holds the window
names its items. A worker gathers GATHER_BYTES of texts for each round of the automata and holds one automaton at a time, whose size
PART_WORDS bounds; nothing is shuffled, and nothing of the items passes through the driver.

Words are compared by 64-bit hashes of their letters. Defined results: null and empty texts have no words and no hits; an item
without words matches nothing; an item shorter than a window is one window; repeated items count by item_id, once; an empty table
of items leaves every document clean; further columns are kept (by `scan` those named like a result column are replaced).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm.shared import discard, file_of, gathered, new_folder, save, shielded, stored
from tallgrass.llm.words import ALNUM_FOLDED, chunked

WINDOW = 10
#: Words of one automaton (some hundred bytes each in a worker), and of one segment of an item.
PART_WORDS = 400_000
SEGMENT_WORDS = 50_000
GATHER_BYTES = 64 << 20


class Automaton:
    """The substrings of several word sequences. State 0 is the empty one."""

    def __init__(self, window: int) -> None:
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        self.of_window: list[int] = []
        self.items: dict[int, list[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.names: list[str] = []
        self.least = window

    def _state(self, length: int, link: int, after: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.next) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of p's longest string followed by word: the one after p, or a copy for the shorter strings."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def matches(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For each word, the state and the length of the longest match that ends there."""
        v = n = 0
        after, link, length = self.next, self.link, self.length
        for word in words:
            while v and word not in after[v]:
                v = link[v]
                n = length[v]
            if word in after[v]:
                v = after[v][word]
                n += 1
            yield v, n

    def finish(self, segments: list[tuple[int, list[int]]], sizes: dict[int, int]) -> None:
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.of_window = [0] * len(order)
        for v in order[1:]:
            up = self.link[v]
            self.of_window[v] = v if self.length[up] < self.window <= self.length[v] else self.of_window[up]
        found: dict[int, set[int]] = {}
        own: dict[int, set[tuple[int, int]]] = {}
        for item, words in segments:
            for i, (v, n) in enumerate(self.matches(words)):
                if n >= self.window:
                    found.setdefault(self.of_window[v], set()).add(item)
                if i + 1 == sizes[item] < self.window:
                    own.setdefault(v, set()).add((sizes[item], item))
        self.items = {v: sorted(x) for v, x in found.items()}
        for v in order[1:]:
            if both := sorted(own.get(v, set()) | set(self.short.get(self.link[v], ()))):
                self.short[v] = both
        self.least = min([self.window, *(n for _, n in ((i, sizes[i]) for i, _ in segments))])

    def scan(self, words: list[int], hit: np.ndarray, at: int, items: set[str]) -> int:
        """Marks the hit words of one run, from place `at` of hit; returns the longest match."""
        longest = 0
        for i, (v, n) in enumerate(self.matches(words)):
            if n > longest:
                longest = n
            if n >= self.window:
                hit[at + i + 1 - self.window : at + i + 1] = True
                items.update(self.names[x] for x in self.items[self.of_window[v]])
            if v in self.short:
                for size, x in self.short[v]:
                    if size <= n:
                        hit[at + i + 1 - size : at + i + 1] = True
                        items.add(self.names[x])
        return longest


def build(items: list[tuple[str, list[int], int]], window: int) -> Automaton:
    """items: name, word numbers of a segment, and the words of its whole item."""
    made, names, segments, sizes = Automaton(window), {}, [], {}
    for name, words, whole in items:
        # one item_id with several texts: those of another length are items of their own, of that name
        x = names.setdefault((name, whole), len(names))
        sizes[x] = whole
        segments.append((x, words))
        last = 0
        for word in words:
            last = made.extend(last, word)
    made.names = [name for name, _ in names]
    made.finish(segments, sizes)
    return made


def _segments(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w in chunked(batch.column(1), ALNUM_FOLDED):
                for i in range(len(w.lo)):
                    h = w.hash[w.lo[i] : w.hi[i]].view(np.int64)
                    for a in range(0, max(1, len(h) - window + 1) if len(h) else 0, SEGMENT_WORDS):
                        out.append((batch.column(0)[w.first + i].as_py(), h[a : a + SEGMENT_WORDS + window - 1].tolist(), len(h)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.int64())], ["item", "words", "whole"])

    return run


def automata(items: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> tuple[str, int]:
    """A folder with a file for each part, pickled: vocabulary (sorted word hashes) and the automaton over word numbers; and how many
    parts there are. items(item_id, text)."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    cut = stored(rows.mapInArrow(_segments(window), "item string, words array<bigint>, whole bigint").distinct(), "segments")
    total = cut.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(1, -(-2 * total // part_words)) if total > part_words else 1
    folder = new_folder(items.sparkSession, "automata")

    def one(rows):
        import pandas as pd

        part = int(rows["part"].iloc[0])
        vocabulary = np.unique(np.concatenate([np.asarray(w, np.int64) for w in rows["words"]])).view(np.uint64)
        vocabulary.sort()
        rows = rows.sort_values(["item", "whole"])
        number = lambda w: (np.searchsorted(vocabulary, np.asarray(w, np.int64).view(np.uint64)) + 1).tolist()
        made = build([(r.item, number(r.words), int(r.whole)) for r in rows.itertuples()], window)
        save(folder, f"part-{part}", pickle.dumps((vocabulary, made), 5))
        return pd.DataFrame({"part": [part]})

    dealt = cut.withColumn("part", F.pmod(F.xxhash64("item", "whole", "words"), F.lit(parts)))
    dealt.groupBy("part").applyInPandas(one, "part long").write.format("noop").mode("overwrite").save()
    discard(cut)
    return folder, parts


_MARKS = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(pa.string())), ("hits", pa.binary())]


class _Marks:
    """What is found in each text of a batch; hits has a bit a word."""

    def __init__(self, texts: int) -> None:
        self.n_words, self.n_hit, self.longest, self.items, self.hits = np.zeros(texts, np.int64), [0] * texts, [0] * texts, [[] for _ in range(texts)], [None] * texts

    def add(self, texts: pa.Array, vocabulary: np.ndarray, made: Automaton) -> None:
        for w in chunked(texts, ALNUM_FOLDED):
            self.n_words[w.first : w.first + len(w.lo)] = w.hi - w.lo
            if not len(vocabulary) or not len(w.hash):
                continue
            place = np.searchsorted(vocabulary, w.hash)
            known = place < len(vocabulary)
            known[known] = vocabulary[place[known]] == w.hash[known]
            known_to = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
            # runs of known words inside one text
            bounds = np.unique(np.concatenate((known_to, w.lo, w.hi)))
            run_lo, run_hi = bounds[:-1], bounds[1:]
            use = (run_hi - run_lo >= made.least) & known[np.minimum(run_lo, len(known) - 1)]
            run_lo, run_hi = run_lo[use], run_hi[use]
            text = np.searchsorted(w.hi, run_lo, "right")
            for a, b, t in zip(run_lo.tolist(), run_hi.tolist(), text.tolist(), strict=True):
                lo, n, row = int(w.lo[t]), int(w.hi[t] - w.lo[t]), w.first + t
                mine: set[str] = set()
                hit = np.zeros(b - a, bool)
                self.longest[row] = max(self.longest[row], made.scan((place[a:b] + 1).tolist(), hit, 0, mine))
                if mine:
                    whole = np.unpackbits(np.frombuffer(self.hits[row], np.uint8), count=n).astype(bool) if self.hits[row] else np.zeros(n, bool)
                    whole[a - lo : b - lo] |= hit
                    self.hits[row], self.n_hit[row] = np.packbits(whole).tobytes(), int(whole.sum())
                    self.items[row] = sorted(mine | set(self.items[row]))

    def columns(self) -> list[pa.Array]:
        return [pa.array(getattr(self, name), kind) for name, kind in _MARKS]


def _pass(folder: str, parts: int, at: int):
    def load(part: int) -> tuple[np.ndarray, Automaton]:
        path = file_of(folder, f"part-{part}")  # a part may be empty
        if path is None:
            return np.zeros(0, np.uint64), Automaton(1)
        with open(path, "rb") as f:
            return pickle.load(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = None
        for batch in gathered(batches, at, GATHER_BYTES):
            marks = _Marks(batch.num_rows)
            for part in range(parts):
                if loaded is None or parts > 1:
                    loaded = None  # the one before goes first
                    loaded = load(part)
                marks.add(batch.column(at), *loaded)
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks.columns()], names=[*batch.schema.names, *(name for name, _ in _MARKS)])

    return run


def _spans(hits: bytes | None, n: int) -> np.ndarray:
    """(first, one past last) of each run of hit words."""
    if not hits:
        return np.zeros((0, 2), np.int64)
    bit = np.unpackbits(np.frombuffer(hits, np.uint8), count=n).astype(np.int8)
    return np.flatnonzero(np.diff(np.concatenate(([0], bit, [0])))).reshape(-1, 2)


def scan(docs: DataFrame, items: DataFrame, text_column: str = "text", window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """docs with n_words, n_hit, longest (words of the longest match), items (array, sorted) and hits (a bit for each word)."""
    rows, restore = shielded(docs, [text_column])
    folder, parts = automata(items, window, part_words)
    number = T.LongType()
    found = [("n_words", number), ("n_hit", number), ("longest", number), ("items", T.ArrayType(T.StringType())), ("hits", T.BinaryType())]
    schema = T.StructType([T.StructField(n, t, True) for n, t in [*((f.name, f.dataType) for f in rows.schema), *found]])
    return restore(rows.mapInArrow(_pass(folder, parts, rows.columns.index(text_column)), schema))


def clean(docs: DataFrame, items: DataFrame, text_column: str = "text", window: int = WINDOW, coverage_limit: float = 1.0) -> DataFrame:
    """docs without the hit spans; a document of which more than coverage_limit of the words is hit goes altogether.

    A span goes from the first letter of its first word to the last of its last; what stands around it is joined by one blank.
    """
    rows, restore = shielded(docs, [text_column])
    marked = scan(rows, items, text_column, window)
    kept = marked.filter(F.col("n_hit") <= F.lit(coverage_limit) * F.col("n_words"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            hits = batch.column(batch.schema.get_field_index("hits")).to_pylist()
            texts = batch.column(at).to_pylist()
            for w in chunked(batch.column(at), ALNUM_FOLDED):
                for i in range(len(w.lo)):
                    row = w.first + i
                    if not hits[row]:
                        continue
                    raw, base, pieces, done = bytes(w.data[w.text_at[i] : w.text_at[i + 1]]), w.text_at[i], [], 0
                    for a, b in _spans(hits[row], int(w.hi[i] - w.lo[i])):
                        pieces.append(raw[done : w.start[w.lo[i] + a] - base])
                        done = w.end[w.lo[i] + b - 1] - base
                    texts[row] = b" ".join(p.strip() for p in [*pieces, raw[done:]] if p.strip()).decode()
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept.schema])
    return restore(kept.mapInArrow(cut, schema).drop("n_words", "n_hit", "longest", "items", "hits"))
