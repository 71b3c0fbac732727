"""Interpolated modified Kneser-Ney model of any order from 2 on (Chen and Goodman, 1999), counted in Spark.

The model is a set of sorted arrays in files of the shared folder, which workers map into memory to score texts:

* vocabulary: 64-bit hashes of the training tokens, sorted, in shards by the hash's leading bits. A token's number is made of its place in
  its shard by falling count and of the shard, so frequent tokens have small numbers, which pack well. By number lie its count and, once
  the pairs are counted, how many distinct contexts it follows.
* for each order k from 2: sorted hashes of the k-grams, 48 bits each, and their counts: how often they occur at the highest order, how
  many distinct tokens stand before them at the others.
* for each order: sorted hashes of the contexts, with the sum of their k-grams' counts and how many of these are 1, 2, or more.

K-grams are counted as rows of 64-bit token numbers, so no bound on the vocabulary is built in; the files hold their hashes, where an unknown
k-gram is taken for a known one of its shard with a chance of SHARD_TOKENS / 2^48, one in 10^8, at most. A k-gram lies in the shard of its context; a context that, by its rarest token's count, may have very many
followers is split over several, and its sums are added up afterwards.

Every count covers all training texts; the model grows with the corpus. Each text is a sequence of tokens and one end token, preceded by
order - 1 start tokens. p(w|h) = (c(hw) - D) / c(h) + g(h) * p(w|h'), h' being h without its first token; p(w) is interpolated with
1 / (V + 1), one share being left to tokens outside the vocabulary. A context that was never seen leaves p(w|h').

Where the shared folder is a path on a shared mount, files are mapped in place; elsewhere a worker first fetches them to a folder of
its own, which goes when the worker ends. Files are written under a task's own name and then renamed, so a task may run twice.

Defined results: null and empty texts are one end token; repeated rows count each time; without training texts every score is
log10 of 1 / (V + 1) for each token, with V = 0; further columns are kept, those named like a result column replaced.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm.shared import delete, discard, file_of, new_folder, save, shielded, stored
from tallgrass.llm.words import BLANK_SPLIT_FOLDED, Words, chunked, mixed

ORDER = 3
#: Text that a task counts before it writes what it has, and that it scores at once.
COUNT_BYTES = 8 << 20
SCORE_BYTES = 4 << 20
#: Tokens for each shard of k-grams, and distinct tokens for each shard of the vocabulary, about.
SHARD_TOKENS = 2_000_000
VOCABULARY_SHARD = 1 << 17
#: Shards that a worker keeps mapped.
MOST_MAPPED = 4096
#: Stands for the end of a text in the vocabulary.
END_HASH = np.uint64(0x5DEECE66D1234567)
#: Numbers in k-grams: tokens of the vocabulary count from 1.
_START, _UNKNOWN = 0, -1
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    np.save(out := io.BytesIO(), array)
    save(folder, f"{name}.npy", out.getbuffer())


def _small(x: np.ndarray) -> np.ndarray:
    """In the least unsigned type that holds all values."""
    return x.astype(np.min_scalar_type(int(x.max()))) if x.size else x.astype(np.uint8)


def _save_keys(folder: str, name: str, h: np.ndarray) -> None:
    """Sorted 64-bit hashes as their leading 32 bits and the 16 after these."""
    _save(folder, f"{name}-high", (h >> np.uint64(32)).astype(np.uint32))
    _save(folder, f"{name}-low", (h >> np.uint64(16)).astype(np.uint16))


def _mapped(folder: str, name: str) -> np.ndarray | None:
    path = file_of(folder, f"{name}.npy")
    return None if path is None else np.asarray(np.load(path, mmap_mode="r"))


def _leading(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


class Vocabulary:
    """Numbers of tokens and their values, read from mapped files."""

    def __init__(self, folder: str, bits: int, texts: int) -> None:
        self.folder, self.bits, self.texts = folder, bits, texts
        self.files: dict[tuple[str, int], np.ndarray | None] = {}

    def file(self, name: str, shard: int) -> np.ndarray | None:
        if (name, shard) not in self.files:
            self.files[name, shard] = _mapped(self.folder, f"{name}-{shard}")
        return self.files[name, shard]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), _UNKNOWN, np.int64)
        shard = _leading(h, self.bits)
        for i in np.unique(shard).tolist():
            rows, known = np.flatnonzero(shard == i), self.file("hash", i)
            if known is not None and len(known):
                at = np.minimum(np.searchsorted(known, h[rows]), len(known) - 1)
                number = (self.file("place", i)[at].astype(np.int64) << self.bits | i) + 1
                out[rows] = np.where(known[at] == h[rows], number, _UNKNOWN)
        return out

    def shard_of(self, number: np.ndarray) -> np.ndarray:
        return (number - 1) & ((1 << self.bits) - 1)

    def place_of(self, number: np.ndarray) -> np.ndarray:
        return (number - 1) >> self.bits

    def value(self, name: str, number: np.ndarray) -> np.ndarray:
        """The named value of each number; 0 for start and unknown ones."""
        out = np.zeros(len(number), np.int64)
        shard = np.where(number > 0, self.shard_of(number), -1)
        for i in np.unique(shard[shard >= 0]).tolist():
            rows, values = np.flatnonzero(shard == i), self.file(name, i)
            if values is not None:
                out[rows] = values[self.place_of(number[rows])]
        return out

    def counts(self, number: np.ndarray) -> np.ndarray:
        """How often the token occurs; a start token once a text."""
        return np.where(number == _START, self.texts, self.value("count", number))


def _hash(grams: np.ndarray) -> np.ndarray:
    """A hash of each row of numbers (columns x rows)."""
    out = np.zeros(grams.shape[1], np.uint64)
    for column in grams:
        out = mixed(out * _STEP + column.astype(np.uint64))
    return out


def _shards(grams: np.ndarray, often: np.ndarray, part: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, hash of the context, and whether that is split, of each k-gram; often: how often each of its tokens occurs. A context is spread
    over one shard for each `part` times that its rarest token occurs, about."""
    context, pieces = _hash(grams[:-1]), often[:-1].min(axis=0) // part + 1
    own = np.where(pieces > 1, mixed(grams[-1].astype(np.uint64)) % pieces.astype(np.uint64), 0).astype(np.uint64)
    return ((context + own * _STEP) % np.uint64(shards)).astype(np.int64), context, pieces > 1


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end token after each text; and the number of tokens of each text."""
    n = w.hi - w.lo + 1
    out = np.full(n.sum(), END_HASH, np.uint64)
    out[np.arange(len(w.hash)) + w.text_of_word()] = w.hash
    return out, n


def _shifted(last: np.ndarray, at: np.ndarray, order: int, start: int) -> np.ndarray:
    """order x places: the values of the places up to each place of a text, `start` before its first."""
    out = np.full((order, len(last)), start, np.int64)
    out[-1] = last
    for back in range(1, order):
        out[-1 - back, back:] = np.where(at[back:] >= back, last[:-back], start)
    return out


def _grams(h: np.ndarray, n: np.ndarray, vocabulary: Vocabulary, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k-gram that ends at every place, as order x places numbers; the number of each distinct token, and which of these each place has."""
    kinds, place = np.unique(h, return_inverse=True)
    number = vocabulary.numbers(kinds)
    at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    return _shifted(number[place], at, order, _START), number, place


def _keys(grams: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The columns of numbers from 0 on in as few 64-bit keys as hold them, the first ones first, with the same order; and the bits of a number."""
    width = max(1, int(grams.max(initial=0)).bit_length())
    each, keys = max(1, 63 // width), []
    for i in range(0, len(grams), each):
        key = np.zeros(grams.shape[1], np.uint64)
        for column in grams[i : i + each]:
            key = key << np.uint64(width) | column.astype(np.uint64)
        keys.append(key)
    return keys, width


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-grams in order, and how often each is there."""
    keys, width = _keys(grams)
    if len(keys) > 1:
        return _merged(grams, np.ones(grams.shape[1], np.int64))
    key = np.sort(keys[0])
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    count, key, mask = np.diff(np.append(head, len(key))), key[head], np.uint64((1 << width) - 1)
    return np.stack([(key >> np.uint64(width * i) & mask).astype(np.int64) for i in reversed(range(len(grams)))]), count


def _merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-grams in order, with the sums of their counts."""
    keys, _ = _keys(grams)
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    grams = grams[:, order]
    new = np.ones(grams.shape[1], bool)
    new[1:] = (grams[:, 1:] != grams[:, :-1]).any(axis=0)
    head = np.flatnonzero(new)
    return grams[:, head], np.add.reduceat(counts[order], head) if len(head) else counts[:0]


def _by_shard(grams: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by shard, within a shard in the order they had."""
    order = np.argsort(shard.astype(np.min_scalar_type(int(shard.max(initial=0)))), kind="stable")
    return grams[:, order], counts[order], shard[order]


def _often(grams: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """How often each token of the k-grams occurs."""
    out = np.empty_like(grams)
    for i, column in enumerate(grams):
        kinds, place = np.unique(column, return_inverse=True)
        out[i] = vocabulary.counts(kinds)[place]
    return out


def _packed(x: np.ndarray) -> bytes:
    """Columns of numbers, the first as differences, byte planes apart: most planes are nearly empty."""
    x = x.copy()
    x[0, 1:] -= x[0, :-1].copy()
    planes = x.astype(np.int64).view(np.uint8).reshape(len(x), -1, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(raw: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(columns, 8, -1)
    x = planes.transpose(0, 2, 1).copy(order="C").view(np.int64).reshape(columns, -1)
    x[0] = np.cumsum(x[0])
    return x


_PARTS = "kind int, shard long, grams binary, h long, a long, b long, c long, d long"
_PART_TYPES = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
_NAMES = ["kind", "shard", "grams", "h", "a", "b", "c", "d"]
#: Kinds of parts: packed k-grams for a shard; sums of a split context; how many k-grams have count 1 to 4.
_PACKED, _SPLIT, _CLASSES = 0, 1, 2


def _part(kind: int, n: int, **columns) -> pa.Table:
    columns |= {"kind": np.full(n, kind, np.int32)}
    return pa.table([pa.array(columns[x], t) if x in columns else pa.nulls(n, t) for x, t in zip(_NAMES, _PART_TYPES, strict=True)], names=_NAMES)


def _packed_parts(grams: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.Table:
    """grams in order of shard."""
    at = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
    both = np.concatenate((grams, counts[None]))
    blobs = [_packed(both[:, a:b]) for a, b in zip(at, [*at, len(shard)][1:], strict=True)]
    return _part(_PACKED, len(at), shard=shard[at], grams=blobs)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in chunked(batch.column(0), BLANK_SPLIT_FOLDED, COUNT_BYTES):
            h, n = np.unique(_tokens(w)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


def _write_vocabulary(folder: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        h = table.column("h").to_numpy().view(np.uint64)
        n = table.column("n").to_numpy()
        order = np.argsort(h)
        h, n = h[order], n[order]
        often = np.argsort(-n, kind="stable")
        place = np.empty(len(h), np.int64)
        place[often] = np.arange(len(h))
        _save(folder, f"hash-{shard}", h)
        _save(folder, f"place-{shard}", _small(place))
        _save(folder, f"count-{shard}", _small(n[often]))
        return pa.table({"shard": [shard], "tokens": [int(n.sum())]})

    return run


def _count_grams(order: int, part: int, shards: int, *vocabulary_of):
    def run(batches):
        vocabulary = Vocabulary(*vocabulary_of)
        for batch in batches:
            for words in chunked(batch.column(0), BLANK_SPLIT_FOLDED, COUNT_BYTES):
                grams, number, _ = _grams(*_tokens(words), vocabulary, order)
                grams, count = _distinct(grams)
                known = np.sort(np.append(number, _START))
                often = vocabulary.counts(known)[np.searchsorted(known, grams)]
                yield from _packed_parts(*_by_shard(grams, count, _shards(grams, often, part, shards)[0])).to_batches()

    return run


def _write_grams(k: int, part: int, shards: int, *vocabulary_of):
    """Writes a shard of k-grams; gives what the next order counts, the sums of split contexts, and the classes of counts."""
    folder = vocabulary_of[0]

    def run(table: pa.Table) -> pa.Table:
        vocabulary, name = Vocabulary(*vocabulary_of), table.column("shard")[0].as_py()
        both = np.concatenate([_unpacked(x, k + 1) for x in table.column("grams").to_pylist()], axis=1)
        grams, count = _merged(both[:-1], both[-1])
        often = _often(grams, vocabulary)
        h = _hash(grams)
        order = np.argsort(h)
        _save_keys(folder, f"gram{k}-{name}", h[order])
        _save(folder, f"count{k}-{name}", _small(count[order]))
        _, context, split = _shards(grams, often, part, shards)
        head = np.flatnonzero((np.diff(grams[:-1], prepend=-2, axis=1) != 0).any(axis=0))
        sums = np.stack([np.add.reduceat(x.astype(np.int64), head) for x in (count, count == 1, count == 2, count >= 3)])
        context, split = context[head], split[head]
        own = np.flatnonzero(~split)
        own = own[np.argsort(context[own])]
        _save_keys(folder, f"context{k}-{name}", context[own])
        _save(folder, f"sums{k}-{name}", _small(sums[:, own]))
        out = [_part(_SPLIT, int(split.sum()), h=context[split].view(np.int64), **dict(zip("abcd", sums[:, split], strict=True)))]
        out.append(_part(_CLASSES, 1, **{x: [int((count == i).sum())] for i, x in enumerate("abcd", 1)}))
        shorter, before = _distinct(grams[1:])
        shard = _shards(shorter, _often(shorter, vocabulary), part, shards)[0] if k > 2 else vocabulary.shard_of(shorter[0])
        out.append(_packed_parts(*_by_shard(shorter, before, shard)))
        return pa.concat_tables(out)

    return run


def _write_split(folder: str):
    def run(table: pa.Table) -> pa.Table:
        k, shard = table.column("k")[0].as_py(), table.column("shard")[0].as_py()
        h = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        _save_keys(folder, f"split{k}-{shard}", h[order])
        _save(folder, f"splitsums{k}-{shard}", _small(np.stack([table.column(x).to_numpy() for x in "abcd"])[:, order]))
        return table.select(["shard"]).slice(0, 1)

    return run


def _write_after(*vocabulary_of):
    """How many distinct contexts each token of a shard of the vocabulary follows; gives their sum, and how many follow 1 to 4 and 3 or more."""

    def run(table: pa.Table) -> pa.Table:
        vocabulary, shard = Vocabulary(*vocabulary_of), table.column("shard")[0].as_py()
        number, count = np.concatenate([_unpacked(x, 2) for x in table.column("grams").to_pylist()], axis=1)
        out = np.bincount(vocabulary.place_of(number), weights=count, minlength=len(vocabulary.file("count", shard))).astype(np.int64)
        _save(vocabulary.folder, f"after-{shard}", _small(out))
        return pa.table({"total": [int(out.sum())], **{f"n{i}": [int((out == i).sum())] for i in (1, 2, 3, 4)}, "more": [int((out >= 3).sum())]})

    return run


@dataclass(frozen=True)
class Model:
    folder: str
    order: int
    bits: int
    tokens: int  # N
    types: int  # V
    texts: int
    pairs: int  # distinct pairs
    shards: int
    part: int
    discounts: tuple[tuple[float, float, float], ...]  # of k-grams with count 1, 2, more, from order 2 on
    low_discount: tuple[float, float, float]  # of tokens by their continuation counts
    low_counts: tuple[int, int, int]  # tokens with continuation count 1, 2, more


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many have count 1 to 4; where a class is empty, what keeps them in bounds."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [k - (k + 1) * y * up / n if n else k * y for k, n, up in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def train(texts: DataFrame, order: int = ORDER, shard_tokens: int = SHARD_TOKENS, vocabulary_shard: int = VOCABULARY_SHARD, folder: str | None = None) -> Model:
    """The model of all rows of texts(text). Its files go with the application, unless a folder of the caller's is given."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    folder = folder or new_folder(texts.sparkSession, "kneser-ney")
    rows = texts.select(F.col("text").cast("string").alias("text"))
    counted = stored(rows.mapInArrow(_count_tokens, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "tokens")
    distinct = counted.count()
    bits = max(0, (distinct // vocabulary_shard).bit_length())
    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    listed = stored(counted.withColumn("shard", shard).groupBy("shard").applyInArrow(_write_vocabulary(folder), "shard long, tokens long"), "shards")
    ends = counted.filter(F.col("h") == F.lit(int(END_HASH.view(np.int64)))).agg(F.sum("n")).first()[0] or 0
    discard(counted)
    total = listed.agg(F.sum("tokens")).first()[0] or 0
    shards, part = int(total // shard_tokens) + 1, max(1, shard_tokens // 4)
    vocabulary_of = (folder, bits, ends)
    packed, discounts, before = rows.mapInArrow(_count_grams(order, part, shards, *vocabulary_of), _PARTS), [], [listed]
    for k in range(order, 1, -1):
        parts = stored(packed.groupBy("shard").applyInArrow(_write_grams(k, part, shards, *vocabulary_of), _PARTS), f"grams{k}")
        discounts.insert(0, _discounts(*(x or 0 for x in parts.filter(F.col("kind") == _CLASSES).agg(*(F.sum(x) for x in "abcd")).first())))
        packed = parts.filter(F.col("kind") == _PACKED)
        discard(*before)
        before = [parts]
        split = parts.filter(F.col("kind") == _SPLIT).groupBy("h").agg(*(F.sum(x).alias(x) for x in "abcd"))
        split = split.withColumns({"k": F.lit(k), "shard": F.pmod("h", F.lit(shards))})
        split.groupBy("k", "shard").applyInArrow(_write_split(folder), "shard long").write.format("noop").mode("overwrite").save()
    after = stored(packed.groupBy("shard").applyInArrow(_write_after(*vocabulary_of), "total long, n1 long, n2 long, n3 long, n4 long, more long"), "after")
    low = [x or 0 for x in after.agg(*(F.sum(x) for x in after.columns)).first()]
    discard(after, *before)
    return Model(folder, order, bits, total, distinct, ends, low[0], shards, part, tuple(discounts), _discounts(*low[1:5]), (low[1], low[2], low[5]))


def _sum_by_text(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.cumsum(n) - n) if len(n) else np.zeros(0)


def _pick(number: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    """The discount for each count; 0 for count 0."""
    return np.array([0.0, *by])[np.minimum(number, 3)]


class _Arrays:
    """Values of hashes in the sharded arrays of a model."""

    def __init__(self, folder: str) -> None:
        self.folder, self.files = folder, {}

    def look_up(self, keys: str, values: str, h: np.ndarray, shard: np.ndarray, rows: int) -> np.ndarray:
        """rows x hashes; 0 where a hash is not known."""
        out = np.zeros((rows, len(h)), np.int64)
        order = np.argsort(shard.astype(np.min_scalar_type(int(shard.max(initial=0)))), kind="stable")
        cut = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist()
        for a, b in zip(cut, [*cut, len(h)][1:], strict=True):
            mine, s = order[a:b], int(shard[order[a]])
            mine = mine[np.argsort(h[mine])]  # neighbours are searched one after the other
            if len(self.files) > 2 * MOST_MAPPED:
                self.files.clear()
            if (keys, s) not in self.files:
                self.files[keys, s] = tuple(_mapped(self.folder, x) for x in (f"{keys}-{s}-high", f"{keys}-{s}-low", f"{values}-{s}"))
            high, low, found = self.files[keys, s]
            if high is None or not len(high):
                continue
            want_high, want_low = (h[mine] >> np.uint64(32)).astype(np.uint32), (h[mine] >> np.uint64(16)).astype(np.uint16)
            at = np.minimum(np.searchsorted(high, want_high), len(high) - 1)
            # of equal leading bits, which are few, the place of the next ones
            later = np.flatnonzero((high[at] == want_high) & (low[at] < want_low))
            while len(later):
                at[later] = np.minimum(at[later] + 1, len(high) - 1)
                later = later[(high[at[later]] == want_high[later]) & (low[at[later]] < want_low[later]) & (at[later] < len(high) - 1)]
            known = np.flatnonzero((high[at] == want_high) & (low[at] == want_low))
            out[:, mine[known]] = np.atleast_2d(found)[:, at[known]]
        return out


def _probabilities(model: Model, grams: np.ndarray, often: np.ndarray, arrays: _Arrays, low: np.ndarray) -> np.ndarray:
    """p of the last token of each k-gram, from its p without a context; often: how often each token of the k-grams occurs."""
    p = low
    for k in range(2, model.order + 1):
        seen = (grams[-k:-1] != _UNKNOWN).all(axis=0)
        use = slice(None) if seen.all() else np.flatnonzero(seen)
        mine, lower = grams[-k:, use], p[use]
        shard, context, split = _shards(mine, often[-k:, use], model.part, model.shards)
        known = np.flatnonzero(mine[-1] != _UNKNOWN)
        count = np.zeros(len(lower), np.int64)
        count[known] = arrays.look_up(f"gram{k}", f"count{k}", _hash(mine)[known], shard[known], 1)[0]
        # each context once
        kinds, place = np.unique(context, return_inverse=True)
        first = np.empty(len(kinds), np.int64)
        first[place] = np.arange(len(place))
        sums, apart = np.zeros((4, len(kinds)), np.int64), split[first]
        sums[:, ~apart] = arrays.look_up(f"context{k}", f"sums{k}", kinds[~apart], shard[first][~apart], 4)
        sums[:, apart] = arrays.look_up(f"split{k}", f"splitsums{k}", kinds[apart], np.mod(kinds[apart].view(np.int64), model.shards), 4)
        d = model.discounts[k - 2]
        mass = sum(x * n for x, n in zip(d, sums[1:], strict=True))[place]
        total = sums[0][place]
        found = np.where(total > 0, (count - _pick(count, d) + mass * lower) / np.maximum(total, 1), lower)
        p = p.copy()
        p[use] = found
    return p


def _score(model: Model, at: int):
    def run(batches):
        vocabulary, arrays = Vocabulary(model.folder, model.bits, model.texts), _Arrays(model.folder)
        uniform = 1.0 / (model.types + 1)
        left = sum(d * n for d, n in zip(model.low_discount, model.low_counts, strict=True))
        for batch in batches:
            results = [[], [], [], []]
            for words in chunked(batch.column(at), BLANK_SPLIT_FOLDED, SCORE_BYTES):
                h, n = _tokens(words)
                # by distinct token first: each is looked up once
                grams, kinds, place = _grams(h, n, vocabulary, model.order)
                count, after = vocabulary.value("count", kinds), vocabulary.value("after", kinds)
                at_text = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                often = _shifted(count[place], at_text, model.order, model.texts)
                low = (np.maximum(after - _pick(after, model.low_discount), 0) + left * uniform) / model.pairs if model.pairs else np.full(len(kinds), uniform)
                base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
                p = _probabilities(model, grams, often, arrays, low[place])
                results[0].append(n)
                results[1].append(_sum_by_text((count > 0).astype(np.int64)[place], n))
                results[2].append(_sum_by_text(base[place], n))
                results[3].append(_sum_by_text(np.log10(p), n))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            columns += [pa.array(np.concatenate(r) if r else [], t) for r, t in zip(results, types, strict=True)]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, n_known, base_score, score (log10) and perplexity."""
    rows, restore = shielded(docs, [text_column])
    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema if f.name != text_column]
    fields += [T.StructField(x, t) for x, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))]
    scored = rows.mapInArrow(_score(model, rows.columns.index(text_column)), T.StructType(fields))
    return restore(scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))


def forget(spark: SparkSession, model: Model) -> None:
    """Deletes the model's files."""
    delete(spark, model.folder)
