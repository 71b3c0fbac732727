"""Substring dedup by super-k-mer partitioning (the partitioning of k-mer counters such as KMC and MSPKmerCounter).

A window is K consecutive words. Its minimiser is the least hash among the M-word runs in it; consecutive windows of a text that
share their minimiser travel as one packed string, of MOST_WINDOWS at most, to the minimiser's bucket. There the words of all strings are hashed again, the
windows are sorted, and a window that also starts in a document with a smaller id is reported back to its document.

Buckets are sized by the input's characters. Before anything travels, a pass counts what each bucket would get; the windows of a
bucket beyond HOT_STRINGS or HOT_WINDOWS (a passage that very many documents share, or a phrase that texts repeat) travel one by one instead, are reduced to their smallest id
with a map-side combine, and are joined back. Both ways give the same answer for every window.

What is found goes back to (id, hash of the text), so rows that share an id, or have none, each get what was found in their own text,
and no id gathers the finds of many texts. A find carries a sum over all its windows, which the text must match.

Windows count as equal if all their words' 64-bit hashes are. Defined results: null and empty texts have no words and lose none; a
null id is larger than any other, so it removes nothing elsewhere; rows of one id never remove each other's words, and each is
judged by its own text; an empty table gives an empty result; further columns are kept by `dedup`, those named like a result column
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm.shared import NO_ID, join_counted, shielded, stored
from tallgrass.llm.words import BLANK_SPLIT, Words, chunked, hashes_of, mixed, run_hashes

K = 13
M = 2
BUCKET_CHARS = 1 << 20
HOT_STRINGS = 200_000
#: A task that judges a bucket holds about fifteen numbers for each window.
HOT_WINDOWS = 2_000_000
#: Windows of one string; more of them, as a repeated phrase makes, are cut.
MOST_WINDOWS = 4096
#: Text that one task packs before it writes a blob to each bucket.
PACK_BYTES = 8 << 20


def super_kmers(w: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each maximal run of windows of one text with one minimiser: first word, number of windows, minimiser."""
    n = len(w.hash) - k + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64)
    least, span, want = run_hashes(w.hash, m), 1, k - m + 1
    while span * 2 <= want:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < want:
        least = np.minimum(least[: -(want - span)], least[want - span :])
    text = w.text_of_word()
    inside = text[:n] == text[k - 1 :]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1] | (text[1:n] != text[: n - 1])
    first = np.flatnonzero(inside & new)
    edges = np.append(np.flatnonzero(new | ~inside), n)
    count = edges[np.searchsorted(edges, first, "right")] - first
    return first, count, least[first]


def _cut(first: np.ndarray, count: np.ndarray, minimiser: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of more than `most` windows as several, which together have the same windows."""
    parts = -(-count // most)
    if not len(parts) or parts.max() == 1:
        return first, count, minimiser
    skip = most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return np.repeat(first, parts) + skip, np.minimum(np.repeat(count, parts) - skip, most), np.repeat(minimiser, parts)


def _bucket(minimiser: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(minimiser) % np.uint64(buckets)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch], k: int, m: int, buckets: int):
    for batch in batches:
        ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        for w in chunked(batch.column(1), BLANK_SPLIT, PACK_BYTES):
            first, count, minimiser = _cut(*super_kmers(w, k, m), MOST_WINDOWS)
            yield ids, keys, w, first, count, _bucket(minimiser, buckets)


def _count(k: int, m: int, buckets: int):
    def run(batches):
        for *_, count, bucket in _rows(batches, k, m, buckets):
            b, at, n = np.unique(bucket, return_inverse=True, return_counts=True)
            windows = np.zeros(len(b), np.int64)
            np.add.at(windows, at, count)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(n.astype(np.int64)), pa.array(windows)], ["bucket", "n", "windows"])

    return run


def _key() -> Column:
    """32 bits of the text's hash: with the id they name a text well enough, as finds are checked against the text."""
    return F.shiftright(F.xxhash64(F.coalesce("text", F.lit(""))), 32)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers, byte planes apart: most planes are nearly empty."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.stack(columns).astype(np.int64).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).tobytes())


def _unpacked(raw: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(columns, -1)


def _pack(k: int, m: int, buckets: int, hot: np.ndarray):
    squeeze = lambda x: zstandard.ZstdCompressor(level=3).compress(x)

    def run(batches):
        for ids, keys, w, first, count, bucket in _rows(batches, k, m, buckets):
            use = ~np.isin(bucket, hot)
            first, count, bucket = first[use], count[use], bucket[use]
            order = np.argsort(bucket, kind="stable")
            first, count, bucket = first[order], count[order], bucket[order]
            text = np.searchsorted(w.hi, first, "right")
            doc, place, key = ids[w.first + text].astype(np.int64), first - w.lo[text], keys[w.first + text]
            raw, a, b = bytes(w.data), w.start[first].tolist(), w.end[first + count + k - 2].tolist()
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            out = []
            for lo, hi in zip(at.tolist(), [*at.tolist(), len(bucket)][1:], strict=True):
                numbers = _packed(doc[lo:hi], key[lo:hi], place[lo:hi], count[lo:hi])
                out.append((int(bucket[lo]), hi - lo, numbers, squeeze(b"\n".join([raw[x:y] for x, y in zip(a[lo:hi], b[lo:hi], strict=True)]))))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "n", "numbers", "words"])

    return run


def _running(check: np.ndarray) -> np.ndarray:
    """Running sums of the windows' mixed hashes, from 0: the difference of two tells what stands between them."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(check), dtype=np.uint64)))


def _runs(doc: np.ndarray, key: np.ndarray, place: np.ndarray, check: np.ndarray, hit: np.ndarray, string: np.ndarray) -> pa.Table:
    """Hit windows as runs of neighbours from one string: doc, key, first, n, check (a sum over the windows). Strings of equal rows, with one id
    and text, give the same runs: each once."""
    at = np.flatnonzero(hit)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (string[at[1:]] != string[at[:-1]])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(at)))
    at, running = at[head], _running(check)
    found = np.stack((doc[at], key[at], place[at], n, (running[at + n] - running[at]).view(np.int64)))
    found = found[:, np.lexsort(found)]
    found = found[:, np.concatenate((np.ones(min(1, len(at)), bool), (found[:, 1:] != found[:, :-1]).any(axis=0)))]
    return pa.table([pa.array(c) for c in found], names=["doc", "key", "first", "n", "check"])


_HITS = "doc long, key long, first long, n long, check long"


def _judge(k: int):
    def run(table: pa.Table) -> pa.Table:
        grow = zstandard.ZstdDecompressor().decompress
        numbers = np.concatenate([_unpacked(x, 4) for x in table.column("numbers").to_pylist()], axis=1)
        h = np.concatenate([hashes_of(grow(x), BLANK_SPLIT) for x in table.column("words").to_pylist()])
        doc, key, place, count = numbers
        string = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(np.cumsum(count + k - 1) - (count + k - 1), count) + step
        check = run_hashes(h, k)[at]
        owner = doc[string]
        order = np.argsort(check, kind="stable")
        same = check[order[1:]] == check[order[:-1]]
        group = np.concatenate(([0], np.cumsum(~same)))
        size = np.bincount(group)
        many = size[group] > 1
        order, group = order[many], group[many]
        if not len(order):
            return _runs(owner, key[string], place[string] + step, check, np.zeros(len(string), bool), string)
        # windows with equal hashes are told apart by all their words
        lead = order[np.searchsorted(group, group)]
        same = np.ones(len(order), bool)
        for j in range(k):
            same &= h[at[order] + j] == h[at[lead] + j]
        if not same.all():
            whole = np.stack([h[at[order] + j] for j in range(k)], axis=1)
            _, group = np.unique(whole, axis=0, return_inverse=True)
            again = np.argsort(group, kind="stable")
            order, group = order[again], group[again]
        head = np.flatnonzero(np.diff(group, prepend=-1))
        least = np.repeat(np.minimum.reduceat(owner[order], head), np.diff(np.append(head, len(order))))
        hit = np.zeros(len(string), bool)
        hit[order] = owner[order] > least
        return _runs(owner, key[string], place[string] + step, check, hit, string)

    return run


def _single(k: int, m: int, buckets: int, hot: np.ndarray):
    def run(batches):
        for ids, keys, w, first, count, bucket in _rows(batches, k, m, buckets):
            use = np.isin(bucket, hot)
            first, count = first[use], count[use]
            at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            text = np.searchsorted(w.hi, at, "right")
            one, two = run_hashes(w.hash, k)[at], run_hashes(w.hash, k, salt=1)[at]
            columns = [ids[w.first + text], keys[w.first + text], at - w.lo[text], one.view(np.int64), two.view(np.int64), mixed(one).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], ["doc", "key", "first", "one", "two", "check"])

    return run


def hits(docs: DataFrame, k: int = K, m: int = M, bucket_chars: int = BUCKET_CHARS, hot_strings: int = HOT_STRINGS, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """doc, key, first, n, check: runs of n windows of text `key` of document doc, from word `first` on, that also start in a document
    with a smaller id."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text"), _key().alias("key"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(chars // bucket_chars) + 1
    loads = rows.mapInArrow(_count(k, m, buckets), "bucket long, n long, windows long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows"))
    # at most (all strings / hot_strings) + (all windows / hot_windows) buckets: a few numbers
    loads = loads.filter((F.col("n") > hot_strings) | (F.col("windows") > hot_windows))
    hot = np.array(sorted(r.bucket for r in loads.toLocalIterator()), np.int64)
    packed = rows.mapInArrow(_pack(k, m, buckets, hot), "bucket long, n long, numbers binary, words binary")
    found = packed.groupBy("bucket").applyInArrow(_judge(k), _HITS)
    if len(hot):
        windows = stored(rows.mapInArrow(_single(k, m, buckets, hot), "doc long, key long, first long, one long, two long, check long"), "hot-windows")
        sums = windows.groupBy("one", "two").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n")).filter(F.col("least") < F.col("most"))
        least = stored(sums.select(F.struct("one", "two").alias("window"), "least", "n"), "hot-least")
        again = join_counted(windows.withColumn("window", F.struct("one", "two")), least, "window", "n", windows.count()).filter(F.col("doc") > F.col("least"))
        found = found.unionByName(again.select("doc", "key", "first", F.lit(1).cast("long").alias("n"), "check").distinct())
    return found


def _apply(k: int, id_at: int, text_at: int, hits_at: int, with_text: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column(text_at)
            raw_hits = batch.column(hits_at)
            n_words, n_removed, kept_texts, digests = [], [], [], []
            for w in chunked(texts, BLANK_SPLIT):
                running = None
                for i in range(len(w.lo)):
                    words = bytes(w.data[w.text_at[i] : w.text_at[i + 1]]).split()
                    n = len(words)
                    n_words.append(n)
                    removed = np.zeros(n + 1, np.int64)
                    if raw_hits[w.first + i].is_valid:
                        running = _running(run_hashes(w.hash, k)) if running is None else running
                        first, runs, check = (f.to_numpy(zero_copy_only=False) for f in raw_hits[w.first + i].values.flatten())
                        fits = first + runs + k - 1 <= n
                        first, runs, check = first[fits], runs[fits], check[fits]
                        at = w.lo[i] + first
                        # else it is of another text with this id and key
                        mine = (running[at + runs] - running[at]).view(np.int64) == check
                        np.add.at(removed, first[mine], 1)
                        np.add.at(removed, first[mine] + runs[mine] + k - 1, -1)
                        gone = np.cumsum(removed[:n]) > 0
                        n_removed.append(int(gone.sum()))
                        words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                    else:
                        n_removed.append(0)
                    kept = b" ".join(words)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        kept_texts.append(kept.decode())
            columns = [c for j, c in enumerate(batch.columns) if j != hits_at and (with_text or j != text_at)]
            names = [c for j, c in enumerate(batch.schema.names) if j != hits_at and (with_text or j != text_at)]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            if with_text:
                columns.append(pa.array(kept_texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return run


def dedup(docs: DataFrame, k: int = K, m: int = M, bucket_chars: int = BUCKET_CHARS, hot_strings: int = HOT_STRINGS, with_text: bool = True, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """docs(doc_id, text, ...) with n_words, n_removed, kept_sha256 and, with_text, kept_text (kept words joined by one blank; else text goes too)."""
    rows, restore = shielded(docs, ["doc_id", "text"])
    found = hits(rows, k, m, bucket_chars, hot_strings, hot_windows)
    mine = found.groupBy("doc", "key").agg(F.collect_list(F.struct("first", "n", "check")).alias("hits"))
    keyed = rows.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "key": _key()})
    joined = keyed.join(mine, ["doc", "key"], "left").select(*rows.columns, "hits")
    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema if with_text or f.name != "text"]
    fields += [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept_text", T.StringType())] * with_text
    names = joined.columns
    return restore(joined.mapInArrow(_apply(k, names.index("doc_id"), names.index("text"), names.index("hits"), with_text), T.StructType(fields)))
