"""N-gram Jaccard self-join: overlaps of a sparse document by shingle matrix, built up block by block, with bounds from set sizes.

A document's set holds its distinct N-word shingles (the whole sequence if it has fewer words). Documents link at similarity >= 0.8.

1. Equal sets collapse into one node (their 128-bit sum), so copies cost one row each.
2. Column blocks of the incidence matrix. If two sets of sizes a <= b link, they share at least 0.8 b shingles; so if each lists the
   least of its shingles by hash, 20 % and L more, both lists share at least L(a). Every list is cut by hash into blocks; a block
   counts, for each document, its listed shingles that another set lists too. A batch settles the shingles that two of its own sets
   list and sends each at most once, so a shingle in very many documents is a few rows. Documents whose count stays below the
   bound have no partner and leave.
3. Which entries of the product to compute: postings of the rarest shingles of each set (frequent ones never lead, as the order is by
   document frequency), each with the largest size of a set it can still link with. Each posting list meets its pivot, the member
   with the most frequent shingles. In lists whose members are then still in different components, those outside the largest one
   meet all others that the sizes allow.
4. The product at these entries. Sets are cut into PRODUCT_BLOCKS ranges of hashes; block after block, the overlaps of a pair within the
   block are added to its count, and pairs leave once the count and all that the blocks to come can add stay below the bound
   that the two sizes set. What is left after the last block are the links, with their exact overlaps.
5. Links become components; each document gets the smallest id of its component.

A shingle with more than HOT_SHARE of all entries is broadcast instead of shuffled, so no shingle gathers its documents in one task.

Shingles are compared by 64-bit hashes. Defined results: null, empty and blank texts have size 0, link with nothing and are their
own component; repeated rows and equal sets are one component; a null id counts as larger than any other, and a component
of null ids only has component_id null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm.shared import BROADCAST_ROWS, NO_ID, discard, freed, join_counted, stored
from tallgrass.llm.words import BLANK_SPLIT_FOLDED, Words, chunked, mixed, run_hashes

SHINGLE = 5
#: Similarity in percent.
PERCENT = 80
#: Shingles of one block of columns, about.
BLOCK_SHINGLES = 100_000
#: More blocks than these only once each holds ten times BLOCK_SHINGLES: every batch sends a piece to each block, so the pieces of small
#: blocks would shrink, and their number grow with the square of the rows.
MANY_BLOCKS = 512
#: Blocks of columns in which overlaps add up.
PRODUCT_BLOCKS = 3
PACK_BYTES = 8 << 20
#: Up to this many bits (32 MB) the ids still of interest are broadcast as a bitmap; beyond, texts meet them in a join.
MOST_BITS = 1 << 28


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the distinct shingles of all texts of a chunk, sorted by text, then hash."""
    size = w.hi - w.lo
    text = w.text_of_word()
    full = np.flatnonzero(text[: max(0, len(text) - n + 1)] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
    h, owner = run_hashes(w.hash, n)[full] if len(full) else np.zeros(0, np.uint64), text[full]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        rest = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            on = size[short] > j
            rest[on] = mixed(rest[on] * np.uint64(0x9E3779B97F4A7C15) + w.hash[w.lo[short][on] + j])
        h, owner = np.concatenate((h, mixed(rest + size[short].astype(np.uint64)))), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    # text by text, in place: many times faster than a sort by both
    head = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
    for a, b in zip(head, [*head, len(h)][1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def _set_keys(owner: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two sums of mixed hashes of each set."""
    size = np.bincount(owner, minlength=texts)
    head, full = np.cumsum(size) - size, size > 0
    sums = []
    for salt in (0x1234567, 0x89ABCDEF1):
        s = np.zeros(texts, np.uint64)
        if len(h):
            s[full] = np.add.reduceat(mixed(h + np.uint64(salt)), head[full])
        sums.append(mixed(s + size.astype(np.uint64)))
    return size, sums[0], sums[1]


def least_overlap(size, percent: int = PERCENT):
    """The least overlap of a set of this size with any set it links with."""
    return -(-percent * size // 100)


def _extra(size):
    """L: how many more shingles a list has than a bare prefix, and the overlap that two lists then must show."""
    return -(-size // 10)


def _survey(n: int, percent: int, blocks: int):
    squeeze = lambda x: zstandard.ZstdCompressor(level=1).compress(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in chunked(batch.column(1), BLANK_SPLIT_FOLDED, PACK_BYTES):
                texts = len(w.lo)
                owner, h = shingle_sets(w, n)
                size, one, two = _set_keys(owner, h, texts)
                doc = ids[w.first : w.first + texts].astype(np.int64)
                # one document stands for each set of the chunk
                _, lead = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True) if texts else (None, np.zeros(0, np.int64))
                first = np.zeros(texts, bool)
                first[lead] = True
                rank = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                length = size - least_overlap(size, percent) + _extra(size)
                use = (rank < length[owner]) & first[owner]
                h, owner = h[use], owner[use]
                order = np.argsort(h, kind="stable")
                h, owner = h[order], owner[order]
                head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.append(head, len(h)))
                known = np.repeat(times > 1, times)  # two sets of this chunk list it
                count = np.bincount(owner[known], minlength=texts)
                # the chunk's documents, under a number below 0 that no block has
                seen = np.stack([doc, size, one.view(np.int64), two.view(np.int64), count, first])
                out = [(-1 - int(one[0] % np.uint64(blocks)), seen.astype(np.int64).tobytes(), b"", b"")]
                h, owner, many = h[head], owner[head], times > 1
                block = (mixed(h) % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                # 32 bits tell apart the about BLOCK_SHINGLES of a block; one mistaken for another only keeps a set for step 3
                h, owner, many, block = (h[order] >> np.uint64(32)).astype(np.uint32), owner[order], many[order], block[order]
                at = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
                for a, b in zip(at, [*at, len(block)][1:], strict=True):
                    near, place = np.unique(owner[a:b], return_inverse=True)
                    sets = np.concatenate((doc[near], one[near].view(np.int64)))
                    out.append((int(block[a]), squeeze(sets.tobytes()), h[a:b].tobytes(), squeeze(np.where(many[a:b], -1, place).astype(np.int32).tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _SENT.values(), strict=True)], names=list(_SENT))

    return run


_SENT = {"block": pa.int64(), "sets": pa.binary(), "hashes": pa.binary(), "places": pa.binary()}
_SURVEY = {"doc": pa.int64(), "size": pa.int64(), "one": pa.int64(), "two": pa.int64(), "count": pa.int64(), "first": pa.bool_(), "n": pa.int64()}


def _settled(table: pa.Table) -> pa.Table:
    """Of a number below 0 the documents of its chunks (without n), of a block its counts (doc, one, n only)."""
    if table.column("block")[0].as_py() >= 0:
        found = _count_block(table)
    else:
        seen = np.concatenate([np.frombuffer(x, np.int64).reshape(6, -1) for x in table.column("sets").to_pylist()], axis=1)
        found = {k: pa.array(x).cast(_SURVEY[k]) for k, x in zip(_SURVEY, seen, strict=False)}
    rows = len(found["doc"])
    return pa.table([pa.array(found[k], t) if k in found else pa.nulls(rows, t) for k, t in _SURVEY.items()], names=list(_SURVEY))


def _count_block(table: pa.Table) -> dict[str, np.ndarray]:
    """For each set of a block, how many of the shingles it sent another set lists too."""
    grow = zstandard.ZstdDecompressor().decompress
    docs, ones, hashes, sets, base = [], [], [], [], 0
    for packed, h, places in zip(*(table.column(x).to_pylist() for x in ("sets", "hashes", "places")), strict=True):
        doc, one = np.frombuffer(grow(packed), np.int64).reshape(2, -1)
        place = np.frombuffer(grow(places), np.int32).astype(np.int64)
        docs.append(doc), ones.append(one), hashes.append(np.frombuffer(h, np.uint32))
        sets.append(np.where(place < 0, -1, place + base))
        base += len(doc)
    doc, one, h, owner = map(np.concatenate, (docs, ones, hashes, sets))
    kind = np.where(owner < 0, 0, one[owner])
    order = np.argsort(h, kind="stable")
    h, owner, kind = h[order], owner[order], kind[order]
    head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    times = np.diff(np.append(head, len(h)))
    # listed by sets of two kinds: one chunk said so, or the sets that sent it differ
    several = np.logical_or.reduceat(owner < 0, head) | (np.minimum.reduceat(kind, head) != np.maximum.reduceat(kind, head))
    found = owner[np.repeat(several, times) & (owner >= 0)]
    near, n = np.unique(found, return_counts=True)
    return {"doc": doc[near], "one": one[near], "n": n.astype(np.int64)}


def _sets(n: int, bitmap):
    def run(batches):
        for batch in batches:
            if bitmap is not None:
                at = batch.column(2).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array((bitmap.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            for w in chunked(batch.column(1), BLANK_SPLIT_FOLDED):
                owner, h = shingle_sets(w, n)
                size, one, _ = _set_keys(owner, h, len(w.lo))
                # hashes are sorted within a set, so a block of them is a slice of each
                block = (h >> np.uint64(32)) * np.uint64(PRODUCT_BLOCKS) >> np.uint64(32)
                lists, lengths = [], []
                for b in range(PRODUCT_BLOCKS):
                    mine = block == b
                    length = np.bincount(owner[mine], minlength=len(w.lo))
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(h[mine].view(np.int64))))
                    lengths.append(pa.array(length.astype(np.int64)))
                names = ["node", "size", *(f"n{b}" for b in range(PRODUCT_BLOCKS)), *(f"shingles{b}" for b in range(PRODUCT_BLOCKS))]
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(size.astype(np.int64)), *lengths, *lists], names)

    return run


def _bitmap(ids: DataFrame, column: str, bits: int):
    """A bit for each hash of an id modulo bits, put together from segments of 2^23 bits; the size is bounded by MOST_BITS."""
    import pandas as pd

    def segment(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << 20, np.uint8)
        at = rows["at"].to_numpy() & ((1 << 23) - 1)
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pd.DataFrame({"segment": rows["segment"].iloc[:1], "bytes": [out.tobytes()]})

    places = ids.select(F.pmod(F.xxhash64(column), F.lit(bits)).alias("at")).distinct().withColumn("segment", F.shiftright("at", 23))
    whole = np.zeros(max(bits >> 3, 1 << 20), np.uint8)
    for r in places.groupBy("segment").applyInPandas(segment, "segment long, bytes binary").toLocalIterator():
        whole[r.segment << 20 : (r.segment + 1) << 20] = np.frombuffer(r.bytes, np.uint8)
    return whole


def sets_of(docs: DataFrame, alive: DataFrame, shingle: int) -> DataFrame:
    """node, size and, for each block, how many shingles it has and which, of the documents alive and of few more: those whose ids share
    a bit with theirs."""
    n = alive.count()
    bits = min(1 << max(23, (48 * n).bit_length()), MOST_BITS)
    if 12 * n < bits:
        sent = docs.sparkSession.sparkContext.broadcast(_bitmap(alive, "doc", bits))
        rows = docs.select("doc", "text", F.pmod(F.xxhash64("doc"), F.lit(bits)).alias("at"))
    else:
        sent, rows = None, docs.join(alive.select("doc").distinct(), "doc", "left_semi").select("doc", "text")
    blocks = range(PRODUCT_BLOCKS)
    return rows.mapInArrow(_sets(shingle, sent), ", ".join(["node long, size long", *(f"n{b} long" for b in blocks), *(f"shingles{b} array<long>" for b in blocks)]))


def one_row_each(sets: DataFrame) -> DataFrame:
    """sets(node, ...) with one row a node, stored. Rows repeated, and copies of a document alive that share a bit with one, would
    otherwise multiply each pair of their set, in every block of the product."""
    sets = stored(sets.withColumn("place", F.monotonically_increasing_id()), "sets")
    first = sets.groupBy("node").agg(F.min("place").alias("place"))
    more = stored(sets.select("place").join(first.select("place"), "place", "left_anti"), "further-rows")
    n = more.count()
    if n <= BROADCAST_ROWS:
        return (sets.join(F.broadcast(more), "place", "left_anti") if n else sets).drop("place")
    out = stored(sets.join(more.hint("merge"), "place", "left_anti").drop("place"), "sets")
    discard(sets, more)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, root of all nodes of links(a, b): root is the smallest node of the component. Large-star and small-star rounds until nothing
    changes."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        near = both(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = stored(small.filter("a <> b").distinct(), "edges")
        discard(edges, large)
        edges = now
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().join(roots.select("node"), "node", "left_anti"))


def _counted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) those that link, with their overlap: the product's entries, added up block by block. The sets move to the pairs at
    any size of these, so plans stay alike."""
    done, now = [], pairs.withColumn("overlap", F.lit(0).cast("long"))
    for b in range(PRODUCT_BLOCKS):
        later = [f"n{x}" for x in range(b + 1, PRODUCT_BLOCKS)]
        rest = sum((F.col(x) for x in later), F.lit(0).cast("long"))
        side = lambda name, b=b, rest=rest: sets.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), rest.alias(f"rest_{name}"), F.col(f"shingles{b}").alias(f"of_{name}"))
        met = now.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
        met = met.withColumn("overlap", F.col("overlap") + F.size(F.array_intersect("of_a", "of_b")))
        most = F.col("overlap") + F.least("rest_a", "rest_b")
        met = met.filter(100 * most >= percent * (F.col("size_a") + F.col("size_b") - most)).select("a", "b", "overlap")
        if later:
            done.append(now := stored(met, "overlaps"))
    found = stored(met, "links")
    discard(*done)
    return found


def _can_link() -> Column:
    """Each is within the reach of the other's posting, and not itself."""
    return (F.col("size_a") <= F.col("reach_b")) & (F.col("size_b") <= F.col("reach_a")) & (F.col("a") != F.col("b"))


def blocks_for(listed: int, block_shingles: int = BLOCK_SHINGLES) -> int:
    """Blocks for so many listed shingles."""
    return int(max(min(listed // block_shingles, MANY_BLOCKS), listed // (10 * block_shingles))) + 1


def survey(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """All documents (doc, size, one, two); and of the sets that may have a partner one document each (doc, one). Both are stored."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = blocks_for(chars // 20, block_shingles)  # about a listed shingle for 20 characters
    sent = docs.mapInArrow(_survey(shingle, percent, blocks), "block long, sets binary, hashes binary, places binary")
    # the documents travel with the blocks, so one pass over the texts and no copy of the lists will do
    seen = stored(sent.groupBy("block").applyInArrow(_settled, "doc long, size long, one long, two long, count long, first boolean, n long"), "survey")
    rows = stored(seen.filter(F.col("first").isNotNull()).drop("n"), "documents")
    counts = seen.filter(F.col("n").isNotNull()).groupBy("doc", "one").agg(F.sum("n").alias("n"))
    size = F.col("size")
    up = lambda x, by: F.floor((x + (by - 1)) / by)
    needed = up(up(percent * size, 100), 10)
    led = rows.filter(F.col("first") & (size > 0))
    alive = led.join(counts, ["doc", "one"], "left").filter(F.col("count") + F.coalesce("n", F.lit(0)) >= needed)
    alive = stored(alive.groupBy("one").agg(F.min("doc").alias("doc")), "alive")
    discard(seen)
    return rows.select("doc", "size", "one", "two"), alive


def links(docs: DataFrame, alive: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """a, b, overlap: links that join the same sets as all links do. docs(doc, text); alive(doc, one)."""
    sets = one_row_each(sets_of(docs, alive, shingle))
    entries = sets.select("node", "size", F.explode(F.concat(*(f"shingles{b}" for b in range(PRODUCT_BLOCKS)))).alias("shingle"))
    often = stored(entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "frequencies")
    n = sets.agg(F.sum("size")).first()[0] or 0
    of_node = [F.sort_array(F.collect_set(F.struct("df", "shingle"))).alias("own"), F.avg(F.log("df")).alias("often")]
    own = join_counted(entries, often, "shingle", "df", n).groupBy("node", "size").agg(*of_node)
    # If the first shared shingle of two sets stands at place i of one of them, by document frequency, they share at most its size - i;
    # linking takes percent / (100 + percent) of both sizes. So a posting reaches sets up to a certain size only, and less far the
    # later it stands: frequent shingles, which come last, do not bring sets together that have much else besides them.
    shared = F.size("own").cast("long")
    weight = F.col("often") * shared / F.col("size")
    # places from shared - percent * size on fail the filter below
    head = F.slice("own", F.lit(1), F.greatest(shared - F.floor(F.col("size") * percent / 100) + 1, F.lit(0)).cast("int"))
    lead = own.select("node", "size", shared.alias("shared"), weight.alias("weight"), F.posexplode(head).alias("at", "x"))
    reach = F.call_function("div", (F.col("shared") - F.col("at")) * F.lit(100 + percent), F.lit(percent)) - F.col("size")
    lead = lead.select(F.col("x.shingle").alias("shingle"), "node", "size", "weight", reach.cast("long").alias("reach"))
    lead = stored(lead.filter(100 * F.col("reach") >= percent * F.col("size")), "lead")
    # one that does not reach even the smallest set of a list leaves the list
    least = lead.groupBy("shingle").agg(F.min("size").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    postings = stored(join_counted(lead, least, "shingle", "n", lead.count()).filter("least <= reach").drop("least", "n"), "postings")
    n = postings.count()

    as_a = {"node": "a", "size": "size_a", "reach": "reach_a"}
    as_b = {"node": "b", "size": "size_b", "reach": "reach_b"}
    pivot = postings.groupBy("shingle").agg(F.max(F.struct("weight", "size", "node", "reach")).alias("p"), F.count(F.lit(1)).alias("n")).select("shingle", "p.node", "p.size", "p.reach", "n").withColumnsRenamed(as_a)
    stars = join_counted(postings.withColumnsRenamed(as_b), pivot, "shingle", "n", n).filter(_can_link())
    tried = stored(stars.select("a", "b").distinct(), "stars")
    found = _counted(tried, sets, percent)

    # what may still join two components: in each list, the members outside its largest component against all others
    roots = components(found)
    placed = stored(postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    parts = placed.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("p"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"))
    split = parts.filter("parts > 1").select("shingle", F.col("p.root").alias("main"), "n")
    rest = stored(join_counted(placed, split, "shingle", "n", n), "open-postings")
    few = rest.filter("root <> main").drop("main", "n").withColumnsRenamed(as_a | {"root": "root_a"})
    all_of = rest.drop("main", "n").withColumnsRenamed(as_b | {"root": "root_b"})
    more = few.join(all_of, "shingle").filter((F.col("root_a") != F.col("root_b")) & _can_link())
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.unionByName(_counted(more.join(done, ["a", "b"], "left_anti"), sets, percent))


def with_set_keys(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(text, ...) with __size, __one and __two of each row's set, as `grouped` has them."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in chunked(batch.column(at), BLANK_SPLIT_FOLDED, PACK_BYTES):
                size, one, two = _set_keys(*shingle_sets(w, shingle), len(w.lo))
                keys = [pa.array(size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*batch.slice(w.first, len(w.lo)).columns, *keys], names=[*batch.schema.names, "__size", "__one", "__two"])

    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema]
    return docs.mapInArrow(run, T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in ("__size", "__one", "__two"))]))


def grouped(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc, size, one, two, component for every row of docs(doc_id, text), where NO_ID, which no row may have, stands for null; and group, group2, which tell
    components apart even if they hold null ids only (rows of size 0, each its own component, excepted)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    seen, alive = survey(rows, shingle, percent, block_shingles)
    roots = components(stored(links(rows, alive, shingle, percent), "all-links"))
    # a class is one set: its smallest document; its component: the smallest document of all sets of the same root
    classes = seen.filter("size > 0").groupBy("one", "two").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("copies"))
    linked = classes.join(roots, F.col("one") == F.col("node")).select("one", "two", "root", "least", "copies")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    moved = linked.join(least, "root").select("one", "two", "component", "root")
    alone = classes.filter("copies > 1").join(moved, ["one", "two"], "left_anti").select("one", "two", F.col("least").alias("component"), F.lit(None).cast("long").alias("root"))
    out = seen.join(moved.unionByName(alone), ["one", "two"], "left")
    own = F.when(F.col("root").isNull(), F.col("two"))
    return out.select("doc", "size", "one", "two", F.coalesce("component", "doc").alias("component"), F.coalesce("root", "one").alias("group"), own.alias("group2"))


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    rows, back = freed(docs.select("doc_id", "text"))
    out = grouped(rows, shingle, percent, block_shingles)
    blank = lambda c: F.when(F.col(c) != F.lit(NO_ID), back(F.col(c)))
    return out.select(blank("doc").alias("doc_id"), F.col("size").alias("n_shingles"), blank("component").alias("component_id"))
