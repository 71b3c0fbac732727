import hashlib
from collections import Counter

import pytest

from helpers import awkward
from tallgrass.llm import shard_table as st


def slot(doc_id, slots=st.SLOTS):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16) % slots


def brute_fill(names, slots):
    """Every shard's whole order written out first."""
    draw = lambda what, name, below: int(hashlib.md5(f"{what}:{name}".encode()).hexdigest()[:15], 16) % below
    orders = [[(draw("offset", n, slots) + k * (draw("skip", n, slots - 1) + 1)) % slots for k in range(slots)] for n in names]
    table = {}
    while len(table) < slots:
        for shard, order in enumerate(orders):
            free = [s for s in order if s not in table]
            if free:
                table[free[0]] = shard
    return [table[s] for s in range(slots)]


@pytest.mark.parametrize(("shards", "slots"), [(1, 7), (3, 13), (5, 101), (7, 7)])
def test_fill(shards, slots):
    assert st.fill(st.shard_names(shards), slots) == brute_fill(st.shard_names(shards), slots)


def test_shares_differ_by_one_slot():
    shares = Counter(st.fill(st.shard_names(st.SHARDS)))
    assert len(shares) == st.SHARDS and max(shares.values()) - min(shares.values()) <= 1


def test_a_lost_shard_moves_few_slots():
    names = st.shard_names(20)
    before, after = st.fill(names, 10_007), st.fill(names[:-1], 10_007)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 19)
    assert moved < 0.15 * 10_007


def test_bad_tables():
    with pytest.raises(ValueError, match="prime"):
        st.fill(["a"], 12)
    with pytest.raises(ValueError, match="shard"):
        st.fill([], 13)


def test_place(docs):
    table = st.fill(st.shard_names(st.SHARDS))
    found = st.place(docs)
    assert found.columns.count("shard") == 1 and "size" in found.columns
    assert sorted(((r.doc_id, r.slot, r.shard) for r in found.collect()), key=repr) == sorted(((i, slot(i), table[slot(i)]) for i, *_ in awkward()), key=repr)


def test_written_shards(spark, docs, tmp_path):
    st.write_shards(docs, str(tmp_path / "shards"), shards=st.shard_names(4), slots=101, files_per_shard=2)
    table = st.fill(st.shard_names(4), 101)
    found = spark.read.parquet(str(tmp_path / "shards")).select("doc_id", "shard").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(((i, table[slot(i, 101)]) for i, *_ in awkward()), key=repr)


def test_empty(nothing):
    assert st.place(nothing).count() == 0
