import hashlib
import zlib

import numpy as np
import pytest

from textloom.llm.sharding import minimax_cuts, shard_documents

DOCS = "doc_id bigint, text string, size string"


def least_capacity(sizes, shards):
    def fits(c):
        used, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                used, at = used + 1, 0
            at += s
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        half = (low + high) // 2
        low, high = (low, half) if fits(half) else (half + 1, high)
    return low


@pytest.mark.parametrize("points", [32, 64, 4096])
@pytest.mark.parametrize("hot", [0, 3000])
def test_capacity_is_the_smallest(spark, points, hot):
    rng = np.random.default_rng(points + hot)
    sizes = rng.integers(1, 60, 300).tolist()
    if hot:
        sizes[120] = hot
    ends = np.cumsum(sizes).tolist()
    sums = spark.createDataFrame(list(zip(sizes, ends)), "size bigint, end bigint")
    capacity, cuts = minimax_cuts(sums, 7, points)
    assert capacity == least_capacity(sizes, 7)
    edges = [0, *cuts, ends[-1]]
    assert set(cuts) <= set(ends) and max(b - a for a, b in zip(edges, edges[1:])) <= capacity


def test_many_groups_and_shards(spark):
    sizes = np.random.default_rng(8).integers(1, 4000, 20000).tolist()
    ends = np.cumsum(sizes).tolist()
    sums = spark.createDataFrame(list(zip(sizes, ends)), "size bigint, end bigint").repartition(8)
    capacity, cuts = minimax_cuts(sums, 16)
    loads = np.diff([0, *cuts, ends[-1]])
    assert capacity == least_capacity(sizes, 16) and set(cuts) <= set(ends)
    assert loads.max() == capacity or loads.max() <= capacity
    assert loads.min() >= ends[-1] / 16 - 4000  # no shard is short by more than a group


def test_documents_keep_copies_together_and_count_slots(spark):
    rows = [(i, f"text {i % 90} " * (1 + i % 5), "clash") for i in range(400)] + [(1000 + i, "copy", "clash") for i in range(300)] + [(5000, None, None), (5001, "", None), (None, "é", None)]
    got = shard_documents(spark.createDataFrame(rows, DOCS), shards=5).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    where, slots, load = {}, {}, [0] * 5
    for r in got:
        text = texts[r.doc_id]
        raw = (text or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        where.setdefault(text, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r["size"]
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for _, t, _ in rows:
        key = hashlib.sha256(b"null" if t is None else b"t" + t.encode()).hexdigest()
        groups[key] = groups.get(key, 0) + len((t or "").encode()) + 1
    assert max(load) <= least_capacity([groups[k] for k in sorted(groups)], 5)


def test_repeated_rows_and_empty_table(spark):
    twice = shard_documents(spark.createDataFrame([(1, "a", "x"), (1, "a", "x")], DOCS)).collect()
    assert sorted(r.slot for r in twice) == [0, 1] and len({r.shard for r in twice}) == 1
    assert shard_documents(spark.createDataFrame([], DOCS)).count() == 0
