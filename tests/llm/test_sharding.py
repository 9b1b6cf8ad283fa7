import random
import zlib

import numpy as np
import pytest

from tierflow.llm import sharding


def brute_capacity(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid, used, left = (low + high) // 2, 1, (low + high) // 2
        for size in sizes:
            if size > left:
                used, left = used + 1, mid
            left -= size
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("limit", [40, 1000])
def test_smallest_capacity_is_exact(spark, limit):
    pick = random.Random(limit)
    for shards in (1, 5):
        sizes = [pick.choice([8, 9, 20, 50, 700]) for _ in range(300)]
        ends = np.cumsum(sizes).tolist()
        groups = spark.createDataFrame([(e, k + 1, k.to_bytes(4, "big")) for k, e in enumerate(ends)], "_end_bytes long, _end_rows long, digest binary")
        capacity, marks, known = sharding.smallest_capacity(groups, ends[-1], max(sizes), shards, limit)
        assert capacity == brute_capacity(sizes, shards)
        cuts = [0, *sharding.even_cuts(marks, capacity, shards), ends[-1]]
        assert max(b - a for a, b in zip(cuts, cuts[1:])) <= capacity and all(c in known for c in cuts[1:])


def test_documents(spark):
    pick = random.Random(1)
    texts = [pick.choice(["same", "same", None, "", "é" * pick.randint(1, 50), "x" * pick.randint(0, 300)]) for _ in range(400)]
    docs = spark.createDataFrame([(k, t, k % 3) for k, t in enumerate(texts)] + [(0, texts[0], 0)], "doc_id long, text string, digest int")
    rows = sharding.shard_documents(docs, 5, limit=60).collect()
    assert sorted(r.doc_id for r in rows) == sorted([*range(400), 0])
    where = {}
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
        assert where.setdefault(text, r.shard) == r.shard
    for shard in range(5):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_few_and_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    rows = sharding.shard_documents(docs, 24).collect()
    assert len(rows) == 3 and all(0 <= r.shard < 24 for r in rows) and len({r.shard for r in rows}) == 2
    assert sharding.shard_documents(docs.limit(0), 24).count() == 0
