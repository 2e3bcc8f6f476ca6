import random
import zlib

from pyspark.sql import functions as F

from meterloom.llm.sharding import minimax_cuts, shard


def brute_capacity(sizes, n):
    low, high = max(sizes), sum(sizes)
    def needed(c):
        shards, room = 1, c
        for s in sizes:
            if s > room:
                shards, room = shards + 1, c
            room -= s
        return shards
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= n else (mid + 1, high)
    return low


def test_capacity_is_the_smallest(spark):
    rng = random.Random(3)
    for n_groups, n in ((1, 4), (30, 4), (3000, 7), (9000, 40)):
        groups = [(rng.getrandbits(64) - 2**63, rng.choice([1, 5, 17, 400])) for _ in range(n_groups)]
        if n_groups == 3000:
            groups[5] = (groups[5][0], 200_000)
            groups += [((1 << 40) + k, 3 + k % 7) for k in range(200)]
        cuts, capacity = minimax_cuts(spark.createDataFrame(groups, "h long, w long"), n)
        assert capacity == brute_capacity([w for _, w in sorted(groups)], n)
        assert len(cuts) < n and cuts == sorted(cuts)
        loads = {}
        for h, w in groups:
            k = sum(h >= c for c in cuts)
            loads[k] = loads.get(k, 0) + w
        assert max(loads.values()) == capacity


def test_rows(spark):
    rows = [(i, f"text {i % 70}", "x") for i in range(300)] + [(300, None, "x"), (301, "", "x"), (None, "é" * 5000, "x"), (3, "text 3", "x"), (3, "text 3", "x")]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string, shard string"), n_shards=5, bucket_rows=(10, 20)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    by_text, slots = {}, {}
    for r in got:
        t = (text[r.doc_id] or "").encode()
        assert r.size == len(t) + 16 and r.text_crc32 == zlib.crc32(t)
        by_text.setdefault(text[r.doc_id], set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(slots) <= set(range(5))


def test_empty(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
