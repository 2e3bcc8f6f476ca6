import random

import numpy as np
import xxhash

from meterloom.llm.components import components
from meterloom.llm.simhash import covering_masks, fingerprint, forest, links, near_duplicates


def brute_roots(values, radius):
    values, root = list(values), {v: v for v in values}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def near_values(rng, n):
    out = []
    for _ in range(n):
        centre = rng.getrandbits(64)
        out.append(centre)
        for _ in range(rng.choice([0, 0, 1, 12])):
            x = rng.choice(out[-3:])
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted({x - (1 << 64) if x >> 63 else x for x in out})


def test_masks_cover():
    masks, rng = covering_masks(4), random.Random(0)
    assert len(masks) == 31 and all(30 <= (m & (2**64 - 1)).bit_count() <= 34 for m in masks)
    for _ in range(3000):
        d = sum(1 << i for i in rng.sample(range(64), 4))
        assert any(m & d == 0 for m in masks)


def test_fingerprint():
    text = "The  Quick brown\tfox jumps Ünder it"
    words = "the quick brown fox jumps Ünder it".split(" ")
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 4)
    assert fingerprint(text.encode(), xxhash.xxh64_digest) & (2**64 - 1) == want
    assert fingerprint(b"", xxhash.xxh64_digest) == fingerprint(b" \t\n", xxhash.xxh64_digest) == 0
    assert fingerprint(b"A b", xxhash.xxh64_digest) & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b", 42)


def test_links_and_components_equal_brute_force(spark):
    rng = random.Random(5)
    values = near_values(rng, 150)
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    want = brute_roots(values, 4)
    for bucket_rows in (4096, 3):
        got = dict(map(tuple, components(links(nodes, 4, bucket_rows)).collect()))
        assert {v: got.get(v, v) for v in values} == want
    assert len(forest(np.array([v & (2**64 - 1) for v in values], np.uint64), 4)) == len(values) - len(set(want.values()))


def test_long_chain(spark):
    order = list(range(300))
    random.Random(6).shuffle(order)
    edges = list(zip(range(300), range(1, 301), strict=True)) + [(1000 + a, 1000 + b) for a, b in zip(order, order[1:], strict=False)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[x] == 0 for x in range(301)) and all(got[1000 + x] == 1000 for x in order)


def test_documents(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(200)) for _ in range(20)]
    rows = [(i, base[i % 20] + (f" tail{i}" if i % 3 else ""), 1) for i in range(100)]
    rows += [(200, None, 1), (201, "", 1), (202, " \n", 1), (7, rows[7][1], 1), (None, rows[8][1], 1), (203, "x " * 100_000, 1)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert len(got) == len(rows)
    fps = {r.doc_id: fingerprint((t or "").encode(), xxhash.xxh64_digest) for r, t in ((type("R", (), {"doc_id": i}), t) for i, t, _ in rows)}
    roots = brute_roots(sorted(set(fps.values())), 4)
    least = {}
    for i, fp in fps.items():
        if i is not None:
            least[roots[fp]] = min(least.get(roots[fp], 10**9), i)
    assert all(r.fp == fps[r.doc_id] and r.component_id == least[roots[r.fp]] for r in got)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
