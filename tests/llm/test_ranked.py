"""Ranked search against brute force, and reading by impact against plain sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from meterloom.llm import ranked
from meterloom.llm.ranked import nra, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))


def brute(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        asked = Counter(terms(max(t or "" for i, t in items if i == item)))
        scores = []
        for i, c in found:
            m = 25 + 75 * c.total() * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.fixture
def cases():
    rng = random.Random(21)
    word = lambda: rng.choice(["Ab", "ab", "Äb", "äb", "c3", "d e", "x y", "日本", "rare%d" % rng.randrange(30), "w%d" % int(rng.paretovariate(0.8))])
    text = lambda n: "".join(word() + rng.choice([" ", "-", "\n", "_", "\x7f"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(300)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(40)] + [docs[5], docs[5], (400, None), (401, ""), (402, "---"), (None, "rare1 rare2 ab"), (403, "ab " * 20_000)]
    items = [(i, text(rng.randrange(1, 25))) for i in range(30)] + [(3, "ab"), (40, None), (41, "???"), (42, "nowhere"), (43, "ab " * 500 + "c3"), (None, "ab")]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"SHARD_DOCS": 23, "SHARD_POSTINGS": 150, "GROUP_BYTES": 900, "DEPTH": 2, "CELLS": 40}])
def test_equals_brute_force(spark, monkeypatch, cases, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranked, name, value)
    docs, items = cases
    table = spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], "doc_id long, text string, score double, item string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, search(table, asked, k=10).collect()))
    assert got == brute(docs, items, 10) and len(got) > 250


def test_reading_by_impact():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, lists = int(rng.integers(1, 40)), []
        for _ in range(int(rng.integers(1, 6))):
            docs = rng.permutation(n)[: int(rng.integers(0, n + 1))]
            lists.append((docs, np.sort(rng.integers(1, 6, len(docs)))[::-1]))
        sums = np.zeros(n, np.int64)
        for docs, addends in lists:
            sums[docs] += addends
        order = rng.permutation(n)
        want = [(d, int(sums[d])) for d in sorted(range(n), key=lambda d: (-sums[d], order[d]))[:4] if sums[d]]
        assert nra(lists, order, 4, depth=int(rng.integers(1, 4))) == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert search(docs, one.withColumnRenamed("doc_id", "item_id")).collect() == [] == search(one, items).collect()
