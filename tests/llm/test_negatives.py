"""Strassen products, and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.llm import negatives
from meterloom.llm.negatives import hard_negatives, product


@pytest.mark.parametrize("m, k, n", [(1, 1, 1), (5, 3, 70), (33, 64, 100), (130, 64, 257), (64, 0, 9), (70, 130, 66)])
def test_products_are_exact(monkeypatch, m, k, n):
    monkeypatch.setattr(negatives, "LEAF", 4)
    rng = np.random.default_rng(m)
    for top in (300, 2**30, 1e25):
        a, b = (np.floor(rng.uniform(-top, top, (rows, k))) for rows in (m, n))
        exact = np.array([[int(v) for v in r] for r in a], object).reshape(m, k) @ np.array([[int(v) for v in r] for r in b], object).reshape(n, k).T
        assert (product(a, b) == (exact if k else 0)).all()


def brute(rows, asks, k=5, window=(80, 100)):
    ok = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for anchor in sorted({i for i, *_ in ok if asks(i)}):
        q, label = min((v, lab) for i, v, lab in ok if i == anchor)
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, lab) for i, v, lab in ok if i != anchor and len(v) == len(q))
        positives = {}
        for s, i, _ in [x for x in scored if x[2] == label][:k]:
            positives.setdefault(i, -s)
        for p, score in positives.items():
            near = [(i, -s) for s, i, lab in scored if lab != label and window[0] * score <= -100 * s <= window[1] * score][:k]
            out += [(anchor, p, r + 1, i, score, s) for r, (i, s) in enumerate(near)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 37), ("TILE_ROWS", 6), ("LEAF", 3)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(4)
    rows = [(i, [round(rng.uniform(-0.2, 1), rng.choice([1, 3])) for _ in range(6)], rng.randrange(3)) for i in range(160)]
    rows += [(200 + i, rows[i][1], rng.randrange(3)) for i in range(20)] + [(5, rows[5][1], 1), (17, rows[17][1], rows[17][2]), (17, rows[17][1], rows[17][2])]
    rows += [(300, None, 1), (301, [0.5, None] * 3, 1), (305, [math.nan] * 6, 2), (310, [0.0] * 6, 0), (311, [0.5] * 6, None), (None, [0.5] * 6, 1), (315, [0.5, 0.25], 1), (316, [0.5, 0.5], 2), (317, [0.5, 0.5], 1), (320, [], 1), (325, [-1.0] * 6, 2)]
    df = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, id int, part string")
    got = sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 5 == 0, F.col("label")).collect()))
    want = brute(rows, lambda i: i % 5 == 0)
    assert got == want and len(want) > 300


def test_large_components(spark):
    rows = [(0, [1e12, 1e3], 1), (1, [2e12, 5.0], 1), (2, [1.9e12, 5.0], 2), (3, [1.0, 1e9], 2)]
    got = hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0, F.col("label")).collect()
    assert [(r.positive_id, r.negative_id, r.negative_score) for r in got] == [(1, 2, (1 << 63) - 1)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label")).collect() == []
