import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meterloom.llm import bitsliced
from meterloom.llm.bitsliced import top_k


def brute(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi in sorted({i for i, _ in ok if i % 5 == 0}):
        q = min(v for i, v in ok if i == qi)
        scores = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in ok if i != qi and len(v) == len(q)))[:k]
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted((q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 37)
    monkeypatch.setattr(bitsliced, "TILE_ROWS", 8)
    rng = random.Random(10)
    rows = [(i, [round(rng.uniform(-1, 1), rng.choice([1, 7])) for _ in range(6)]) for i in range(130)]
    rows += [(131, rows[3][1]), (132, rows[3][1]), (133, [0.0] * 6), (140, [0.0] * 6), (134, None), (135, [1.0, None] * 3), (145, [float("nan")] * 6), (136, [float("inf")] * 6)]
    rows += [(10, rows[11][1]), (12, rows[12][1]), (None, [0.5] * 6), (150, [0.5, 0.25]), (151, [1.0, -1.0]), (155, [])]
    rows += [(160, [70000.0] * 6), (161, [-70000.5] * 6), (165, [1e15, -1e15, 3e9, 0.25, 1e-30, 7.0]), (166, [1e15, 1e15, 1.0, 2.0, 3.0, 4.0]), (167, [1e30] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    exact = [(i, v and [x if x is None else float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 5 == 0, k=5).collect()))
    assert got == brute(exact, 5)


def test_blocks_without_padding(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 64)
    rng = random.Random(11)
    # 64 and 128 rows fill whole words of the bitmaps, in one part or in two blocks of it
    for n, scale in ((64, 1), (64, 1 << 60), (128, 1)):
        rows = [(i, [float(scale * rng.randint(-9, 9)) for _ in range(6)]) for i in range(n)]
        batch = pa.RecordBatch.from_pydict({"part": [0] * n, "id": [i for i, _ in rows], "q": [v for _, v in rows]})
        blocks = [bitsliced.Block.of(b.to_pylist()[0]) for b in bitsliced.build(iter([batch]))]
        assert [b.n for b in blocks] == [64] * (n // 64)
        for qi, q in rows[:5]:
            found = sorted((-s, i) for b in blocks for i, s in zip(*b.best(qi, bitsliced.integers(np.array(q)), 5), strict=True))[:5]
            assert found == sorted((-sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != qi)[:5]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(64)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, k=5).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5)


def test_empty(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect() == []
