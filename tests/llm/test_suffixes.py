"""Repeated byte strings against brute force, and the parts of the merge sort."""

import random
from collections import Counter

import numpy as np
import pytest

from meterloom.llm import suffixes
from meterloom.llm.suffixes import anchors, merged, page_body, page_rows, reach, repeated_spans, shared_prefix


def brute(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                covered[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered[:-1], [False]]).astype(int))).tolist()
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        out.append((len(t), spans, bytes(b for b, c in zip(t, covered, strict=False) if not c)))
    return out


def corpus(seed, copies=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ab", "ba", "é", "c", "\0", " "]) for _ in range(rng.randrange(1, 5)))
    text = lambda n: "".join(word() for _ in range(n))
    passage, short = text(40), text(9)
    out = [text(rng.randrange(1, 80)) for _ in range(60)]
    out += [text(12) + passage + text(rng.randrange(0, 9)) for _ in range(25)] + [text(7) + short + text(7) for _ in range(40)]
    out += [out[3]] * copies + ["", None, "a" * 300, "ab" * 200, "a" * 37, " ", passage[:30], passage + passage]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("length, gram, ranges", [(20, 8, 10**6), (20, 8, 40), (12, 3, 30), (9, 9, 50), (7, 1, 200)])
def test_equals_brute_force(spark, monkeypatch, length, gram, ranges):
    for name, value in (("BLOCK_BYTES", 700), ("SEGMENT_BYTES", 150), ("RUN_ENTRIES", 60), ("PAGE_ENTRIES", 7), ("RANGE_ENTRIES", ranges), ("GRAM_RANGES", 1)):
        monkeypatch.setattr(suffixes, name, value)
    texts = corpus(length)
    df = spark.createDataFrame([(str(i), t, 1, "x") for i, t in enumerate(texts)], "doc_id string, text string, block int, spans string").repartition(5)
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in repeated_spans(df, length, gram).collect()}
    want = brute([(t or "").encode() for t in texts], length)
    assert got == {str(i): w for i, w in enumerate(want)}


def test_long_text_and_layout(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, long + long[:1000]), (2, long[500_000:500_300]), (3, "x" * 199), (4, "x" * 199), (5, long[7:206] + "!"), (6, None), (None, "y" * 200)]
    for parts in (1, 4):
        got = {r.doc_id: r for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
        assert [tuple(s) for s in got[1].spans] == [(0, 1000), (500_000, 500_300), (3_000_000, 3_001_000)]
        assert [tuple(s) for s in got[2].spans] == [(0, 300)] and not any(got[i].spans for i in (3, 4, 5, 6, None)) and bytes(got[3].kept) == b"x" * 199
        assert len(got[1].kept) == 3_000_000 - 1300


def test_every_string_has_one_leftmost_anchor():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 90))) for _ in range(30)] + [b"a" * 60]
    body, sizes, length, gram = b"".join(texts), [len(t) for t in texts], 16, 5
    at, h = anchors(body, sizes, length, gram)
    low, high = reach(at, h, sizes, length, gram)
    owned = Counter(p for a, b in zip(low.tolist(), high.tolist(), strict=True) for p in range(a, b - length + 1))
    starts, base = [], 0
    for t in texts:
        starts += [base + p for p in range(len(t) - length + 1)]
        base += len(t)
    assert owned == Counter(starts)


def test_loser_tree_gives_order_and_shared_prefixes():
    rng = random.Random(9)
    runs = [sorted(bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 30))) for _ in range(11)]
    streams = []
    for keys in runs:
        if keys:
            shared = [0, *(shared_prefix(a, b) for a, b in zip(keys, keys[1:], strict=False))]
            body = page_body(keys, shared, [len(k) for k in keys], [1] * len(keys))
            streams.append(page_rows(body, len(keys), 16 * len(keys) + sum(map(len, keys)) - sum(shared)))
    rows = list(merged(streams))
    assert [r[0] for r in rows] == sorted(k for keys in runs for k in keys)
    assert all(b[1] == shared_prefix(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False))


def test_empty_table(spark):
    assert repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
