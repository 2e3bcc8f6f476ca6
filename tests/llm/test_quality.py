import random
import re
from collections import Counter

import numpy as np

from meterloom.llm import quality
from meterloom.llm.quality import outliers, robust_fit, statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def texts():
    rng = random.Random(8)
    words = ["ab", "cde", "é#", "x|y", "zzzz", "q", "<b>", "u\xa0v"]
    out = ["".join(rng.choice(words) + rng.choice([" ", "\t", "\n", "  ", "\r\n"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    return out + [None, "", " \n ", "a a a a a a", "a b c d e a b c d e", "\x1cab \x85", "w " * 30_000]


def test_statistics_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(rows[r.doc_id][1]), rows[r.doc_id]


def test_outliers(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        lang, source = ("en", "de")[i % 2], None if i % 3 else "s"
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(15, 200))]
        if i % 60 == 7:
            words = [w + "|#|#|" * 4 for w in words]
        rows.append((i, " ".join(words), lang, source, 1))
    rows += [(700, None, None, None, 1), (701, "a b", "xx", "s", 1), (5, rows[5][1], "de", "s", 1)]
    got = outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int"))
    got = got.select("doc_id", "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        bad = r.doc_id >= 700 or r.doc_id % 60 == 7
        assert r.kept == (not bad) and r.base_failed == (r.doc_id >= 700), r


def plain_fit(x, centre, spread, share=0.75):
    """The estimate of one cell by numpy: (centre, covariance) of the better of both starts."""
    floors = np.diag(np.square(quality.FLOORS))

    def drawn(rows, m, s):
        n = len(rows)
        return (n * m + quality.PRIOR_CENTRE * centre) / (n + quality.PRIOR_CENTRE), (n * s + quality.PRIOR_ROWS * np.diag(spread)) / (n + quality.PRIOR_ROWS) + floors

    low = lambda v, p: np.sort(v, axis=0)[max(int(np.ceil(p * len(v))) - 1, 0)]
    middle = low(x, 0.5)
    found = []
    for m, s in ((middle, np.diag((1.4826 * low(np.abs(x - middle), 0.5)) ** 2)), (x.mean(0), np.cov(x.T, bias=True).reshape(x.shape[1], -1))):
        m, s = drawn(x, m, s)
        for _ in range(quality.MOST_STEPS):
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
            near = x[d2 <= low(d2, share)]
            m, s = drawn(near, near.mean(0), np.cov(near.T, bias=True).reshape(x.shape[1], -1))
        found.append((np.linalg.slogdet(s)[1], m, s))
    return min(found, key=lambda f: round(f[0], 9))[1:]


def test_estimates_equal_numpy_for_cells_of_any_size(spark):
    rng = np.random.default_rng(22)
    cells = {"one": 1, "tiny": 5, "small": 50, "large": 500}
    data = {c: np.round(rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + 3 * (rng.random((n, 1)) < 0.15) + rng.normal(size=4), 6) for c, n in cells.items()}
    rows = [(i, 1, c, *map(float, x)) for c, v in data.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, word_chars long, cell string, x0 double, x1 double, x2 double, x3 double")
    got = {r["cell"]: r for r in robust_fit(df, 0.75).collect()}
    every = np.concatenate(list(data.values()))
    low = lambda v: np.sort(v, axis=0)[int(np.ceil(0.5 * len(v))) - 1]
    centre = low(every)
    spread = (1.4826 * low(np.abs(every - centre))) ** 2
    for c, x in data.items():
        m, s = plain_fit(x, centre, spread)
        factor = np.linalg.cholesky(s)
        assert np.allclose([got[c][f"m{i}"] for i in range(4)], m, atol=2e-3), c
        assert np.allclose([got[c][f"l{i}{j}"] for i in range(4) for j in range(i + 1)], [factor[i, j] for i in range(4) for j in range(i + 1)], atol=5e-3), c


def test_small_cells_reject_what_is_far_from_all(spark):
    rng = random.Random(23)
    plain = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(60))
    rows = [(i, plain(), f"l{i % 40}", "s") for i in range(160)]
    rows += [(500 + i, " ".join(w + "###" for w in plain().split()), f"l{i}", "s") for i in range(3)] + [(600, plain(), "alone", None)]
    got = {r.doc_id: r.kept for r in outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[500 + i] for i in range(3)) and got[600] and sum(got[i] for i in range(160)) >= 159


def test_empty(spark):
    assert outliers(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []
