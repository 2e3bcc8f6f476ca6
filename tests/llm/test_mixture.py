import math

from meterloom.llm.mixture import Mixture


def rows():
    out = []
    for s, n in (("a", 300), ("b", 40), ("c", 25), (None, 10)):
        out += [(len(out) + i, "w " * (1 + i % 7), s, i) for i in range(n)]
    return out + [(1000, None, "a", 0), (1001, "", "b", 0), (1002, None, "void", 0), (None, "x y", "c", 0), (5, "q r s", "a", 0), (5, "q r s", "a", 0)]


def words(t):
    return len((t or "").split())


def test_weights_and_budgets(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string, tokens int")
    mixture = Mixture(df, entropy=0.9, most_passes=6.0, block_rows=16)
    got, w = mixture.listed().collect(), {r.source: r for r in mixture.weights.collect()}
    tokens = {}
    for _, t, s, _ in data:
        key = "~" if s is None else "=" + s
        tokens[key] = tokens.get(key, 0) + words(t)
    total = sum(tokens.values())
    tokens.pop("=void")
    entropy = -sum(r.weight * math.log(r.weight) for r in w.values())
    assert set(w) == set(tokens) and abs(sum(r.weight for r in w.values()) - 1) < 1e-9
    assert abs(entropy - 0.9 * math.log(4)) < 1e-6
    # the weights are powers of the shares
    (x, y) = (w["=a"], w["=b"])
    exponent = math.log(x.weight / y.weight) / math.log(tokens["=a"] / tokens["=b"])
    z = sum((t / total) ** exponent for t in tokens.values())
    assert all(abs(r.weight - (tokens[s] / total) ** exponent / z) < 1e-6 for s, r in w.items())
    used, seen = {}, {}
    for r in got:
        used[r.source] = used.get(r.source, 0) + r.tokens
        seen.setdefault((r.source, r.epoch), []).append(r.id)
        assert 0 <= r.position <= 1
    taken = sorted((r.id is None, r.id or 0) for r in got)
    docs = mixture.documents(df)
    assert docs.columns == df.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) == taken
    for s, r in w.items():
        at = sorted((x.position, x.tokens) for x in got if x.source == s)
        assert all(abs(q - p - n / r.budget) < 1e-9 for (p, n), (q, _) in zip(at, at[1:], strict=False) if n)
        assert r.budget - 10 <= used[s] <= r.budget
        full = int(r.budget // r.tokens)
        for e in range(full):
            assert len(seen[s, e]) == r.rows


def test_repetition_limit_wins(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, tokens int")
    weights = Mixture(df, entropy=1.0, most_passes=1.5).weights
    assert abs(max(r.passes for r in weights.collect()) - 1.5) < 0.05
    weights = Mixture(df, entropy=None, most_passes=None).weights
    assert all(abs(r.passes - 1) < 0.01 for r in weights.collect())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    mixture = Mixture(df)
    assert mixture.listed().collect() == [] and mixture.documents(df).collect() == []
