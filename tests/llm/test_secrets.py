import hashlib
import random
import string

import numpy as np
import pytest

from meterloom.llm.secrets import ENCODINGS, RANDOM_ALPHA, Family, base_spans, battery, chi2_upper, encoding_of, evenness, find_secrets, spans_of, unevenness


def test_base_spans():
    text = "é password: 'abcdefgh' PASSWD=short token: secret: abcdefghij AKIAABCDEFGHIJKL AKIAX " + "0f" * 16 + "a" * 31 + " api_key = zzzzzzzzz"
    got = base_spans(text)
    assert [(k, text[a:b]) for k, a, b in got] == [
        ("assign", "password: 'abcdefgh"), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0f" * 16 + "a" * 31), ("assign", "api_key = zzzzzzzzz"),
    ]
    assert base_spans("ſecret=abcdefghij") == []


def test_random_tokens_are_found_and_text_is_not(spark):
    rng = random.Random(4)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    words = [pick("etaoinshrdlu", rng.randrange(2, 12)) for _ in range(500)]
    rows, planted = [], {}
    for i in range(200):
        body = [rng.choice(words) for _ in range(60)] + ["http-server-2024-01-15-log-file-name", "aaaaaaaaaa1111111111aaaaaaaaaa", "abcdefghijklmnopqrstuvwxyz0123456789", "1234567890-1234567890-abc"]
        if i % 4 == 0:
            planted[i] = pick(string.ascii_letters + string.digits, 40)
            body.insert(20, planted[i])
        rows.append((i, " ".join(body), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "y" * 300_000, "x")]
    got = {r.doc_id: r.spans for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    assert len(got) == len(rows)
    hit = sum(any(s.kind == "random" and rows[i][1][s.start : s.end] == t for s in got[i]) for i, t in planted.items())
    assert hit >= 0.9 * len(planted)
    false = sum(s.kind == "random" and rows[i][1][s.start : s.end] not in planted.values() for i in range(200) for s in got[i])
    assert false == 0
    assert got[900] == got[901] == got[902] == []


def test_empty(spark):
    assert find_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_encodings():
    names = [n for n, _ in ENCODINGS]
    for token, name in [("1" * 24, "decimal"), ("ab" * 12, "hex"), ("AB" * 12, "HEX"), ("xyz" * 8, "lower"), ("XYZ" * 8, "upper"), ("Q2" * 12, "base32"), ("z9" * 12, "base36"), ("Zz" * 12, "letters"), ("Zz9" * 8, "base62"), ("Zz9+" * 6, "base64"), ("Zz9-" * 6 + "_", "base64url")]:
        assert names[encoding_of(token)[1]] == name, token
    body, at = encoding_of("123e4567-e89b-12d3-a456-426614174000")
    assert names[at] == "hex" and body == "123e4567e89b12d3a456426614174000"
    assert encoding_of("short-1") is None


@pytest.mark.parametrize("name,n", [("decimal", 40), ("hex", 32), ("lower", 40), ("base62", 24), ("base62", 64)])
def test_p_values_against_simulation(name, n):
    rng = np.random.default_rng(5)
    at = [x for x, _ in ENCODINGS].index(name)
    alphabet = list(ENCODINGS[at][1])
    found = [battery("".join(rng.choice(alphabet, n)), at) for _ in range(1500)]
    assert np.mean([p < RANDOM_ALPHA for _, p in found]) < 0.03 and 0.4 < np.mean([p for _, p in found]) < 0.6
    # the upper tail of chi-squared is that of uniform draws, and the null of uneven ones isn't rejected too often
    assert abs(np.mean([chi2_upper(s, len(alphabet) - 1) < 0.1 for s, _ in found]) - 0.1) < 0.035
    share = rng.dirichlet(np.full(len(alphabet), 0.7))
    null = [battery("".join(rng.choice(alphabet, n, p=share)), at)[0] for _ in range(1500)]
    assert np.mean([evenness(s, n, len(alphabet), (share**2).sum(), (share**3).sum()) < 0.02 for s in null]) < 0.045


def test_overlaps_and_weights():
    text = "key AKIA" + "Q7" * 20 + " and token: " + "Zq9" * 12 + " then " + "kX3" * 10
    kinds = [(s[0], s[3] >= 0, s[-1]) for s in spans_of(text)]
    assert kinds.count(("access", False, False)) == 1 and kinds.count(("assign", False, False)) == 1
    assert sorted(c for k, t, c in kinds if t) == [False, True, True]
    family = Family(10, 40.0, unevenness(np.zeros(128, np.int64)))
    assert family.level(0, 80, 9.0, 0.5) > family.level(0, 20, 9.0, 0.5) and family.level(0, 80, 9.0, 0.0) == 0


def test_letters_digits_and_dashed_tokens_are_found(spark):
    rng = random.Random(6)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    uuid = lambda: "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
    words = ["".join(rng.choice(["the", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    kinds = {0: lambda: pick(string.ascii_lowercase, 64), 1: lambda: pick(string.digits, 64), 2: uuid, 3: lambda: pick(string.ascii_letters, 40)}
    rows, planted = [], {}
    for i in range(240):
        body = [rng.choice(words) for _ in range(50)]
        if i % 2 == 0:
            planted[i] = kinds[i // 2 % 4]()
            body.insert(20, planted[i])
        rows.append((i, " ".join(body)))
    got = {r.doc_id: [rows[r.doc_id][1][s.start : s.end] for s in r.spans] for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(t in got[i] for i, t in planted.items()) >= 0.9 * len(planted)
    assert sum(t != planted.get(i) for i in got for t in got[i]) <= 0.02 * len(planted)
