"""Language, toxicity and language-model operators against brute force and held-out rows."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from meterloom.llm import common, toxicity
from meterloom.llm.language import fit_language, language
from meterloom.llm.mixing_lm import Decisions, Requests, restored, score_texts, squeezed, successors, tree_table
from meterloom.llm.spelling import fit_model, windows
from meterloom.llm.toxicity import BlockMaxIndex, fit_toxicity
from meterloom.llm.toxicity import toxicity as scored

SYLLABLES = {"en": "th er on an re he in ed", "de": "ch sch ein ung der ge keit ü", "fr": "ou eau tion é que ai eux è", "es": "ción ado que os ar ñ mente ja"}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language(spark):
    rng = random.Random(11)
    rows = [(i, words(rng, lang, rng.randrange(5, 60)), lang if i % 9 else None, 1) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(400))]
    truth = {i: next(x for x in SYLLABLES if any(s in t for s in SYLLABLES[x].split())) for i, t, _, _ in rows}
    rows += [(900, None, "en", 1), (901, "", "de", 1), (902, "12 + 3", "fr", 1), (903, "the " * 100_000, None, 1), (5, rows[5][1], rows[5][2], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = fit_language(df.where("doc_id % 5 <> 0"))
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    got = {r.doc_id: r.p for r in df.select("doc_id", language(F.col("text"), model, spark).alias("p")).collect()}
    assert len(got) == 404 and all(got[i].lang == "und" and got[i].score == 0 for i in (900, 901, 902))
    held = [i for i, _, lang, _ in rows if i % 5 == 0 and i < 400 and lang]
    right = sum(got[i].lang == dict((r[0], r[2]) for r in rows)[i] for i in held)
    assert right >= 0.95 * len(held) and all(0 <= p.score <= 1 for p in got.values())
    empty = fit_language(df.limit(0))
    assert df.limit(3).select(language(F.col("text"), empty, spark).alias("p")).first().p.lang == "und"


def plain_neighbours(vectors, query, k):
    """(cosine, example) by brute force, best first."""
    found = [(sum(x * v.get(t, 0.0) for t, x in query.items()), i) for i, v in enumerate(vectors)]
    return sorted(((c, i) for c, i in found if c > 0), reverse=True)[:k]


def test_block_max_search_is_exact():
    rng = np.random.default_rng(12)
    vectors = []
    for _ in range(700):
        terms = rng.choice(40, rng.integers(1, 6), replace=False)
        w = rng.random(len(terms)) + 0.1
        vectors.append({int(t): float(x) for t, x in zip(terms, w / np.linalg.norm(w), strict=True)})
    owner, terms, weights = (np.array(x) for x in zip(*[(i, t, w) for i, v in enumerate(vectors) for t, w in v.items()], strict=True))
    index = BlockMaxIndex.build(owner, terms, weights, np.ones(700), np.ones(700), np.arange(700), 40)
    queries = [(np.array(list(q)), np.array(list(q.values()))) for q in vectors[:130]]
    for q, (_, cosines) in zip(vectors, index.nearest(queries, 15), strict=False):
        assert np.allclose(cosines, [c for c, _ in plain_neighbours(vectors, q, 15)], atol=2e-6)
    assert len(index.nearest([(np.array([3]), np.array([1.0]))], 700)[0][0]) == sum(3 in v for v in vectors)


def test_block_max_search_with_rare_terms():
    rng = np.random.default_rng(13)
    vectors = []
    for _ in range(900):
        terms = np.unique(np.minimum(rng.geometric(0.02, 12), 399))
        w = rng.random(len(terms)) + 0.1
        vectors.append({int(t): float(x) for t, x in zip(terms, w / np.linalg.norm(w), strict=True)})
    owner, terms, weights = (np.array(x) for x in zip(*[(i, t, w) for i, v in enumerate(vectors) for t, w in v.items()], strict=True))
    index = BlockMaxIndex.build(owner, terms, weights, np.ones(900), np.ones(900), np.arange(900), 400)
    assert (index.row >= 0).any() and len(index.places) > 1000
    for q, (_, cosines) in zip(vectors, index.nearest([(np.array(list(q)), np.array(list(q.values()))) for q in vectors[:100]], 25), strict=False):
        assert np.allclose(cosines, [c for c, _ in plain_neighbours(vectors, q, 25)], atol=2e-6)


def test_votes_against_brute_force(spark):
    rng = random.Random(21)
    rows = [(i, words(rng, rng.choice(list(SYLLABLES)), rng.randrange(5, 40)) + (" grunk" if i % 3 == 0 else "")) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows if i % 4], "doc_id long, toxic int")
    model = fit_toxicity(df, marks)
    texts = {}
    for i, t in sorted(rows):
        if i % 4:
            texts.setdefault((t or "", int(i % 3 == 0)), []).append(i)
    terms = {k: Counter(toxicity.terms_of(k[0].encode())) for k in texts}
    df_all = Counter(w for _, t in rows for w in set(toxicity.terms_of((t or "").encode())))
    classes = [sum(k[1] == y for k in texts) for y in (0, 1)]
    seen = [Counter(w for k, c in terms.items() if k[1] == y for w in c) for y in (0, 1)]

    def weight(w):
        contrast = abs(math.log((seen[1][w] + 1) / (classes[1] + 2)) - math.log((seen[0][w] + 1) / (classes[0] + 2)))
        return (math.log((1 + len(rows)) / (1 + df_all[w])) + 1) * (contrast + toxicity.LEAST_CONTRAST)

    def vector(counts):
        raw = {w: (1 + math.log(n)) * weight(w) for w, n in counts.items() if w in seen[0] or w in seen[1]}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1
        return {w: x / norm for w, x in raw.items()}

    keys, mass = list(texts), [sum(len(v) for k, v in texts.items() if k[1] == y) for y in (0, 1)]
    vectors = [vector(terms[k]) for k in keys]
    for i, t in rows[:30]:
        near = plain_neighbours(vectors, vector(Counter(toxicity.terms_of(t.encode()))), toxicity.NEIGHBOURS + 1)
        tied = len(near) > toxicity.NEIGHBOURS and near[-1][0] > near[-2][0] - 1e-7
        near = near[: toxicity.NEIGHBOURS]
        votes = [(c / (1.05 - min(c, 1.0)) * len(texts[keys[j]]) / mass[keys[j][1]] * len(keys), keys[j][1]) for c, j in near]
        want = (sum(v for v, y in votes if y) + toxicity.PRIOR_WEIGHT * 0.5) / (sum(v for v, _ in votes) + toxicity.PRIOR_WEIGHT)
        got, evidence = model.votes([model.vector(Counter(toxicity.terms_of(t.encode())))])[0]
        assert (tied or abs(got - want) < 1e-4) and np.allclose([e[2] for e in evidence], [c for c, _ in near], atol=1e-5)
    # every text that shares a word with an example has evidence, whatever the word
    out = df.select("doc_id", scored(F.col("text"), model, spark).alias("s")).collect()
    assert all(r.s.evidence for r in out if r.doc_id < 300) and not any(r.s.evidence for r in out if r.doc_id >= 300)


def test_toxicity(spark):
    rng = random.Random(13)
    bad = ["grunk", "blarf", "snorp", "quazz"]
    rows, labels = [], []
    for i in range(600):
        body = words(rng, "en", rng.randrange(20, 80)).split()
        if i % 4 == 0:
            for w in rng.sample(bad, 2):
                body.insert(rng.randrange(len(body)), w.upper() if i % 8 else w + ",")
        rows.append((i, " ".join(body), 0.5))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None, 0.5), (901, "", 0.5), (None, "grunk blarf", 0.5), (3, rows[3][1], 0.5)]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels + [(4, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    model = fit_toxicity(df, marks.where("doc_id % 5 <> 0"))
    got = df.select("doc_id", "text", scored(F.col("text"), model, spark).alias("s")).collect()
    assert len(got) == len(rows) and all(0 <= r.s.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 5 == 0]
    assert sum((r.s.score >= 0.5) == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert all(r.s.evidence and r.s.evidence[0].label == 1 for r in held if r.doc_id % 4 == 0)
    long = df.where("doc_id < 1").selectExpr("doc_id", "concat(repeat('the th er ', 300000), 'grunk blarf') as text", "'x' as score")
    r = long.select(scored(F.col("text"), model, spark).alias("s")).first()
    assert r.s.evidence[0].label == 1
    assert df.limit(0).select(scored(F.col("text"), model, spark).alias("s")).collect() == []
    assert fit_toxicity(df.limit(0), marks).base == 0
    none = fit_toxicity(df, marks.limit(0))
    assert df.limit(2).select(scored(F.col("text"), none, spark).alias("s")).first().s.score == 0


def test_score_alone_and_a_vocabulary_that_the_driver_keeps_packed(spark):
    import pickle

    from meterloom.llm.toxicity import Vocabulary, toxicity_score

    rng = random.Random(21)
    rows = [(i, None if i == 7 else words(rng, "en", 30) + (" grunk blarf é\u00a0x" if i % 4 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit_toxicity(df, df.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("toxic")))
    assert "get" not in vars(model.vocabulary)
    got = df.select(scored(F.col("text"), model, spark)["score"].alias("a"), toxicity_score(F.col("text"), model, spark).alias("b")).collect()
    assert len(got) == 200 and all(r.a == r.b for r in got)
    places = pickle.loads(pickle.dumps(model.vocabulary))
    terms = sorted({t for _, x in rows for t in toxicity.terms_of((x or "").encode())})
    assert len(places) == len(terms) == len(model.weights) and sorted(places.get(t, -1) for t in terms) == list(range(len(terms)))
    assert len(Vocabulary()) == 0 and Vocabulary().get(b"", -1) == -1


def test_windows():
    keys, starts = windows([b"ab", b"", b"xyz"])
    assert starts.tolist() == [0, 3, 4] and len(keys) == 8
    assert [int(k).to_bytes(6, "big") for k in keys[:3]] == [b"\xff\xff\xff\xff\xffa", b"\xff\xff\xff\xffab", b"\xff\xff\xffab\xff"]


def test_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([("the cat sat on the mat " * 20,), (None,), ("ünïcode",)], "text string")
    model = fit_model(texts)
    context = int.from_bytes(b"e cat", "big") << 8
    total = (10 ** model.log10(np.array([context | b for b in range(256)], np.uint64))).sum()
    assert abs(total - 1) < 1e-9


def test_scores(spark):
    rng = random.Random(14)
    rows = [(i, words(rng, "en", 60) + ("  Über\n" if i % 2 else ""), 0.0) for i in range(150)]
    rows += [(900, None, 0.0), (901, "", 0.0), (902, "zzz " * 20_000, 0.0), (7, rows[7][1], 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = score_texts(df, common.id_remainder("doc_id", 7) != 2, top_words=40).collect()
    assert len(got) == len(rows)
    import zlib

    learn = [(i, t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    counts = Counter(w for _, t in learn for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    text = {i: t for i, t, _ in rows}
    for r in got:
        want = tokens(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(want), sum(w in counts for w in want), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in want)) < 1e-6 * len(want)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0
    normal = [r for r in got if r.held_out and r.doc_id < 150]
    assert sum(r.score for r in normal) > sum(r.base_score for r in normal)
    assert score_texts(df.limit(0), F.lit(True)).collect() == []


def test_tree_is_a_distribution_and_knows_classes():
    rng = np.random.default_rng(15)
    classes = rng.integers(0, 40, (3, 77)).astype(float)
    classes[:, 0] = 1
    table = tree_table(np.maximum(classes.sum(0), 0.5), classes)
    assert table.shape == (4, 77) and np.allclose((10.0 ** table.astype(float)).sum(1), 1, atol=1e-5)
    share = classes.sum(0) / classes.sum()
    assert np.abs(10.0 ** table[3] - share).max() < 0.002


def test_successors_against_counting():
    rng = np.random.default_rng(16)
    n = 4000
    rest, token = rng.integers(0, 60, n).astype(np.uint32), np.minimum(rng.geometric(0.4, n), 9).astype(np.uint32)
    learn, count = (rng.random(n) < 0.8).astype(np.uint8), rng.integers(1, 3, n).astype(np.uint32)
    got = successors(rest, token, count, learn)
    tables = {}
    for c, w, k, taught in zip(rest.tolist(), token.tolist(), count.tolist(), learn.tolist(), strict=True):
        if taught:
            tables.setdefault(c, Counter())[w] += k
    for c, w, taught, answer in zip(rest.tolist(), token.tolist(), learn.tolist(), got.tolist(), strict=True):
        full = tables.get(c, Counter())
        best = min(full, key=lambda x: (-full[x], x), default=None)
        others = Counter(full)
        others[w] -= taught
        rival = max((v for x, v in full.items() if x != best), default=0)
        keeps = best == w and others[w] >= rival and others[w] > 0
        top = max(others[best], rival) if best == w else full.get(best, 0)
        if top <= 0:
            assert answer == 0
            continue
        assert (answer > 32) == keeps
        state = (answer - 1) % 32
        assert state // 8 == min(top - 1, 3) and state % 8 == min(math.ceil(math.log2(sum(others.values()) - top + 1)), 7)


def test_requests_lead_back_to_their_tokens():
    tokens = np.array([5, 6, 7, 5, 6, 7, 1 << 31, 9], np.uint32)
    asked = Requests.of(tokens, np.array([0, 3, 6]), np.array([3, 3, 2]), np.array([True, True, False]), 5)
    assert (asked.token[asked.back] == tokens).all() and asked.count.sum() == 8
    # both training texts ask the same, the third asks alone
    assert len(asked.part) == 5 and (np.diff(asked.part) >= 0).all()
    x = np.arange(1000, dtype=np.uint32) * 70_001
    assert (restored(squeezed(x), 1000, np.uint32) == x).all()


def test_mixer_of_decisions_against_a_plain_loop():
    rng = np.random.default_rng(17)
    total = rng.integers(0, 50, 2 * 27 * 8).astype(float)
    mixer = Decisions.fit(np.floor(total * rng.random(len(total))), total)
    sizes = np.array([150, 0, 7, 64])
    cells, hits = rng.integers(0, len(total), sizes.sum()), rng.random(sizes.sum()) < 0.4
    got, at = mixer.log10(cells, hits, sizes), 0
    from meterloom.llm.mixing_lm import BLOCK, RATE

    for i, n in enumerate(sizes):
        weights, score = mixer.weights.copy(), 0.0
        for b in range(0, n, BLOCK):
            steps = []
            for c, y in zip(cells[at + b : at + min(n, b + BLOCK)], hits[at + b : at + min(n, b + BLOCK)], strict=True):
                p = 1 / (1 + math.exp(-float(mixer.logits[c] @ weights[mixer.gate[c]])))
                final = min(max(0.5 * (p + mixer.refine[c]), 1e-6), 1 - 1e-6)
                score += math.log10(final if y else 1 - final)
                steps.append((mixer.gate[c], RATE * (y - p) * mixer.logits[c]))
            for g, s in steps:
                weights[g] += s
        at += n
        assert abs(got[i] - score) < 1e-9


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(18)
    rows = [(i, words(rng, "en", 60)) for i in range(120)]
    rows += [(500 + i, rows[i][1]) for i in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r.doc_id: r.score for r in score_texts(x, F.col("doc_id") % 7 != 2).collect()} for x in (df.coalesce(1), df.repartition(5, "doc_id")))
    assert all(abs(a[i] - b[i]) < 1e-9 * abs(a[i]) for i in a)
    # texts that occur twice stand apart
    assert all(a[i] > a[i + 1] * 0.5 for i in range(0, 60, 2) if (500 + i) % 7 != 2)


def test_small_samples_stay_within_their_bound(spark):
    candidates = spark.createDataFrame([(i, i % 2, 2.0) for i in range(500)], "id long, label int, weight double")
    kept = toxicity.draw(candidates, 40).collect()
    assert Counter(r.label for r in kept) == {0: 40, 1: 40} and all(abs(r.weight - 500 / 40) < 1e-9 for r in kept)


def test_classes_come_from_all_training_texts(spark):
    from meterloom.llm.mixing_lm import FEATURES, class_counts, find_classes, nearest

    # 6000 training texts and 600 others; one kind of texts is a fiftieth of them
    rng = np.random.default_rng(19)
    kind = np.where(rng.random(6600) < 0.02, 2, rng.integers(0, 2, 6600))
    learn = (np.arange(6600) % 11 > 0).astype(np.uint8)
    traits = [np.unique(np.concatenate([rng.integers(0, 30, 6), 1000 + 100 * k + rng.integers(0, 20, 12)])).astype(np.uint16) for k in kind.tolist()]
    tokens = [rng.integers(0, 40, 5).astype(np.uint32) for _ in traits]
    tokens[0][:] = 1 << 31

    def table(step):
        rows = []
        for at in range(0, len(traits), step):
            own = range(at, min(at + step, len(traits)))
            blobs = [np.concatenate([x[i] for i in own]) for x in (tokens, traits)]
            sizes = [np.array([len(x[i]) for i in own], t) for x, t in ((tokens, np.int32), (traits, np.uint16))]
            rows.append((len(own), *map(bytearray, map(squeezed, (learn[own.start : own.stop], blobs[1], sizes[1], sizes[0], blobs[0])))))
        return spark.createDataFrame(rows, "n int, learn binary, kinds binary, kind_sizes binary, sizes binary, blob binary").repartition(3)

    classes = find_classes(table(500))
    assert classes.shape[0] == FEATURES and (classes == find_classes(table(77))).all()
    starts = np.cumsum([0, *map(len, traits[:-1])])
    own = nearest(classes, starts, np.concatenate(traits).astype(np.int64))
    # no class mixes kinds
    assert all(len(set(kind[own == k].tolist())) <= 1 for k in range(classes.shape[1])) and len(set(own[kind == 2].tolist())) >= 1
    want = np.zeros((classes.shape[1], 41), np.int64)
    for i in np.flatnonzero(learn):
        np.add.at(want[own[i]], np.minimum(tokens[i], 40), 1)
    assert want.sum() == 5 * learn.sum() and (class_counts(table(500), classes, 41) == want).all()


def test_stored_tables_leave_no_shuffle_files(spark):
    import time

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {str(b) for b in disk.getAllBlocks().mkString(" ").split() if str(b).startswith("shuffle_")}
    before = shuffles()
    table = common.stored(spark.range(20_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert table.count() == 7
    until = time.time() + 20
    # the count above keeps its own shuffle, of one row a file
    while len(left := {b.split("_")[1] for b in shuffles() - before}) > 1 and time.time() < until:
        time.sleep(0.2)
    assert len(left) <= 1
