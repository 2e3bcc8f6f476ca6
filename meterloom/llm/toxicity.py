"""Toxicity by the nearest labelled examples.

Labelled documents become TF-IDF vectors over all their words, and a text is scored by the k examples of highest cosine.
The inverse document frequency, counted over all documents, is multiplied by how far the word's odds differ between the
labels (as in delta TF-IDF, but without sign), since plain TF-IDF ranks by whatever texts have in common. No word is left
out. The search is exact: an inverted index keeps the postings of rare terms, and for every common term and block of
examples its largest weight in the block. Both bound every block; those of highest bounds are scored first, and of the
others those whose bound reaches the k-th best cosine found.
Votes are weighted by distance, both labels having the same weight in all, and are calibrated on the examples
themselves, each scored without itself.

Examples with the same text are one, with the sum of their weights. At most MAX_EXAMPLES of each label are drawn, so the
index has a fixed bound for a given length of texts and is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import portions, release_memory, release_pages, stored, text_bytes

MAX_EXAMPLES, BLOCK = 6000, 64
#: Blocks of highest bounds that are scored before the others.
FIRST_BLOCKS = 24
#: Queries that are searched together.
TOGETHER = 64
#: A term is common if one in so many examples has it.
COMMON = 16
#: Share of the plain inverse document frequency in the weight of a word whose odds don't differ.
LEAST_CONTRAST = 0.05
NEIGHBOURS, PRIOR_WEIGHT, BINS, MEMO_TEXTS = 25, 0.05, 40, 2000
PUNCTUATION = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * 32)
SCORED = "struct<score double, evidence array<struct<id long, label int, cosine double>>>"


def terms_of(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z), without ASCII punctuation."""
    return (text or b"").lower().translate(PUNCTUATION).split()


@dataclass
class BlockMaxIndex:
    """Unit vectors of examples in blocks of BLOCK places. The postings (places, weights) of rare terms are sorted by term;
    starts[t] is where those of t begin. A common term t has row[t] >= 0: dense[b, row] are its weights in block b, and
    tops[row, b] the largest of them."""

    starts: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    row: np.ndarray
    dense: np.ndarray
    tops: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    ids: np.ndarray

    @classmethod
    def build(cls, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, labels, votes, ids, n_terms: int) -> BlockMaxIndex:
        """owner, terms, weights: the components of the vectors of examples 0.. in any order."""
        n, labels, votes, ids = len(ids), np.asarray(labels, np.int64), np.asarray(votes, float), np.asarray(ids, np.int64)
        # examples that share their heaviest term (the least of equals) become neighbours, which keeps the bounds of blocks tight
        most, heavy = np.zeros(n, weights.dtype), np.full(n, n_terms)
        np.maximum.at(most, owner, weights)
        heaviest = weights == most[owner]
        np.minimum.at(heavy, owner[heaviest], terms[heaviest])
        order = np.lexsort((ids, heavy))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        place, weights = place[owner], weights.astype(np.float32)
        common = np.bincount(terms, minlength=n_terms) * COMMON >= n
        row = np.where(common, np.cumsum(common) - 1, -1).astype(np.int32)
        blocks, at = -(-n // BLOCK), common[terms]
        dense = np.zeros((blocks, int(common.sum()), BLOCK), np.float32)
        dense[place[at] // BLOCK, row[terms[at]], place[at] % BLOCK] = weights[at]
        tops = dense.max(2).T.copy()
        terms, place, weights = terms[~at], place[~at], weights[~at]
        sort = np.lexsort((place, terms))
        starts = np.searchsorted(terms[sort], np.arange(n_terms + 1)).astype(np.int32)
        return cls(starts, place[sort].astype(np.uint16 if n <= 1 << 16 else np.int32), weights[sort], row, dense, tops, labels[order], votes[order], ids[order])

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights) the places and cosines of the k nearest examples that share a term, nearest
        first, ties (to six digits) to the earlier place."""
        return [x for at in range(0, len(queries), TOGETHER) for x in self._nearest(queries[at : at + TOGETHER], k)]

    def _nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n, blocks = len(queries), len(self.dense)
        scores = np.empty((n, blocks * BLOCK), np.float32)
        common = np.zeros((n, self.dense.shape[1]), np.float32)
        for i, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            rare = row < 0
            start, end = self.starts[terms[rare]], self.starts[terms[rare] + 1]
            sizes = end - start
            # the postings of all rare terms, one after the other
            posting = np.arange(int(sizes.sum())) + np.repeat(start - np.cumsum(sizes) + sizes, sizes)
            scores[i] = np.bincount(self.places[posting], np.repeat(weights[rare].astype(np.float32), sizes) * self.weights[posting], blocks * BLOCK)
            common[i, row[~rare]] = weights[~rare]
        # rare terms count at once; they and the largest weights of the common ones bound what a block can hold
        bounds = scores.reshape(n, blocks, BLOCK).max(2) + common @ self.tops
        scored = np.zeros((n, blocks), bool)

        def score(chosen: np.ndarray) -> None:
            for b in np.flatnonzero(chosen.any(0)):
                asked = np.flatnonzero(chosen[:, b])
                scores[asked, b * BLOCK : (b + 1) * BLOCK] += common[asked] @ self.dense[b]
            np.logical_or(scored, chosen, out=scored)

        first = min(FIRST_BLOCKS, blocks)
        high, chosen = np.argpartition(-bounds, first - 1, 1)[:, :first], np.zeros((n, blocks), bool)
        np.put_along_axis(chosen, high, True, 1)
        score(chosen)
        # the k-th of these is no more than the k-th of all
        near = np.take_along_axis(scores.reshape(n, blocks, BLOCK), high[:, :, None], 1).reshape(n, -1)
        least = np.partition(near, -k, 1)[:, -k] if near.shape[1] > k else np.zeros(n, np.float32)
        score(~scored & (bounds > 0) & (bounds >= least[:, None] - 2e-6))
        out = []
        for i in range(n):
            # k scores are least or more, so the k best are among those near it
            at = np.flatnonzero(scores[i] >= least[i] - 2e-6)
            found = np.round(scores[i, at], 6)
            kept = (found > 0) & scored[i, at // BLOCK]
            at, found = at[kept], found[kept]
            best = np.lexsort((at, -found))[:k]
            out.append((at[best], found[best].astype(float)))
        return out


class Vocabulary:
    """Places of terms. It is kept and sent as its terms in order with a space between (terms have none); the dictionary is
    built where terms are looked up, so the driver holds none."""

    def __init__(self, joined: bytes = b""):
        self.joined = joined
        self.size = joined.count(b" ") + 1 if joined else 0

    def __reduce__(self):
        return Vocabulary, (self.joined,)

    def __len__(self) -> int:
        return self.size

    @cached_property
    def get(self):
        return {term: i for i, term in enumerate(self.joined.split(b" "))}.get if self.size else {}.get


@dataclass
class ToxicityModel:
    """vocabulary and (weights, index) are large and travel as broadcasts, once each; see packed()."""

    vocabulary: Vocabulary
    weights: np.ndarray
    index: BlockMaxIndex | None
    base: float
    none: float
    steps: np.ndarray
    shared: tuple | None = None

    def packed(self, spark):
        """A function that gives this model in a task."""
        sc = spark.sparkContext
        words, core = self.shared or (sc.broadcast(self.vocabulary), sc.broadcast((self.weights, self.index and vars(self.index))))
        base, none, steps = self.base, self.none, self.steps
        # plain values travel, as workers needn't have this package
        return lambda: ToxicityModel(words.value, core.value[0], core.value[1] and BlockMaxIndex(**core.value[1]), base, none, steps)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms, in order, and components of the unit vector of a text's words; empty if no example has one of them."""
        terms = np.fromiter(map(self.vocabulary.get, counts, repeat(-1)), np.int64, len(counts))
        times = np.fromiter(counts.values(), np.int64, len(counts))
        by = terms.argsort()
        by = by[np.searchsorted(terms[by], 0) :]
        terms = terms[by]
        raw = (1 + np.log(times[by])) * self.weights[terms]
        return terms, raw / (math.sqrt(float(raw @ raw)) or 1.0)

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], own: list[int] | None = None) -> list[tuple[float, list[tuple]]]:
        """For each vector the weighted share of toxic neighbours and the neighbours; own: ids of examples to leave out."""
        out = []
        near = self.index.nearest(vectors, NEIGHBOURS + (own is not None)) if self.index else [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        for i, (at, cosines) in enumerate(near):
            if own is not None:
                other = self.index.ids[at] != own[i]
                at, cosines = at[other][:NEIGHBOURS], cosines[other][:NEIGHBOURS]
            if not len(at):
                out.append((self.none, []))
                continue
            weight = cosines / (1.05 - np.minimum(cosines, 1.0)) * self.index.votes[at]
            yes, every = float(weight[self.index.labels[at] == 1].sum()), float(weight.sum())
            evidence = list(zip(self.index.ids[at].tolist(), self.index.labels[at].tolist(), cosines.tolist(), strict=True))
            out.append(((yes + PRIOR_WEIGHT * 0.5) / (every + PRIOR_WEIGHT), evidence))
        return out

    def scores(self, counts: list[Counter]) -> list[tuple[float, list[tuple]]]:
        """Calibrated score and neighbours of each text's words."""
        found = self.votes([self.vector(c) for c in counts])
        place = np.arange(BINS) + 0.5
        return [(min(1.0, max(0.0, float(np.interp(v * BINS, place, self.steps)))) if near else self.none, near) for v, near in found]


def rising(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic regression by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.array([v for v, _, n in pools for _ in range(int(n))])


def draw(candidates: DataFrame, max_examples: int) -> DataFrame:
    """(id, label, weight): at most max_examples rows of each label by a hash of the id, whose weights stand for all."""
    totals = {r[0]: (r[1], r[2]) for r in candidates.groupBy("label").agg(F.count("*"), F.sum("weight")).collect()}
    rank, parts = F.xxhash64("id", F.lit("example")), []
    share = F.pmod(rank, F.lit(1 << 30)) / float(1 << 30)
    for label, (n, weight) in sorted(totals.items()):
        near = candidates.where((F.col("label") == label) & (share < min(1.0, 1.2 * max_examples / n + 100 / n)))
        kept = stored(near.orderBy(share, rank, "id").limit(max_examples))
        drawn = kept.agg(F.sum("weight")).first()[0] or 1.0
        parts.append(kept.withColumn("weight", F.col("weight") * float(weight / drawn)))
    return reduce(DataFrame.unionByName, parts) if parts else candidates.limit(0)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of texts as Latin-1 strings of their bytes, with their counts."""
    for batch in portions(batches, "text"):
        counted = [Counter(terms_of(t)) for t in text_bytes(batch.column("text"))]
        words = pa.array([[w.decode("latin-1") for w in c] for c in counted], pa.list_(pa.string()))
        counts = pa.array([list(c.values()) for c in counted], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "same", "label", "weight")], words, counts], ["id", "same", "label", "weight", "words", "counts"])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES
) -> ToxicityModel:
    """Learn from the rows of labels (id, 0 or 1) whose documents are in docs; a null label or id is no label.

    Repeated label rows count once, as toxic if any is; rows of docs with the same text and label are one example, that
    of the least id, with their number as its weight. Null and empty texts are an example without words, which says how
    likely the label is where nothing else does. Texts are taken whole, however long; columns of other names don't
    matter. Without examples of both labels (an empty table among them) the model returns the share of toxic labels for
    every text (0 if there are none).
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    marked = marked.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    same = source.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"))
    candidates = same.join(marked, "id").groupBy("same", "label").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("weight"))
    sample = stored(draw(stored(candidates), max_examples))
    # at most two times max_examples rows, hence the broadcast; an id may have several texts
    picked = source.withColumn("same", F.xxhash64(F.coalesce("text", F.lit("")))).join(F.broadcast(sample), ["id", "same"])
    examples = stored(picked.mapInArrow(_terms, "id long, same long, label int, weight double, words array<string>, counts array<int>"))
    if not examples.groupBy("id", "same", "label").count().where("count > 1").isEmpty():
        examples = stored(examples.dropDuplicates(["id", "same", "label"]))
    shares = {r[0]: (r[1], r[2]) for r in examples.groupBy("label").agg(F.sum("weight"), F.count("*")).collect()}
    toxic, clean = shares.get(1, (0.0, 0)), shares.get(0, (0.0, 0))
    base = toxic[0] / max(toxic[0] + clean[0], 1e-9)
    if not toxic[1] or not clean[1]:
        return ToxicityModel(Vocabulary(), np.zeros(0), None, base, base, np.full(BINS, base))
    seen = examples.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("a"), F.count("*").alias("n")).orderBy("word").toArrow()
    vocabulary = Vocabulary(b" ".join(" ".join(c.to_pylist()).encode("latin-1") for c in seen.column("word").chunks if len(c)))
    a, n = (seen.column(c).to_numpy().astype(float) for c in ("a", "n"))
    del seen
    contrast = np.abs(np.log((a + 1) / (toxic[1] + 2)) - np.log((n - a + 1) / (clean[1] + 2)))
    del a, n
    release_memory()
    sc = docs.sparkSession.sparkContext
    words = sc.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, total = words.value, 0
        n = np.zeros(len(places), np.int64)
        for batch in portions(batches, "text"):
            for t in text_bytes(batch.column("text")):
                found = np.fromiter(map(places.get, set(terms_of(t)), repeat(-1)), np.int64)
                n[found[found >= 0]] += 1  # each word once
            total += batch.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(n[at], total))], ["term", "n"])

    counted = source.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    weights = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * (contrast + LEAST_CONTRAST)
    del counted, df, contrast
    release_memory()
    return _index(examples, ToxicityModel(vocabulary, weights, None, base, base, np.full(BINS, base)), words)


def _index(examples: DataFrame, model: ToxicityModel, words) -> ToxicityModel:
    """Add the index over the examples, and the calibration from their votes without themselves; words: the vocabulary
    as a broadcast."""
    sc = examples.sparkSession.sparkContext
    core = sc.broadcast((model.weights, None))
    model.shared = (words, core)
    given = model.packed(examples.sparkSession)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given()
        for batch in batches:
            counts = zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True)
            found = [model.vector(Counter(dict(zip([x.encode("latin-1") for x in w], n, strict=True)))) for w, n in counts]
            blobs = [pa.array([f[i].astype(t).tobytes() for f in found], pa.binary()) for i, t in ((0, np.int32), (1, np.float32))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "label", "weight")], *blobs], ["id", "label", "weight", "terms", "weights"])

    table = stored(examples.mapInArrow(vectors, "id long, label int, weight double, terms binary, weights binary"))
    # at most two times max_examples rows
    rows = table.orderBy("id", "terms").toArrow()
    terms = [np.frombuffer(b, np.int32) for b in rows.column("terms").to_pylist()]
    weights = [np.frombuffer(b, np.float32) for b in rows.column("weights").to_pylist()]
    label, weight = rows.column("label").to_numpy(), rows.column("weight").to_numpy()
    empty = np.array([not len(t) for t in terms])
    model.none = float(weight[empty & (label == 1)].sum() / weight[empty].sum()) if empty.any() else model.base
    owner = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
    votes, ids = weight / np.where(label == 1, weight[label == 1].sum(), weight[label == 0].sum()) * len(label), rows.column("id").to_numpy()
    terms, weights = np.concatenate(terms), np.concatenate(weights)
    del rows
    model.index = BlockMaxIndex.build(owner, terms, weights, label, votes, ids, len(model.vocabulary))
    del owner, terms, weights
    release_memory()
    # the vectors are stored, so no task asks for their broadcast again
    core.destroy()
    model.shared = (words, sc.broadcast((model.weights, vars(model.index))))
    given_all = model.packed(examples.sparkSession)

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given_all()
        for batch in batches:
            own, label, weight, terms, values = (batch.column(c).to_pylist() for c in ("id", "label", "weight", "terms", "weights"))
            rows = [i for i, t in enumerate(terms) if t]
            found = model.votes([(np.frombuffer(terms[i], np.int32), np.frombuffer(values[i], np.float32).astype(float)) for i in rows], [own[i] for i in rows])
            bins = [min(BINS - 1, int(v * BINS)) for v, _ in found]
            arrays = [pa.array(bins, pa.int32()), pa.array([label[i] for i in rows], pa.int32()), pa.array([weight[i] for i in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["bin", "label", "weight"])

    spread = table.repartition(16, F.xxhash64("id"))
    seen = np.zeros((2, BINS))
    for r in spread.mapInArrow(outcomes, "bin int, label int, weight double").groupBy("bin", "label").agg(F.sum("weight").alias("w")).collect():
        seen[r["label"], r["bin"]] += r["w"]
    prior = (np.arange(BINS) + 0.5) / BINS  # a bin without examples keeps the vote itself
    model.steps = rising((seen[1] + prior) / (seen.sum(0) + 1), seen.sum(0) + 1)
    return model


def toxicity(text: Column, model: ToxicityModel, spark) -> Column:
    """score (0 to 1) and evidence, the nearest examples (id, label, cosine; of equal ones those first in the index), of a
    text. Null, empty and unknown texts share the score of examples without words and have no evidence; long texts are
    taken whole."""
    found = _scored(model, spark, lambda score, near: (score, [{"id": i, "label": y, "cosine": c} for i, y, c in near]))

    @F.pandas_udf(SCORED)
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in found(texts):
            yield pd.DataFrame(rows, columns=["score", "evidence"])

    return scored(text.cast("string"))


def toxicity_score(text: Column, model: ToxicityModel, spark) -> Column:
    """The score of toxicity() alone: no evidence is kept or sent."""
    found = _scored(model, spark, lambda score, near: score)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in found(texts):
            yield pd.Series(rows, dtype="float64")

    return scored(text.cast("string"))


def _scored(model: ToxicityModel, spark, shape):
    """For batches of texts, shape(score, neighbours) of each; recent texts are looked up."""
    given = model.packed(spark)

    def run(texts: Iterator[pd.Series]) -> Iterator[list]:
        model, kept = given(), {}
        for part in texts:
            if len(kept) > MEMO_TEXTS:
                kept.clear()
            keys = [(hash(t), len(t or "")) for t in part]
            new = {key: t for key, t in zip(keys, part, strict=True) if key not in kept}
            names = list(new)
            for at in range(0, len(names), TOGETHER):
                some = names[at : at + TOGETHER]
                found = model.scores([Counter(terms_of(new[key].encode() if new[key] else b"")) for key in some])
                kept.update({key: shape(score, near) for key, (score, near) in zip(some, found, strict=True)})
            yield [kept[key] for key in keys]
        kept.clear()
        release_pages()

    return run
