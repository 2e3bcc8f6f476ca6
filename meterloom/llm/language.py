"""Language identification by hierarchical discrimination.

A text is the mean of its hashed byte trigrams (case folded, everything that is no letter a space). A linear support
vector machine for every two families votes for the family, and machines for every two languages of that family vote
among closely related languages. All machines are columns of one weight matrix, so a batch of texts is scored by one
gather and one segmented sum over its bytes.

The machines learn from a sample of at most MAX_EXAMPLES texts of each language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.llm.common import portions, stored, text_bytes

BITS, MAX_EXAMPLES, SCALE, PENALTY, SWEEPS = 14, 300, 40.0, 1.0, 15
#: Common language families by ISO 639-1 code; a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy gd br",
    "turkic": "tr az kk uz",
    "indo-aryan": "hi bn ur mr ne pa gu",
    "semitic": "ar he",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in order, and where those of each text begin; every text has one at least."""
    joined = np.frombuffer(b"".join(b" " + t.translate(FOLD) + b"  " for t in texts), np.uint8).astype(np.uint32)
    hashed = (joined[:-2] * np.uint32(0x9E3779B1) ^ joined[1:-1] * np.uint32(0x85EBCA6B) ^ joined[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    sizes = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    return (hashed >> np.uint32(32 - BITS)).astype(np.int32), np.cumsum(sizes) - sizes


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """machines: (level, plus, minus), one for each column of weights; level is a family, or None among families."""

    families: dict[str, list[str]]
    machines: list[tuple[str | None, str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slope: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Margin of every machine for every text."""
        hashed, starts = trigrams(texts)
        ends = np.append(starts[1:], len(hashed))
        out = np.empty((len(texts), len(self.machines)))
        for m in range(len(self.machines)):
            values = np.ascontiguousarray(self.weights[:, m])[hashed]
            out[:, m] = np.add.reduceat(values, starts, dtype=np.float64) / (ends - starts) * SCALE
        return out + self.bias

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        p = 1 / (1 + np.exp(-np.clip(self.margins(texts) * self.slope, -30, 30)))
        family, sure = self._vote(None, sorted(self.families), p)
        names, scores = np.empty(len(texts), object), np.zeros(len(texts))
        for f, members in self.families.items():
            rows = family == f
            name, share = self._vote(f, members, p[rows])
            names[rows], scores[rows] = name, sure[rows] * share
        return names.tolist(), scores.tolist()

    def _vote(self, level: str | None, names: list[str], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One-versus-one votes: the name of the highest sum of probabilities, and its share of what it could get."""
        if len(names) == 1:
            return np.full(len(p), names[0], object), np.ones(len(p))
        votes = np.zeros((len(p), len(names)))
        for m, (at, plus, minus) in enumerate(self.machines):
            if at == level:
                votes[:, names.index(plus)] += p[:, m]
                votes[:, names.index(minus)] += 1 - p[:, m]
        best = votes.argmax(1)
        return np.array(names, object)[best], votes[np.arange(len(p)), best] / (len(names) - 1)


def train_machine(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for a linear machine with squared hinge loss; the bias is a component of value one."""
    w, bias, n = np.zeros(1 << BITS), 0.0, len(rows)
    alpha, shrink = np.zeros(n), 1 / (2 * PENALTY * weight)
    square = np.array([float(v @ v) + 1 for v in values]) + shrink
    rng = np.random.default_rng(0)
    for _ in range(SWEEPS):
        for i in rng.permutation(n):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1 + shrink[i] * alpha[i]
            step = max(alpha[i] - gradient / square[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
    return w, bias


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text"):
        at, counts = [], []
        for t in text_bytes(batch.column("text")):
            found, n = np.unique(trigrams([t or b""])[0], return_counts=True)
            at.append(found)
            counts.append((n / n.sum() * SCALE).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], ["lang", "at", "counts"])


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_examples: int = MAX_EXAMPLES) -> LanguageModel:
    """Learn from the rows of docs with a language and a letter in the text: at most max_examples of each language.

    The sample takes rows by a hash of the id and the text, so it doesn't depend on order; repeated rows and copies count
    as often as they are drawn, and texts are taken whole, however long. One language alone, or none (an empty table),
    gives a model without machines. Columns of other names don't matter. The driver holds one machine for each pair of
    families and of languages within one, which grows with the languages, not with the texts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = rows.groupBy("lang").count().where(F.length("lang") > 0).orderBy(F.desc("count"), "lang")
    counts = {r[0]: r[1] for r in known.collect()}
    families: dict[str, list[str]] = {}
    for lang in sorted(counts):
        families.setdefault(FAMILY_OF.get(lang.lower().split("-")[0], lang), []).append(lang)
    model = LanguageModel(families)
    pairs = [(None, a, b) for a, b in combinations(sorted(families), 2)] + [(f, a, b) for f, names in families.items() for a, b in combinations(names, 2)]
    if not pairs:
        return model
    key = F.xxhash64("id", "text", F.lit("sample"))
    room = F.lit(False)
    for lang, n in counts.items():
        room = room | ((F.col("lang") == lang) & (F.pmod(key, F.lit(1 << 30)) / float(1 << 30) < min(1.0, 1.3 * max_examples / n + 50 / n)))
    order = Window.partitionBy("lang").orderBy("key", "id")
    sample = rows.where(room).withColumn("key", key).withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_examples)
    # bounded by max_examples rows for each language
    found = stored(sample.select("lang", "text").mapInArrow(_features, "lang string, at array<int>, counts array<float>")).orderBy("lang", "at", "counts").collect()
    data = [(r.lang, np.array(r["at"], np.int64), np.array(r["counts"], np.float64)) for r in found]
    family = {lang: f for f, names in families.items() for lang in names}
    columns, bias, slope = [], [], []
    for level, plus, minus in pairs:
        label = (lambda lang: family[lang]) if level is None else (lambda lang: lang)
        use = [(label(lang), at, v) for lang, at, v in data if label(lang) in (plus, minus)]
        y = np.array([1.0 if name == plus else -1.0 for name, _, _ in use])
        share = np.array([(y == s).mean() for s in y])
        w, b = train_machine([at for _, at, _ in use], [v for _, _, v in use], y, 0.5 / share)
        margin = np.array([float(w[at] @ v) + b for _, at, v in use]) * y
        columns.append(w.astype(np.float32))
        bias.append(b)
        slope.append(_slope(margin, 0.5 / share))
    model.machines, model.weights = pairs, np.ascontiguousarray(np.stack(columns, 1))
    model.bias, model.slope = np.array(bias), np.array(slope)
    return model


def _slope(margin: np.ndarray, weight: np.ndarray) -> float:
    """The slope that makes a logistic function of the margins likeliest, within bounds, by golden sections."""
    low, high, ratio = 0.2, 20.0, (math.sqrt(5) - 1) / 2
    loss = lambda s: float(weight @ np.logaddexp(0, -s * margin)) + 0.05 * s
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return (low + high) / 2


def language(text: Column, model: LanguageModel, spark) -> Column:
    """struct(lang, score) of a whole text; und and 0 for a null text, one without letters, or a model without languages.
    Of languages with equal sums of probabilities the first by name is taken; equal texts get equal predictions."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            names, scores = ["und"] * len(part), [0.0] * len(part)
            rows = [i for i, t in enumerate(part) if has_letter(t)] if shared.value.families else []
            at = 0
            while at < len(rows):
                end, size, batch = at, 0, []
                while end < len(rows) and (not batch or size < 1 << 20):
                    batch.append(part.iat[rows[end]].encode())
                    size += len(batch[-1])
                    end += 1
                for i, name, score in zip(rows[at:end], *shared.value.predict(batch), strict=True):
                    names[i], scores[i] = name, min(1.0, max(0.0, score))
                at = end
            yield pd.DataFrame({"lang": names, "score": scores})

    return predicted(text.cast("string"))
