"""Secret scans: fixed patterns, and tokens that a battery of randomness tests tells from text.

Candidates are runs of the characters of common encodings, those of the fixed patterns among them. The encoding is the
narrowest that fits the characters, and three tests ask whether the token could be random in it: chi-squared uniformity
over the alphabet, runs above and below the middle of the alphabet, and lag-one serial correlation. A candidate that the
tests, combined, find not random has p-value 1. For the others it is the probability that a token of its length, whose
characters are as uneven as those of the whole corpus in that alphabet, would look so even. Short tokens can't give strong
evidence, so the Benjamini-Hochberg procedure runs over all candidates with weights in proportion to length, of mean 1.
Its threshold comes from counts of candidates over fixed bins of evidence, whose number doesn't depend on the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import portions, stored

KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<kind:string,start:int,end:int,alphabet:int,n:int,stat:double,random:double,covered:boolean>>"
SPAN_FIELDS = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("alphabet", pa.int32()), ("n", pa.int32()), ("stat", pa.float64()), ("random", pa.float64()), ("covered", pa.bool_())])
#: Evidence is -10 log10 of the weighted p-value, rounded down; the last bin is open.
BINS = 400
#: Combined p-value below which a token isn't random in its encoding.
RANDOM_ALPHA = 0.005
#: Least unevenness of characters that aren't random (chi-squared grows by as much for each of them): that of half the
#: alphabet, all in equal shares.
LEAST_UNEVENNESS = 1.0
#: Shortest token, and length beyond which weight doesn't grow.
MIN_LENGTH, FULL_LENGTH = 20, 128

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_LENGTH)

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets, narrow ones first.
ENCODINGS = (
    ("decimal", DIGITS), ("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("lower", LOWER), ("upper", UPPER), ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER), ("BASE36", DIGITS + UPPER), ("letters", UPPER + LOWER), ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"),
)
_SETS = [(frozenset(a), {c: i for i, c in enumerate(a)}) for _, a in ENCODINGS]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by start and then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def encoding_of(token: str) -> tuple[str, int] | None:
    """The characters to test and the number of the narrowest alphabet that has them all. Dashes that cut a token into
    groups of four characters or more are no data."""
    groups = token.split("-")
    body = "".join(groups) if len(groups) > 2 and min(map(len, groups)) >= 4 else token
    chars = set(body)
    found = next((i for i, (s, _) in enumerate(_SETS) if chars <= s), None)
    return None if found is None or len(body) < MIN_LENGTH else (body, found)


def upper_tail(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def chi2_upper(x: float, k: float) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson and Hilferty's normal approximation)."""
    return upper_tail(((max(x, 1e-9) / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k)))


def battery(body: str, alphabet: int) -> tuple[float, float]:
    """(chi-squared of the characters, combined p-value of randomness)."""
    n, (_, places) = len(body), _SETS[alphabet]
    size = len(places)
    place = np.fromiter(map(places.__getitem__, body), np.int64, n)
    counts = np.bincount(place, minlength=size)
    stat = float(((counts - n / size) ** 2).sum() * size / n)
    ps = [chi2_upper(stat, size - 1)]
    high = place >= size / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        ps.append(2 * upper_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / spread))
    else:
        ps.append(2.0 ** (1 - n))
    centred = place - place.mean()
    total = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / total if total else 1.0
    ps.append(2 * upper_tail(abs(r + 1 / n) * math.sqrt(n)))
    fisher = -2 * sum(math.log(max(min(p, 1.0), 1e-300)) for p in ps)
    half = fisher / 2
    return stat, math.exp(-half) * (1 + half + half * half / 2)


def evenness(stat: float, n: int, size: int, squares: float, cubes: float) -> float:
    """The probability that n characters of an alphabet of the given size, drawn with shares whose squares and cubes have
    these sums, have a chi-squared of stat or less: a scaled chi-squared with the true mean and variance."""
    mean = size * (1 + (n - 1) * squares) - n
    spread = 2 * size * size * (n - 1) / n * (squares + 2 * (n - 2) * cubes - (2 * n - 3) * squares * squares)
    free = 2 * mean * mean / spread
    return 1 - chi2_upper(stat * free / mean, free)


def spans_of(text: str) -> list[tuple]:
    """Spans as SPANS: those of the fixed patterns (alphabet -1), then the candidates; covered ones overlap a fixed one."""
    base = base_spans(text)
    out = [(*x, -1, 0, 0.0, 0.0, False) for x in base]
    # the farthest end of the base spans that begin before a place; both lists are in order
    at, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        token = m[0].strip("-_/+")
        found = encoding_of(token)
        if found is None:
            continue
        start = m.start() + m[0].index(token)
        end = start + len(token)
        while at < len(base) and base[at][1] < end:
            reach = max(reach, base[at][2])
            at += 1
        out.append(("random", start, end, found[1], len(found[0]), *battery(*found), reach > start))
    return out


@dataclass
class Family:
    """What all candidates of a corpus say about one: their number and mean weight, the sums of the squares and cubes of
    the characters' shares in each alphabet, and the least bin of evidence that is a discovery."""

    total: int
    mean: float
    uneven: list[tuple[float, float]]
    least: int = BINS

    def level(self, alphabet: int, n: int, stat: float, random_p: float) -> int:
        """The bin of evidence of a candidate."""
        if random_p < RANDOM_ALPHA:
            return 0
        p = evenness(stat, n, len(_SETS[alphabet][1]), *self.uneven[alphabet])
        weighted = max(p, 1e-300) * self.mean / min(n, FULL_LENGTH)
        return min(BINS - 1, max(0, int(-10 * math.log10(min(weighted, 1.0)))))


def unevenness(counts: np.ndarray) -> list[tuple[float, float]]:
    """For each alphabet the sums of the squares and of the cubes of its characters' shares, as far as these are less even
    than LEAST_UNEVENNESS; counts: by byte."""
    out = []
    for _, alphabet in ENCODINGS:
        size, n = len(alphabet), counts[[ord(c) for c in alphabet]].astype(float) + 1
        share = n / n.sum()
        squares = float((share**2).sum())
        out.append((squares, float((share**3).sum())) if size * squares - 1 > LEAST_UNEVENNESS else (2 / size, 4 / size**2))
    return out


def discovery_bin(candidates: dict[int, int], alpha: float) -> int:
    """The least bin of evidence that Benjamini-Hochberg accepts, for counts of all candidates by bin."""
    total, seen, least = sum(candidates.values()), 0, BINS
    for level in sorted(candidates, reverse=True):
        seen += candidates[level]
        if 10 ** (-level / 10) <= alpha * seen / max(total, 1):
            least = level
    return least


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each text; the first row of a batch carries the counts of the batch's bytes."""
    for batch in portions(batches, "text"):
        texts = batch.column("text").to_pylist()
        found = [[dict(zip(SPAN_FIELDS.names, x, strict=True)) for x in spans_of(t or "")] for t in texts]
        seen = np.bincount(np.frombuffer("".join([t or "" for t in texts]).encode(), np.uint8), minlength=128)[:128]
        counts = [seen.tolist(), *[None] * (len(texts) - 1)]
        arrays = [batch.column("id"), pa.array(found, pa.list_(SPAN_FIELDS)), pa.array(counts, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "spans", "counts"])


def scanned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return stored(rows.mapInArrow(_scan, f"id {kind}, spans {SPANS}, counts array<long>"))


def levels(spans: Column, family: Family) -> Column:
    """The bin of evidence of each span, -1 for those of the fixed patterns."""

    @F.pandas_udf("array<int>")
    def of(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in columns:
            yield pd.Series([[family.level(s["alphabet"], s["n"], s["stat"], s["random"]) if s["alphabet"] >= 0 else -1 for s in row] for row in part], dtype=object)

    return of(spans)


def family_of(found: DataFrame, alpha: float) -> Family:
    """The family of all candidates of scanned texts."""
    length = F.least("s.n", F.lit(FULL_LENGTH))
    total, mean = found.select(F.explode("spans").alias("s")).where("s.alphabet >= 0").agg(F.count("*"), F.avg(length)).first()
    counts = np.zeros(128, np.int64)
    for r in found.select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n")).collect():
        counts[r[0]] = r[1]
    family = Family(total, mean or 1.0, unevenness(counts))
    bins = found.where(F.size("spans") > 0).select(F.explode(levels(F.col("spans"), family)).alias("bin")).where("bin >= 0").groupBy("bin").count().collect()
    family.least = discovery_bin({r[0]: r[1] for r in bins}, alpha)
    return family


def redact(df: DataFrame, alpha: float = 0.01, text_col: str = "text") -> DataFrame:
    """df with every secret in text_col replaced by its kind in angle brackets; overlapping ones by the kind of the first.

    Null stays null, empty texts stay empty, long texts are taken whole; no row goes, repeated rows are each cleaned, an
    empty table stays empty, and other columns stay as they are, whatever their names.
    """
    family = family_of(scanned(df.select(F.lit(0).alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text"), alpha)

    @F.pandas_udf("string")
    def cleaned(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def clean(text: str | None) -> str | None:
            end = 0
            out = []
            for kind, start, stop, *test, covered in sorted(spans_of(text or ""), key=lambda s: (s[1], s[2])):
                if covered or (test[0] >= 0 and family.level(*test) < family.least) or stop <= end:
                    continue
                out += [text[end : max(start, end)], f"<{kind}>" if start >= end else ""]
                end = stop
            return "".join([*out, text[end:]]) if end else text

        for part in texts:
            yield pd.Series([clean(t) for t in part], dtype=object)

    return df.withColumn(text_col, cleaned(F.col(f"`{text_col}`")))


def find_secrets(df: DataFrame, alpha: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its id and spans, an array of (kind, start, end) by start and then kind.

    Positions are code points, ends exclusive. Kinds: assign, access and hex are fixed patterns; random are tokens that
    the tests find and no fixed pattern touches. Null and empty texts have no spans; long texts are taken whole; repeated
    rows are each scanned, and each counts in the family of tests; an empty table gives an empty result; further columns
    are ignored, whatever their names.
    """
    found = scanned(df, id_col, text_col)
    family = family_of(found, alpha)
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    # texts without spans, nearly all, don't go through Python again
    level = F.when(F.size("spans") > 0, levels(F.when(F.size("spans") > 0, F.col("spans")).otherwise(F.array().cast(SPANS)), family))
    with_level = F.transform("spans", lambda s, i: F.struct(s.alias("s"), F.get("level", i).alias("level")))
    kept = F.filter(with_level, lambda x: (x["level"] < 0) | ((x["level"] >= family.least) & ~x["s"]["covered"]))
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct(x["s"]["start"].alias("start"), F.try_element_at(rank, x["s"]["kind"]).alias("rank"), x["s"]["end"].alias("end"), x["s"]["kind"].alias("kind"))))
    rows = found.withColumn("level", level)
    return rows.select(F.col("id").alias(id_col), F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
