"""Language-model scoring by logistic context mixing.

A text is its sequence of tokens: words in lower case (A-Z), then an end. White space isn't coded, as in the base. Every
token is coded as binary decisions, each predicted by several contexts whose logits a gated mixer adds up:

1. Copies: "is it the word that mostly followed the last two words?" The hashed pair of words names a context, and the
   successors of every context are counted over all training texts. How sure the counts are, what the last decisions
   were, and how long the run of hits is predict the bit.
2. Repeats: "is it the word that followed the last two words earlier in this text?", predicted likewise.
3. Otherwise the path to the word in a balanced tree over the common words in order of their letters. At each node the
   counts of all training texts, and those of the class of texts that the tokens so far point to, predict the bit. Words
   outside the tree take the leaf of an escape, and are spelled in bytes by the mixer of meterloom.llm.spelling. Classes
   are found by k-means over all training texts, in passes over their stored features.

Mixers are fitted to counts over all training texts, refined by a map of what really happened in each context, and the
mixers of copies and repeats go on learning inside each text, in blocks of decisions, from that common start. So what
one text adapts never reaches another. The spelling mixer is averaged over parts that the windows' hashes decide, so scores
don't depend on how the input lies in files. A training text isn't predicted from itself: copies are counted without the occurrence at hand.

Texts are split twice, to count words and to store tokens in batches; all later steps read the latter. Contexts are a
shuffled table that grows with the corpus: batches send their distinct (context, word) pairs to the partition of the
context, packed, and get one byte back for each. Only the commonest words, the tree over them and the spelling slots, all
of bounded size, are broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import discard, portions, scratch_path, stored, text_bytes
from meterloom.llm.spelling import MixingModel, fit_model, memoised, windows

TOP_WORDS, FLUSH_WORDS = 1 << 17, 150_000
#: Classes of texts, hashes of words of at most SHORT bytes that tell them apart, and rounds of k-means.
CLASSES, FEATURES, SHORT, ROUNDS = 8, 4096, 4, 6
#: Random planes that part the training texts into the groups whose means k-means starts from.
PLANES = np.random.default_rng(47).choice([-1.0, 1.0], (FEATURES, 8))
#: Fixed point of sums over texts, which then don't depend on their order; leaves whose counts are added in one group.
FIXED, LEAVES = 1 << 20, 4096
#: Bytes of text in a batch, and training tokens for each partition of contexts.
TEXT_BYTES, PART_TOKENS = 4 << 20, 500_000
RARE = np.uint32(1 << 31)
#: Decisions between two steps of a text's own mixer, and the size of a step.
BLOCK, RATE, ADD = 64, 0.02, 0.4
U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_weights(x: np.ndarray, hits: np.ndarray, total: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Logistic weights of the rows x, each seen total times with hits ones, by Newton steps from start."""
    w = start.astype(float)
    for _ in range(8):
        p = sigmoid(x @ w)
        slope = x.T @ (hits - total * p) - (w - start)
        bend = (x * (total * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w + np.clip(np.linalg.solve(bend, slope), -1, 1)
    return w


# --- classes of texts -------------------------------------------------------------------------------------------------


def added(df: DataFrame, run: Callable[[dict], Iterator[tuple[np.ndarray, np.ndarray]]], shape: tuple[int, ...], piece: int) -> np.ndarray:
    """The sum of the whole numbers in the arrays of the given shape that run(rows) returns in each task, added up in tasks
    by pieces of the last axis."""
    lead, last = int(np.prod(shape[:-1])), shape[-1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = run(row for batch in batches for row in batch.to_pylist())
        if found is not None:
            flat = found.reshape(lead, last).astype(np.int64)
            blobs = [squeezed(flat[:, at : at + piece].reshape(-1)) for at in range(0, last, piece)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], ["piece", "blob"])

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        n = lead * min(piece, last - key[0].as_py() * piece)
        out = np.zeros(n, np.int64)
        for blob in rows.column("blob"):
            out += restored(blob.as_py(), n, np.int64)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([squeezed(out)], pa.binary())})

    out = np.zeros((lead, last), np.int64)
    for r in df.mapInArrow(partial, "piece int, blob binary").groupBy("piece").applyInArrow(total, "piece int, blob binary").toLocalIterator():
        at = r["piece"] * piece
        width = min(piece, last - at)
        out[:, at : at + width] = restored(bytes(r["blob"]), lead * width, np.int64).reshape(lead, width)
    return out.reshape(shape)


def kinds(row: dict, learn: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, starts, features): the texts of a batch that have features (learn: training texts only), and where in
    features those of each begin."""
    sizes = restored(row["kind_sizes"], row["n"], np.uint16).astype(np.int64)
    flat = restored(row["kinds"], int(sizes.sum()), np.uint16).astype(np.int64)
    used = sizes > 0
    if learn:
        used &= restored(row["learn"], row["n"], np.uint8) > 0
    flat, sizes = flat[np.repeat(used, sizes)], sizes[used]
    return np.flatnonzero(used), np.cumsum(sizes) - sizes, flat


def nearest(centres: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The class of each text, whose largest sum of the (fixed-point) figures of its features it has."""
    return np.argmax(np.add.reduceat(centres[flat], starts, axis=0), 1) if len(starts) else np.zeros(0, np.int64)


def _fixed(centres: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Figures of features by class: with them the largest sum is the largest cosine."""
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return np.rint(unit * weights * FIXED).astype(np.int64).T.copy()


def _starts(means: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CLASSES starts from the means of groups: far apart, then moved by k-means over the groups with their sizes."""
    means, sizes = means[sizes > 0], sizes[sizes > 0]
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    chosen = [int(np.argmax(sizes))]
    near = unit @ unit[chosen[0]]
    while len(chosen) < min(CLASSES, len(unit)):
        # a group counts by its size too, so that a few odd texts are no class of their own
        chosen.append(int(np.argmax((1 - near).clip(0) * np.sqrt(sizes))))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    centres = unit[chosen]
    for _ in range(12):
        own = np.argmax(unit @ centres.T, 1)
        sums = np.stack([means[own == k].sum(0) for k in range(len(centres))])
        sums = np.where(sums.any(1)[:, None], sums, centres)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def find_classes(texts: DataFrame) -> np.ndarray:
    """Fixed-point figures of each feature (row) for each class: see nearest(). k-means by cosine over all training texts
    of the stored batches, weighted by inverse document frequency: one pass counts features, one sums the texts in the
    groups that random planes cut, and each round moves the centres. Few texts are one class."""
    texts = texts.select("n", "learn", "kinds", "kind_sizes")
    sc = texts.sparkSession.sparkContext

    def frequencies(rows: Iterator[dict]) -> np.ndarray:
        out = np.zeros(FEATURES + 1)
        for row in rows:
            at, _, flat = kinds(row)
            out[:-1] += np.bincount(flat, minlength=FEATURES)
            out[-1] += len(at)
        return out

    counts = added(texts, frequencies, (FEATURES + 1,), FEATURES + 1)
    n, df = int(counts[-1]), counts[:-1]
    if n < 2 * CLASSES:
        return np.zeros((FEATURES, 1), np.int64)
    weights = np.log(n / (1 + df)).clip(0)

    def sums(groups: int, group: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        """Sums of the unit vectors of texts by group, and (last column) their number."""

        def run(rows: Iterator[dict]) -> np.ndarray:
            out = np.zeros((groups, FEATURES + 1))
            for row in rows:
                at, starts, flat = kinds(row)
                if not len(at):
                    continue
                own, squares = group(starts, flat), np.add.reduceat(weights[flat] ** 2, starts)
                sizes = np.diff(np.append(starts, len(flat)))
                values = np.rint(weights[flat] / np.repeat(np.sqrt(np.maximum(squares, 1e-12)), sizes) * FIXED)
                out[:, :-1] += np.bincount(np.repeat(own, sizes) * FEATURES + flat, values, groups * FEATURES).reshape(groups, FEATURES)
                out[:, -1] += np.bincount(own, minlength=groups)
            return out

        return added(texts, run, (groups, FEATURES + 1), 256)

    # the planes lie at the mean text, so that groups are of like sizes
    planes = np.rint(PLANES * weights[:, None] * FIXED).astype(np.int64)
    middle = (planes * (df / n)[:, None]).sum(0)
    powers = 1 << np.arange(PLANES.shape[1])
    shared = sc.broadcast((planes, middle))
    found = sums(1 << PLANES.shape[1], lambda starts, flat: ((np.add.reduceat(shared.value[0][flat], starts, axis=0) > shared.value[1]) * powers).sum(1))
    centres = _starts(found[:, :-1].astype(float), found[:, -1])
    for _ in range(ROUNDS):
        figures = sc.broadcast(_fixed(centres, weights))
        moved = sums(len(centres), lambda starts, flat, figures=figures: nearest(figures.value, starts, flat))[:, :-1].astype(float)
        moved = np.where(moved.any(1)[:, None], moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12), centres)
        still, centres = np.abs(moved - centres).max() < 1e-6, moved
        if still:
            break
    return _fixed(centres, weights)


def class_counts(texts: DataFrame, classes: np.ndarray, leaves: int) -> np.ndarray:
    """How often each leaf (the last: words outside the tree) comes in the training texts of each class. Texts without
    features are of the first class."""
    shared, k = texts.sparkSession.sparkContext.broadcast(classes), classes.shape[1]

    def run(rows: Iterator[dict]) -> np.ndarray:
        out = np.zeros(k * leaves, np.int64)
        for row in rows:
            sizes = restored(row["sizes"], row["n"], np.int32)
            tokens = restored(row["blob"], int(sizes.sum()), np.uint32)
            own, (at, starts, flat) = np.zeros(row["n"], np.int64), kinds(row)
            own[at] = nearest(shared.value, starts, flat)
            taught = np.repeat(restored(row["learn"], row["n"], np.uint8) > 0, sizes)
            places = np.repeat(own * leaves, sizes)[taught] + np.minimum(tokens[taught], leaves - 1)
            out += np.bincount(places, minlength=len(out))
        return out.reshape(k, leaves)

    return added(texts.select("n", "learn", "kinds", "kind_sizes", "sizes", "blob"), run, (k, leaves), LEAVES)


# --- words ------------------------------------------------------------------------------------------------------------


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n); the empty word is the end of a text."""
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in portions(batches, "text"):
        for t in text_bytes(batch.column("text")):
            counts.update((t or b"").lower().split())
        counts[b""] += batch.num_rows
        if len(counts) > FLUSH_WORDS:
            yield rows()
            counts.clear()
    yield rows()


def common_words(words: DataFrame, most: int) -> list[tuple]:
    """The rows of all words that are met twice, and at least so often that there are at most `most` of them, and of the
    end. Words met once stand for unknown ones and are left to the escape."""
    level = F.floor(F.log2("n") * 4).cast("int")
    counts = sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, least = 0, 1 << 20
    for r in counts:
        total += r[1]
        if total > most or r[0] == 0:
            break
        least = r[0]
    rows = words.where((level >= least) | (F.col("word") == "")).toLocalIterator()
    return sorted((r["word"].encode(), *r[1:]) for r in rows)


def tree_table(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 of the probability of each leaf, by class and (last row) without one; counts: of leaves in order, all above
    zero; classes: the same by class. Every inner node is a decision (1: right half)."""
    d, k = len(counts), len(classes)
    sums = np.concatenate([[0], np.cumsum(counts)])
    by_class = np.concatenate([np.zeros((k, 1)), np.cumsum(classes, 1)], 1)
    lo, hi = np.array([0]), np.array([d])
    levels = []
    while len(lo):
        mid = np.clip(np.searchsorted(sums, (sums[lo] + sums[hi]) / 2), lo + 1, hi - 1)
        levels.append((lo, mid, hi))
        lo, hi = np.stack([lo, mid], 1).reshape(-1), np.stack([mid, hi], 1).reshape(-1)
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        if not len(lo):
            break
    if d == 1:
        return np.zeros((k + 1, 1), np.float32)
    lo, mid, hi = (np.concatenate(x) for x in zip(*levels, strict=True))
    left, right = sums[mid] - sums[lo], sums[hi] - sums[mid]
    whole = np.log((right + ADD) / (left + ADD))
    cl, cr = by_class[:, mid] - by_class[:, lo], by_class[:, hi] - by_class[:, mid]
    gate = np.minimum(np.log2(cl + cr + 1).astype(int), 15)
    own = np.log((cr + ADD) / (cl + ADD))
    # each outcome is predicted without its own occurrence
    right_out, left_out = np.log((np.maximum(cr - 1, 0) + ADD) / (cl + ADD)), np.log((cr + ADD) / (np.maximum(cl - 1, 0) + ADD))
    weights = np.tile([1.0, 0.0], (16, 1))
    for g in range(1, 16):
        at = gate == g
        if at.any():
            every = np.broadcast_to(whole, own.shape)[at]
            x = np.concatenate([np.stack([every, right_out[at]], 1), np.stack([every, left_out[at]], 1)])
            n = np.concatenate([cr[at], cl[at]])
            weights[g] = fit_weights(x, np.concatenate([cr[at], np.zeros(at.sum())]), n, np.array([0.5, 0.5]))
    z = np.concatenate([weights[gate][..., 0] * whole + weights[gate][..., 1] * own, whole[None]])
    # the order of nodes is by level, so a level adds to disjoint runs of leaves
    yes, no = -np.logaddexp(0, -z) / np.log(10), -np.logaddexp(0, z) / np.log(10)
    table, at = np.zeros((k + 1, d + 1)), 0
    for a, m, b in levels:
        n = len(a)
        steps = np.zeros((k + 1, d + 1))
        np.add.at(steps, (slice(None), a), no[:, at : at + n])
        np.add.at(steps, (slice(None), m), yes[:, at : at + n] - no[:, at : at + n])
        np.add.at(steps, (slice(None), b), -yes[:, at : at + n])
        table += np.cumsum(steps, 1)
        at += n
    return table[:, :d].astype(np.float32)


@dataclass
class Words:
    """The common words with log10 of their counts and one, and their features (-1: none)."""

    places: dict[bytes, int]
    logs: np.ndarray
    kinds: np.ndarray


def fit_words(words: DataFrame, most: int) -> tuple[Words, int, int]:
    """(common words, training tokens, distinct words)"""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = common_words(words, most) if total[1] else [(b"", 0)]
    kind = np.array([zlib.crc32(w) % FEATURES if 0 < len(w) <= SHORT else -1 for w, _ in rows], np.int64)
    return Words({w: i for i, (w, _) in enumerate(rows)}, np.log10(np.array([n for _, n in rows], float) + 1), kind), total[0], total[1]


# --- contexts of two words --------------------------------------------------------------------------------------------


def contexts(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of the two tokens before each token of its text."""
    one, two = np.zeros(len(tokens), np.uint64), np.zeros(len(tokens), np.uint64)
    wide = tokens.astype(np.uint64) + U(3)
    one[1:], two[2:] = wide[:-1], wide[:-2]
    one[starts], two[starts] = 1, 1
    second = starts + 1
    second = second[second < len(tokens)]
    two[np.setdiff1d(second, starts)] = 2
    return _mixed(one + (two << U(32)))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each distinct key is, in order of the keys, and for every key the number of its own."""
    order = np.argsort(keys)
    ordered = keys[order]
    head = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(head) - 1
    return order[head], back


@dataclass
class Requests:
    """The distinct (context, token) of a batch, by the partition of the context. back leads from tokens to requests."""

    part: np.ndarray
    rest: np.ndarray
    token: np.ndarray
    learn: np.ndarray
    count: np.ndarray
    back: np.ndarray

    @classmethod
    def of(cls, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, learn: np.ndarray, parts: int) -> Requests:
        at, taught = contexts(tokens, starts), np.repeat(learn, sizes)
        whole = _mixed(at + tokens.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F)) << U(1) | taught.astype(np.uint64)
        first, back = distinct(whole)
        count = np.bincount(back, minlength=len(first))
        at = at[first]
        part = ((at >> U(32)) % U(parts)).astype(np.int64)
        order = np.argsort((part << 32) | (at & U(0xFFFFFFFF)).astype(np.int64))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return cls(part[order], (at[order] & U(0xFFFFFFFF)).astype(np.uint32), tokens[first][order], taught[first][order], count[order], place[back])


def squeezed(x: np.ndarray) -> bytes:
    """The bytes of numbers by significance, compressed."""
    return pa.compress(np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).T).tobytes(), codec="zstd", asbytes=True)


def restored(data: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).reshape(-1)


def successors(rest: np.ndarray, token: np.ndarray, count: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """A byte for each request: 0 where its context has no other training occurrence, else 1 + hit * 32 + state, where
    state says how often the candidate (the commonest successor, ties to the smaller token) and other words came."""
    key = rest.astype(np.uint64) << U(32) | token
    first, pair_of = distinct(key)
    if not len(first):
        return np.zeros(0, np.uint8)
    n = np.bincount(pair_of, count * learn, len(first)).astype(np.int64)
    context = rest[first]
    heads = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    lengths = np.diff(np.append(heads, len(first)))
    owner = np.repeat(np.arange(len(heads)), lengths)
    total, most = np.add.reduceat(n, heads), np.maximum.reduceat(n, heads)
    leading = np.flatnonzero(n == most[owner])
    best = leading[np.searchsorted(leading, heads)]
    others = n.copy()
    others[best] = 0
    second_n = np.maximum.reduceat(others, heads)
    mine, c = pair_of, owner[pair_of]
    own = learn.astype(np.int64)
    is_best = best[c] == mine
    top = n[best[c]] - own * is_best
    # without its own occurrence the best successor may fall behind the second
    beaten = is_best & (second_n[c] > top)
    top = np.where(beaten, second_n[c], top)
    # a token may be the second itself when the best is another: then it is no hit
    hit = is_best & ~beaten
    others = total[c] - own - top
    state = np.minimum(np.where(top >= 4, 3, top - 1), 3) * 8 + np.minimum(np.ceil(np.log2(others.clip(0) + 1)), 7).astype(np.int64)
    return np.where(top > 0, 1 + hit * 32 + state.clip(0), 0).astype(np.uint8)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to the requests of one partition of contexts after another; rows come sorted by partition."""
    held: list[dict] = []

    def answered() -> pa.RecordBatch:
        sizes = [r["n"] for r in held]
        rest, token, count = (np.concatenate([restored(r[c], r["n"], np.uint32) for r in held]) for c in ("rest", "token", "count"))
        learn = np.concatenate([restored(r["learn"], r["n"], np.uint8) for r in held])
        found = np.split(successors(rest, token, count, learn), np.cumsum(sizes)[:-1])
        arrays = [[r["batch"] for r in held], [r["part"] for r in held], [squeezed(x) for x in found], sizes]
        return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, (pa.int64(), pa.int32(), pa.binary(), pa.int32()), strict=True)], ["batch", "part", "blob", "n"])

    for batch in batches:
        for row in batch.to_pylist():
            if held and row["part"] != held[0]["part"]:
                yield answered()
                held = []
            held.append(row)
    if held:
        yield answered()


# --- decisions --------------------------------------------------------------------------------------------------------

HISTORY, RUNS = 27, 8
#: Cells of the two kinds of decisions: state of the context, history, run.
CELLS = (32 * HISTORY * RUNS, 2 * HISTORY * RUNS)
_LEVELS = np.array([0, 1, 2, 3, 4, 4, 5, 5, 5, 6, 6, 6, 6, 6, 6, 6, 7])


def past(states: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """history * RUNS + run of each token, from the states (0 none, 1 miss, 2 hit) of the tokens before it in its text."""
    n = len(states)
    inner = np.arange(n) - np.repeat(starts, sizes)
    history = np.zeros(n, np.int64)
    for back, weight in ((1, 1), (2, 3), (3, 9)):
        history[back:] += weight * np.where(inner[back:] >= back, states[:-back] if n > back else 0, 0)
    last = np.maximum.accumulate(np.where(states != 2, np.arange(n), -1))
    before = np.append(-1, last[:-1])
    run = np.minimum(np.arange(n) - 1 - before, inner)
    return history * RUNS + _LEVELS[np.minimum(run, 16)]


@dataclass
class Decisions:
    """Mixer of one kind of decision. gate: by cell; logits: of the contexts of each cell, and a bias."""

    gate: np.ndarray
    logits: np.ndarray
    refine: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, hits: np.ndarray, total: np.ndarray) -> Decisions:
        cells = np.arange(len(total))
        run, history, state = cells % RUNS, cells // RUNS % HISTORY, cells // (RUNS * HISTORY)
        logits = []
        for key in (state, history * RUNS + run, state * RUNS + run, state * HISTORY + history):
            h, t = np.bincount(key, hits), np.bincount(key, total)
            logits.append(np.log((h + ADD) / (t - h + ADD))[key])
        logits.append(np.full(len(cells), 0.3))
        x = np.stack(logits, 1)
        weights = np.tile([0.25, 0.25, 0.25, 0.25, 0.0], (RUNS, 1))
        for g in range(RUNS):
            at = run == g
            weights[g] = fit_weights(x[at], hits[at], total[at], weights[g])
        p = sigmoid((x * weights[run]).sum(1))
        return cls(run, x, (hits + 20 * p) / (total + 20), weights)

    def log10(self, cells: np.ndarray, hits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of the probability of the decisions of each text (sizes: how many it has). A text's mixer starts from
        the common weights and takes a step after every BLOCK decisions."""
        out, starts = np.zeros(len(sizes)), np.cumsum(sizes) - sizes
        weights = np.repeat(self.weights[None], len(sizes), 0)
        for at in range(0, int(sizes.max(initial=0)), BLOCK):
            live = np.flatnonzero(sizes > at)
            inner = at + np.arange(BLOCK)
            valid = inner < sizes[live][:, None]
            where = np.where(valid, starts[live][:, None] + inner, 0)
            c, y = cells[where], hits[where]
            x, g = self.logits[c], self.gate[c]
            p = sigmoid((x * weights[live[:, None], g]).sum(-1))
            final = np.clip(0.5 * (p + self.refine[c]), 1e-6, 1 - 1e-6)
            out[live] += (np.log10(np.where(y, final, 1 - final)) * valid).sum(1)
            step = RATE * (y - p) * valid
            np.add.at(weights, (live[:, None], g), step[..., None] * x)
        return out


def literals(table: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of the tree's probability of each token, under the class that the tokens before it in its text point to."""
    classes = len(table) - 1
    inner = np.arange(len(codes)) - np.repeat(starts, sizes)
    best, chosen = np.full(len(codes), -np.inf), np.full(len(codes), classes)
    for k in range(classes):
        sums = np.cumsum(table[k][codes].astype(float))
        before = np.append(0.0, sums[:-1])
        so_far = before - np.repeat(before[starts], sizes)
        better = (inner >= 3) & (so_far > best)
        best[better], chosen[better] = so_far[better], k
    return table[chosen, codes].astype(float)


def repeats(at: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each token is the one that followed the latest earlier occurrence of its context in its text: 0 there is
    none, 1 no, 2 yes."""
    text = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)
    key = _mixed(at ^ (text * U(0xD6E8FEB86659FD93)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(tokens), np.int64)
    out[order[1:][same]] = 1 + (tokens[order[1:][same]] == tokens[order[:-1][same]])
    return out


def _assembled(shared, parts: int):
    """Rows of texts from the batches' own rows and the answers to their requests, which come sorted by batch and part;
    shared: the table of the tree, broadcast."""
    fields = ["row", "id", "learn", "tokens", "known", "bytes", "base", "literal", "first", "second"]

    def texts(own: dict, docs: pa.StructArray, answers: list[bytes]) -> pa.RecordBatch:
        table = shared.value
        sizes, learn = restored(own["sizes"], own["n"], np.int32).astype(np.int64), restored(own["learn"], own["n"], np.uint8) > 0
        starts, n = np.cumsum(sizes) - sizes, int(sizes.sum())
        tokens = restored(own["blob"], n, np.uint32)
        asked = Requests.of(tokens, starts, sizes, learn, parts)
        found = np.concatenate([restored(a, k, np.uint8) for a, k in answers]) if answers else np.zeros(0, np.uint8)
        answer = found[asked.back].astype(np.int64)
        rare = tokens >= RARE
        codes = np.where(rare, len(table[0]) - 1, tokens).astype(np.int64)
        plain = literals(table, codes, starts, sizes)
        plain[rare] += restored(own["spelled"], int(rare.sum()), np.float32)
        state = np.where(answer > 0, 1 + (answer > 32), 0)
        local = np.where(state == 2, 0, repeats(contexts(tokens, starts), tokens, sizes))
        first = past(state, starts, sizes) + (answer - 1) % 32 * HISTORY * RUNS
        second = past(local, starts, sizes) + (state == 1) * HISTORY * RUNS
        text = np.repeat(np.arange(len(sizes)), sizes)
        literal = np.bincount(text, plain * ((state != 2) & (local != 2)), len(sizes))

        def packed(cells: np.ndarray, states: np.ndarray) -> pa.Array:
            at = np.flatnonzero(states)
            values = (cells[at] * 2 + (states[at] == 2)).astype(np.uint16)
            ends = np.cumsum(np.bincount(text[at], minlength=len(sizes))) * 2
            return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(values.tobytes())])

        numbers = pa.array((own["batch"] << 20) + np.arange(len(sizes)))
        columns = {f: docs.field(f) for f in ("id", "learn", "tokens", "known", "bytes", "base")}
        columns |= {"row": numbers, "literal": pa.array(literal), "first": packed(first, state), "second": packed(second, local)}
        return pa.RecordBatch.from_arrays([columns[f] for f in fields], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, docs, answers = None, None, []
        for batch in batches:
            plain = batch.select(["batch", "part", "blob", "n", "sizes", "spelled", "learn"]).to_pylist()
            for i, row in enumerate(plain):
                if row["part"] >= 0:
                    answers.append((row["blob"], row["n"]))
                    continue
                if own:
                    yield texts(own, docs, answers)
                own, answers = row, []
                piece = batch.column("docs").slice(i, 1)
                docs = pa.concat_arrays([piece.flatten()])
        if own:
            yield texts(own, docs, answers)

    return run


def score_texts(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", top_words: int = TOP_WORDS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row for each row of df: (id, held_out, n_tokens, n_known, train_tokens, base_score, score, token_bits_per_byte).

    training marks the rows to learn from (null: not). Scores are log10 probabilities of the tokens: base_score under
    add-one word counts, score under the mixing model; token_bits_per_byte is the latter in bits, over the bytes of the text,
    one at least (white space counts there, but isn't coded). A null or empty text has its end alone. Ties between candidates go to the smaller token; repeated
    rows are each scored and each learnt from, and predict each other; very long texts are batches of their own; an empty
    table gives an empty result, and without training rows all words are spelled with even chances; further columns are
    ignored, whatever their names. df is read twice.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    spark = df.sparkSession
    sc = spark.sparkContext
    counted = rows.where("learn").select("text").mapInArrow(count_words, "word string, n long")
    words = stored(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"))
    model, n, v = fit_words(words, top_words)
    spelling = fit_model(words.where("word <> ''").select(F.col("word").alias("text")))
    shared = sc.broadcast((model, spelling))
    below, parts, leaves = float(np.log10(n + v + 1)), 8 + n // part_tokens, len(model.places) + 1
    kind = df.schema[id_col].dataType.simpleString()
    docs = f"array<struct<id:{kind},learn:boolean,tokens:bigint,known:bigint,bytes:bigint,base:double>>"

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, spelling = shared.value
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 22
        for batch in portions(batches, "text", TEXT_BYTES):
            plain = text_bytes(batch.column("text"))
            split = [(t or b"").lower().split() for t in plain]
            for s in split:
                s.append(b"")
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            flat, lengths = list(chain.from_iterable(split)), [len(t or b"") for t in plain]
            del split, plain
            tokens, starts = np.fromiter(map(common.places.get, flat, repeat(-1)), np.int64, len(flat)), np.cumsum(sizes) - sizes
            text, where = np.repeat(np.arange(len(sizes)), sizes), np.flatnonzero(tokens < 0)
            known, logs = np.add.reduceat(tokens >= 0, starts, dtype=np.int64), np.where(tokens < 0, 0.0, common.logs[tokens])
            base, feature = np.add.reduceat(logs, starts) - below * sizes, np.where(tokens < 0, -1, common.kinds[tokens])
            # every word outside the tree once, and which of them each occurrence is
            odd = [flat[i] for i in where.tolist()]
            del flat
            names = {w: i for i, w in enumerate(dict.fromkeys(odd))}
            which = np.fromiter(map(names.__getitem__, odd), np.int64, len(odd))
            crc = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
            tokens[where] = crc[which] | int(RARE)
            short = np.fromiter(map(len, names), np.int64, len(names)) <= SHORT
            feature[where] = np.where(short, crc % FEATURES, -1)[which]
            keys, heads = windows(list(names))
            costs = np.add.reduceat(memoised(spelling, keys), heads) if len(heads) else np.zeros(0)
            met, times = np.unique(text[where] * max(1, len(names)) + which, return_counts=True)
            at, which_met = np.divmod(met, max(1, len(names)))
            has = feature >= 0
            traits = np.unique(text[has] * FEATURES + feature[has])
            learn = np.array(batch.column("learn").to_pylist(), np.uint8)
            arrays = [batch.column("id"), batch.column("learn"), pa.array(sizes), pa.array(known), pa.array(lengths, pa.int64()), pa.array(base)]
            struct = pa.StructArray.from_arrays(arrays, ["id", "learn", "tokens", "known", "bytes", "base"])
            seen = pa.array(list(names), pa.binary()).cast(pa.string()).take(pa.array(which_met))
            rare = pa.StructArray.from_arrays([pa.array(at, pa.int32()), seen, pa.array(times, pa.int32())], ["at", "word", "times"])
            blobs = {"blob": tokens.astype(np.uint32), "sizes": sizes.astype(np.int32), "spelled": costs[which].astype(np.float32), "learn": learn}
            blobs |= {"kinds": (traits % FEATURES).astype(np.uint16), "kind_sizes": np.bincount(traits // FEATURES, minlength=len(sizes)).astype(np.uint16)}
            columns = [pa.array([number], pa.int64()), pa.array([len(sizes)], pa.int32()), *[pa.array([squeezed(x)], pa.binary()) for x in blobs.values()]]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (struct, rare)]
            yield pa.RecordBatch.from_arrays(columns, ["batch", "n", *blobs, "docs", "rare"])
            number += 1

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            sizes = restored(row["sizes"], row["n"], np.int32).astype(np.int64)
            tokens = restored(row["blob"], int(sizes.sum()), np.uint32)
            asked = Requests.of(tokens, np.cumsum(sizes) - sizes, sizes, restored(row["learn"], row["n"], np.uint8) > 0, parts)
            used, first = np.unique(asked.part, return_index=True)
            ends = np.append(first[1:], len(asked.part))
            cut = lambda x, t: [squeezed(x[a:b].astype(t)) for a, b in zip(first, ends, strict=True)]
            columns = [pa.array([row["batch"]] * len(used), pa.int64()), pa.array(used, pa.int32()), pa.array(ends - first, pa.int32())]
            columns += [pa.array(cut(x, t), pa.binary()) for x, t in ((asked.rest, np.uint32), (asked.token, np.uint32), (asked.count, np.uint32), (asked.learn, np.uint8))]
            yield pa.RecordBatch.from_arrays(columns, ["batch", "part", "n", "rest", "token", "count", "learn"])

    binaries = ", ".join(f"{c} binary" for c in ("blob", "sizes", "spelled", "learn", "kinds", "kind_sizes"))
    batches = stored(rows.mapInArrow(tokenised, f"batch long, n int, {binaries}, docs {docs}, rare array<struct<at:int,word:string,times:int>>"))
    by_class = class_counts(batches, find_classes(batches), leaves)
    tree = sc.broadcast(tree_table(np.maximum(by_class.sum(0), 0.5), by_class.astype(float)))
    asked = batches.select("batch", "n", "blob", "sizes", "learn").mapInArrow(requests, "batch long, part int, n int, rest binary, token binary, count binary, learn binary")
    answers = scratch_path(spark)
    found = asked.repartition(parts, "part").sortWithinPartitions("part", "batch").mapInArrow(_answers, "batch long, part int, blob binary, n int")
    found = stored(found, path=answers)
    mine = batches.select("batch", F.lit(-1).alias("part"), "blob", "n", "sizes", "spelled", "learn", "docs")
    met = mine.unionByName(found, allowMissingColumns=True).repartition(parts, "batch").sortWithinPartitions("batch", "part")
    shape = f"row long, id {kind}, learn boolean, tokens long, known long, bytes long, base double, literal double, first binary, second binary"
    texts = stored(met.mapInArrow(_assembled(tree, parts), shape))
    discard(spark, answers)

    mixers = sc.broadcast([Decisions.fit(*counts) for counts in _outcomes(texts.where("learn"))])

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = batch.column("literal").to_numpy(zero_copy_only=False).copy()
            for name, mixer in zip(("first", "second"), mixers.value, strict=True):
                cells, hits, sizes = _decisions(batch.column(name))
                score += mixer.log10(cells, hits, sizes)
            kept = ["row", "id", "learn", "tokens", "known", "bytes", "base"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(score)], [*kept, "score"])

    scored = texts.mapInArrow(mixed, f"row long, id {kind}, learn boolean, tokens long, known long, bytes long, base double, score double")
    one = batches.select("batch", F.explode("rare").alias("r")).select((F.shiftleft("batch", 20) + F.col("r.at")).alias("row"), "r.word", "r.times")
    # words of no training text have count zero and add nothing to the sums
    more = one.join(words, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("add"))
    return scored.join(more, "row", "left").select(
        F.col("id").alias(id_col),
        (~F.col("learn")).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("add", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.greatest("bytes", F.lit(1))).alias("token_bits_per_byte"),
    )


def _decisions(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, hits, number of decisions of each row)"""
    values = [b or b"" for b in column.to_pylist()]
    flat = np.frombuffer(b"".join(values), np.uint16)
    return (flat >> 1).astype(np.int64), (flat & 1).astype(bool), np.array([len(b) // 2 for b in values], np.int64)


def _outcomes(texts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hits, total) of the cells of each kind of decision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(2 * n, np.int64) for n in CELLS]
        for batch in batches:
            for i, name in enumerate(("first", "second")):
                cells, hits, _ = _decisions(batch.column(name))
                seen[i] += np.bincount(cells * 2 + hits, minlength=len(seen[i]))
        for i, table in enumerate(seen):
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(at, pa.int32()), pa.array(table[at])], ["kind", "at", "n"])

    tables = [np.zeros(2 * n) for n in CELLS]
    for r in texts.select("first", "second").mapInArrow(run, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n")).collect():
        tables[r[0]][r[1]] = r[2]
    return [(t[1::2], t.reshape(-1, 2).sum(1)) for t in tables]
