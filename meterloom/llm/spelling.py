"""The spelling of a word by logistic context mixing over its bytes.

A word is its bytes and an end byte. Every byte is coded as eight binary decisions. Predictors of orders 1 to 5 hash the
last bytes of the word and the bits so far to slots that hold how often a 0 and a 1 followed in the training words; each
gives the logit of its share. A mixer adds the logits with weights that a gate selects (the position of the bit and the
longest order that has seen the context), and an adaptive map refines the result by the bits so far.

Learning is one pass each over the distinct six-byte windows of the training words: counts fill the slots; then mixers
descend online over the windows, each predicted without its own occurrence, in every partition, and are averaged; then
the map gathers how often its buckets were right. A byte's probability depends on its window alone, so workers keep the
probabilities of windows they have met. The slots follow the number of windows up to 2 ** MOST_BITS an order: windows lie
within words, so their number is that of spellings, not of texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import portions, process_cache, stored, text_bytes

ORDERS, END = 5, 0xFF
#: Bits of the slots of each order; those of the last two follow the number of windows, up to this.
SLOT_BITS, MOST_BITS = (16, 19, 20), 21
RANGE = 1 << 16
ADD, LIMIT, BUCKETS, RATE, STEP_ROWS = 0.3, 60_000, 33, 0.08, 2048
#: Windows that one descent of the weights goes over; descents are averaged.
DESCENT_ROWS = 250_000
MEMO_BITS = 20
U = np.uint64


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The six-byte windows that end at each byte of each text and at its end, and where those of each text begin."""
    pad, end = b"\xff" * ORDERS, b"\xff"
    joined = np.frombuffer(b"".join([pad + t + end for t in texts]), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    whole = np.zeros(len(joined), np.uint64)
    for back in range(ORDERS, -1, -1):
        whole[ORDERS:] |= joined[ORDERS - back : len(joined) - back].astype(np.uint64) << U(8 * back)
    starts = np.cumsum(sizes + ORDERS) - sizes
    keep = np.ones(len(joined), bool)
    for k in range(1, ORDERS + 1):
        keep[starts - k] = False
    return whole[keep], np.cumsum(sizes) - sizes


@dataclass
class MixingModel:
    bits: tuple[int, ...]
    zeros: np.ndarray
    ones: np.ndarray
    weights: np.ndarray
    refine: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        self.offsets = np.concatenate([[0], np.cumsum([1 << b for b in self.bits])])

    def slots(self, context: np.ndarray, node: np.ndarray, order: int) -> np.ndarray:
        """Slot of each context (its last bytes as a number) and of the bits so far (node: 1, then 2 or 3, ...)."""
        masked = context & U((1 << 8 * order) - 1)
        if order == 1:
            return (masked << U(8) | node).astype(np.int64)
        mixed = (masked * U(0x9E3779B97F4A7C15) + node * U(0xC2B2AE3D27D4EB4F)) ^ (masked >> U(7))
        mixed = (mixed ^ (mixed >> U(29))) * U(0xBF58476D1CE4E5B9)
        return (mixed >> U(64 - self.bits[order - 1])).astype(np.int64) + int(self.offsets[order - 1])

    def decisions(self, keys: np.ndarray, without: int = 0) -> Iterator[tuple]:
        """For each of the eight bits: (bit number, bit, node, logits with a constant, gate); without: own occurrences
        to leave out of the counts."""
        byte, context = keys & U(255), keys >> U(8)
        node = np.ones(len(keys), np.uint64)
        for i in range(8):
            bit = (byte >> U(7 - i)) & U(1)
            logits, gate = np.empty((len(keys), ORDERS + 1), np.float32), np.zeros(len(keys), np.int64)
            logits[:, ORDERS] = 0.3
            for order in range(1, ORDERS + 1):
                slot = self.slots(context, node, order)
                zeros, ones = self.zeros[slot].astype(np.float32), self.ones[slot].astype(np.float32)
                if without:
                    ones, zeros = np.maximum(ones - bit, 0, dtype=np.float32), np.maximum(zeros - (1 - bit.astype(np.float32)), 0, dtype=np.float32)
                gate[zeros + ones > 0] = order
                logits[:, order - 1] = np.log((ones + ADD) / (zeros + ADD))
            yield i, bit.astype(np.float32), node.astype(np.int64), logits, gate
            node = node << U(1) | bit

    def refined(self, node: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Probability of a 1: the mixer's and the map's, averaged."""
        place = np.clip(mixed, -8, 8) * 2 + BUCKETS // 2
        low = np.minimum(place.astype(np.int64), BUCKETS - 2)
        part = place - low
        mapped = self.refine[node, low] * (1 - part) + self.refine[node, low + 1] * part
        return 0.5 / (1 + np.exp(-np.clip(mixed, -12, 12))) + 0.5 * mapped

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last byte after the others."""
        out = np.empty(len(keys))
        for at in range(0, len(keys), 1 << 16):
            part = keys[at : at + (1 << 16)]
            total = np.zeros(len(part))
            for i, bit, node, logits, gate in self.decisions(part):
                p = self.refined(node, (logits * self.weights[i, gate]).sum(1))
                total += np.log10(np.where(bit > 0, p, 1 - p))
            out[at : at + (1 << 16)] = total
        return out


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in portions(batches, "text", 2 << 20):
        found, n = np.unique(windows([(t or b"").lower() for t in text_bytes(batch.column("text"))])[0], return_counts=True)
        keys, place = np.unique(np.concatenate([keys, found]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        if len(keys) > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])
            keys, counts = keys[:0], counts[:0]
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])


def _tables(grams: DataFrame, bits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of zeros and ones of every slot: partitions add up their own, and one task for each range of slots adds
    those of the partitions."""
    empty = MixingModel(bits, np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0))
    total = int(empty.offsets[-1])
    sc = grams.sparkSession.sparkContext
    shared = sc.broadcast(empty)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = shared.value, None
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
            if not len(keys):
                continue
            counts = np.zeros((2, total), np.float32) if counts is None else counts
            node, byte, context = np.ones(len(keys), np.uint64), keys & U(255), keys >> U(8)
            for i in range(8):
                bit = (byte >> U(7 - i)) & U(1)
                for order in range(1, ORDERS + 1):
                    slot = model.slots(context, node, order)
                    for b in (0, 1):
                        chosen, where = np.unique(slot[bit == b], return_inverse=True)
                        counts[b, chosen] += np.bincount(where, n[bit == b], len(chosen)).astype(np.float32)
                node = node << U(1) | bit
        if counts is not None:
            for r in range(0, total, RANGE):
                part = counts[:, r : r + RANGE]
                used = np.flatnonzero(part.any(0))
                if len(used):
                    arrays = [pa.array([x], pa.binary()) for x in (used.astype(np.uint16).tobytes(), part[:, used].tobytes())]
                    yield pa.RecordBatch.from_arrays([pa.array([r // RANGE], pa.int32()), *arrays], ["range", "at", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["at"], np.uint16).astype(np.int64)
                sums.setdefault(row["range"], np.zeros((2, RANGE), np.float32))[:, at] += np.frombuffer(row["counts"], np.float32).reshape(2, -1)
        for r, table in sums.items():
            scale = np.maximum(table.max(0) / LIMIT, 1)
            packed = np.ceil(table / scale).astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([packed], pa.binary())], ["range", "table"])

    parts = grams.mapInArrow(partial, "range int, at binary, counts binary")
    rows = parts.repartition("range").mapInArrow(added, "range int, table binary").collect()
    tables = np.zeros((2, -(-total // RANGE) * RANGE), np.uint16)
    for r in rows:
        tables[:, r[0] * RANGE : (r[0] + 1) * RANGE] = np.frombuffer(bytes(r[1]), np.uint16).reshape(2, -1)
    return tables[0, :total], tables[1, :total]


def _sums(grams: DataFrame, model: MixingModel, gather) -> np.ndarray:
    """Adds up what gather(model, batches of (keys, counts)) returns in every partition: an array of pairs."""
    shared = grams.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((b.column("key").to_numpy(zero_copy_only=False).view(np.uint64), b.column("n").to_numpy(zero_copy_only=False).astype(np.float32)) for b in batches if b.num_rows)
        out = gather(shared.value, pairs)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out[:, 0].astype(np.float64)), pa.array(out[:, 1].astype(np.float64))], ["i", "a", "b"])

    rows = grams.mapInArrow(run, "i int, a double, b double").groupBy("i").agg(F.sum("a"), F.sum("b")).collect()
    out = np.zeros((len(rows), 2))
    for r in rows:
        out[r[0]] = r[1], r[2]
    return out


def _descend(model: MixingModel, batches: Iterator[tuple]) -> np.ndarray | None:
    """Online gradient descent of the mixing weights; returns weights times mass, and mass."""
    weights, speed, mass = model.weights.copy(), np.full(model.weights.shape, 1e-3, np.float32), 0.0
    for keys, n in batches:
        order = np.argsort(keys * U(0x9E3779B97F4A7C15), kind="stable")
        mass += float(n.sum())
        for at in range(0, len(keys), STEP_ROWS):
            rows = order[at : at + STEP_ROWS]
            share = n[rows] / n[rows].mean()
            for i, bit, _, logits, gate in model.decisions(keys[rows], without=1):
                p = 1 / (1 + np.exp(-np.clip((logits * weights[i, gate]).sum(1), -12, 12)))
                error = (bit - p) * share
                for g in np.unique(gate):
                    chosen = gate == g
                    slope = (logits[chosen] * error[chosen, None]).sum(0) / len(rows)
                    speed[i, g] += slope * slope
                    weights[i, g] += RATE * slope / np.sqrt(speed[i, g])
    return np.stack([weights.reshape(-1) * mass, np.full(weights.size, mass)], 1) if mass else None


def _observe(model: MixingModel, batches: Iterator[tuple]) -> np.ndarray | None:
    """How often a 1 came in each bucket of the map, and how often the bucket was met."""
    seen = np.zeros((256 * BUCKETS, 2))
    for keys, n in batches:
        for at in range(0, len(keys), 1 << 15):
            part = n[at : at + (1 << 15)]
            for i, bit, node, logits, gate in model.decisions(keys[at : at + (1 << 15)], without=1):
                place = np.clip((logits * model.weights[i, gate]).sum(1), -8, 8) * 2 + BUCKETS // 2
                low = np.minimum(place.astype(np.int64), BUCKETS - 2)
                for k, w in ((low, part * (1 - (place - low))), (low + 1, part * (place - low))):
                    at_bucket = node * BUCKETS + k
                    seen[:, 0] += np.bincount(at_bucket, w * bit, len(seen))
                    seen[:, 1] += np.bincount(at_bucket, w, len(seen))
    return seen if seen.any() else None


def fit_model(texts: DataFrame) -> MixingModel:
    """Learn from the text column of texts (null: empty)."""
    grams = stored(texts.mapInArrow(_count_windows, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    n = max(1, grams.count())
    last = min(MOST_BITS, max(16, (2 * n).bit_length()))
    bits = (*SLOT_BITS, last, last)
    weights = np.full((8, ORDERS + 1, ORDERS + 1), 0.3, np.float32)
    centre = 1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2) / 2))
    refine = np.tile(centre, (256, 1))
    zeros, ones = _tables(grams, bits)
    model = MixingModel(bits, zeros, ones, weights, refine)
    # descent goes by partition, so rows are dealt and ordered by their keys alone, whatever the layout of texts
    dealt = grams.repartition(-(-n // DESCENT_ROWS), "key").sortWithinPartitions(F.xxhash64("key"), "key")
    if len(found := _sums(dealt, model, _descend)):
        model = MixingModel(bits, zeros, ones, (found[:, 0] / found[:, 1]).reshape(weights.shape).astype(np.float32), refine)
    if len(seen := _sums(grams, model, _observe)):
        refine = ((seen[:, 0] + 20 * refine.reshape(-1)) / (seen[:, 1] + 20)).reshape(256, BUCKETS)
    return MixingModel(bits, zeros, ones, model.weights, np.clip(refine, 1e-5, 1 - 1e-5))


def memoised(model: MixingModel, keys: np.ndarray) -> np.ndarray:
    """model.log10(keys), with the probabilities of windows that this worker has met looked up."""
    kept = process_cache("window probabilities")
    if kept.get("model") != model.name:
        kept |= {"model": model.name, "keys": np.zeros(1 << MEMO_BITS, np.uint64), "values": np.zeros(1 << MEMO_BITS)}
    place = ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - MEMO_BITS)).astype(np.int64)
    out, missing = kept["values"][place], np.flatnonzero(kept["keys"][place] != keys)
    if len(missing):
        new, where = np.unique(keys[missing], return_inverse=True)
        values = model.log10(new)
        out[missing] = values[where]
        at = ((new * U(0x9E3779B97F4A7C15)) >> U(64 - MEMO_BITS)).astype(np.int64)
        # two new windows of one place: the later one stays, with its value
        kept["keys"][at] = new
        kept["values"][at] = values
    return out
