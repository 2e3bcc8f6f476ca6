"""Hard negatives by exact tile products.

Anchors and candidates are quantised to integers and dealt into tiles and blocks; every tile of anchors meets every block
of candidates. Their products are computed by Strassen's recursion on zero-padded int64 tiles: seven products of half
size instead of eight, sums and differences exact (wrapping around is harmless, as no score that fits is lost in
arithmetic modulo 2**64; tiles whose scores might not fit are Python integers). Two rounds keep small heaps for each
tile and block, which merge by sorting: first the best rows of an anchor's own label (its positives), then, for each
positive, the best rows of other labels in the window of scores below it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.llm.bitsliced import LOW_BITS, integers, quantised
from meterloom.llm.common import stored

#: Candidates of a block and anchors of a tile; recursion stops at products with a side of at most LEAF.
BLOCK_ROWS, TILE_ROWS, LEAF = 8192, 1024, 32
FITS = float(1 << 62)


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for integer matrices whose sides are even down to LEAF (see padded)."""
    if min(*a.shape, b.shape[1]) <= LEAF or any(side % 2 for side in (*a.shape, b.shape[1])):
        return a @ b
    (m, k), n = (a.shape[0] // 2, a.shape[1] // 2), b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11), strassen(a11, b12 - b22)
    p4, p5 = strassen(a22, b21 - b11), strassen(a11 + a12, b22)
    p6, p7 = strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * m, 2 * n), p1.dtype)
    out[:m, :n], out[:m, n:] = p1 + p4 - p5 + p7, p3 + p5
    out[m:, :n], out[m:, n:] = p2 + p4, p1 - p2 + p3 + p6
    return out


def padded(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    out = np.zeros((rows, cols), x.dtype)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer matrix a @ b.T of two matrices of whole doubles: int64 where scores fit, else Python integers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = [float(np.abs(m).max(initial=0)) for m in (a, b)]
    big = most[0] * most[1] * a.shape[1] >= FITS or max(most) >= FITS
    x, y = (integers(m).astype(object) if big else m.astype(np.int64) for m in (a, b))
    sides, depth = (len(a), a.shape[1], len(b)), 0
    while min(sides) >> depth > LEAF:
        depth += 1
    m, k, n = (-(-s >> depth) << depth for s in sides)
    return strassen(padded(x, m, k), padded(y.T, k, n))[: len(a), : len(b)]


def _grouped(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[tuple[int, int], list[dict]]]:
    """((part, dims), rows) for runs of at most limit rows."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["part"], len(row["q"]))
            if rows and (now != key or len(rows) == limit):
                yield key, rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield key, rows


def _matrices(limit: int, row_fields: tuple[str, ...]):
    """Rows of one part and dimension as one row: a matrix and, as bytes, the named longs of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, dims), rows in _grouped(batches, limit):
            matrix = np.array([r["q"] for r in rows], np.float64).tobytes()
            longs = {f: [np.array([r[f] for r in rows], np.int64).tobytes()] for f in row_fields}  # as many in each row
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "dims": [dims], "n": [len(rows)], "matrix": [matrix], **longs},
                pa.schema([("part", pa.int32()), ("dims", pa.int32()), ("n", pa.int32()), ("matrix", pa.binary()), *((f, pa.binary()) for f in row_fields)]),
            )

    return run


def _long(row: dict, field: str) -> np.ndarray:
    return np.frombuffer(row[field], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller id."""
    if len(scores) > 4 * k and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def _split(values: list[int]) -> tuple[list[int], list[int]]:
    """Scores as high * 2**LOW_BITS + low."""
    most = (1 << 63) - 1
    return [max(-most, min(most, v >> LOW_BITS)) for v in values], [v & ((1 << LOW_BITS) - 1) for v in values]


def _meet(pick: Callable[[dict, dict, np.ndarray], Iterator[tuple]]):
    """Products of every tile with the blocks of its part, from rows sorted by part, dims and kind (blocks first); pick
    gives (anchor, positive, id, score, positive's score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["part"], row["dims"]) != key:
                    key, blocks = (row["part"], row["dims"]), []
                row["m"] = np.frombuffer(row.pop("matrix"), np.float64).reshape(row["n"], row["dims"])
                if row["kind"] == 0:
                    blocks.append(row)
                    continue
                for block in blocks:
                    found = list(pick(row, block, product(row["m"], block["m"])))
                    if found:
                        anchors, positives, ids, scores, bounds = zip(*found, strict=True)
                        columns = (anchors, positives, ids, *_split(scores), *_split(bounds))
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["anchor", "positive", "id", "high", "low", "phigh", "plow"])

    return run


FOUND = "anchor long, positive long, id long, high long, low long, phigh long, plow long"


def _positives(k: int):
    def pick(tile: dict, block: dict, scores: np.ndarray) -> Iterator[tuple]:
        ids, labels = _long(block, "id"), _long(block, "label")
        for i, (anchor, label) in enumerate(zip(_long(tile, "anchor").tolist(), _long(tile, "label").tolist(), strict=True)):
            own = np.flatnonzero((labels == label) & (ids != anchor))
            for j in own[_best(scores[i, own], ids[own], k)].tolist():
                yield anchor, 0, int(ids[j]), int(scores[i, j]), 0

    return pick


def _negatives(k: int, low: int, high: int):
    def pick(tile: dict, block: dict, scores: np.ndarray) -> Iterator[tuple]:
        ids, labels = _long(block, "id"), _long(block, "label")
        anchors, own = _long(tile, "anchor"), _long(tile, "label")
        slots = zip(*(_long(tile, f).reshape(len(anchors), -1).tolist() for f in ("there", "positive", "phigh", "plow")), strict=True)
        for row, anchor, label, (there, positives, highs, lows) in zip(scores, anchors.tolist(), own.tolist(), slots, strict=True):
            allowed = np.flatnonzero((labels != label) & (ids != anchor))
            for _, positive, h, w in (x for x in zip(there, positives, highs, lows, strict=True) if x[0]):
                bound = (h << LOW_BITS) + w
                # low * bound <= 100 * score <= high * bound
                within = (row[allowed] >= -(-low * bound // 100)) & (row[allowed] <= high * bound // 100)
                other = allowed[within.astype(bool)]
                for j in other[_best(row[other], ids[other], k)].tolist():
                    yield anchor, positive, int(ids[j]), int(row[j]), bound

    return pick


def _crossed(tiles: DataFrame, blocks: DataFrame, n_blocks: int, pick) -> DataFrame:
    """Every tile meets the blocks of every part; blocks move once, copies of the tiles come to them."""
    meets = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("kind", F.lit(1))
    met = blocks.withColumn("kind", F.lit(0)).unionByName(meets, allowMissingColumns=True)
    return met.repartition(n_blocks, "part").sortWithinPartitions("part", "dims", "kind").mapInArrow(_meet(pick), FOUND)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("high"), F.desc("low"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _tiles(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    parts = max(1, -(-rows.count() // TILE_ROWS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int")).repartition("part").sortWithinPartitions("part", F.size("q"))
    return stored(dealt.mapInArrow(_matrices(TILE_ROWS, fields), "part int, dims int, n int, matrix binary, " + ", ".join(f"{f} binary" for f in fields)).drop("part"))


def _score(high: str, low: str) -> Column:
    limit = F.lit((1 << 63) - 1)
    return F.when(F.col(high) > 1, limit).when(F.col(high) < -2, -limit - 1).otherwise(F.shiftleft(high, LOW_BITS) + F.col(low))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    `positives` other rows of the same label, the first `negatives` rows of other labels whose score lies within the
    window, in per cent of the positive's score. A score is the integer inner product of floor(scale * x) with the
    anchor's; higher ones come first, ties by smaller id.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part; only vectors of the same
    length meet. Of rows that repeat an anchor's id one asks (the least vector, then label) and none answers it; other
    repeated rows each count, and a positive that stands several times is asked for once (at its best score). A
    positive without negatives has no rows, nor has an anchor without positives. Scores beyond a long are ranked by
    their true value (beyond 2**124 as equal) and given as the largest or smallest long. An empty table gives an empty
    result; further columns are ignored.
    """
    plain = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = stored(quantised(plain.where("label IS NOT NULL"), scale, "id", "v", F.col("label"), F.col("asks")))
    n_blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", "q"), F.lit(n_blocks)).cast("int")).repartition("part").sortWithinPartitions("part", F.size("q"), "id")
    blocks = stored(dealt.mapInArrow(_matrices(BLOCK_ROWS, ("id", "label")), "part int, dims int, n int, matrix binary, id binary, label binary"))
    asked = rows.where("asks").groupBy(F.col("id").alias("anchor")).agg(F.min(F.struct("q", "label")).alias("a")).select("anchor", "a.q", "a.label")
    best = _first(_crossed(_tiles(asked, ("anchor", "label")), blocks, n_blocks, _positives(positives)), ["anchor"], positives)
    best = best.groupBy("anchor", "id").agg(F.max(F.struct("high", "low")).alias("s"))
    # every anchor has as many slots as it may have positives
    slot = F.struct(F.lit(1).alias("there"), F.col("id").alias("positive"), F.col("s.high").alias("phigh"), F.col("s.low").alias("plow"))
    none = F.struct(*[F.lit(0).cast("long").alias(f) for f in ("there", "positive", "phigh", "plow")])
    slots = best.groupBy("anchor").agg(F.collect_list(slot).alias("slots"))
    slots = slots.withColumn("slots", F.concat("slots", F.array_repeat(none, positives - F.size("slots"))))
    fields = ("there", "positive", "phigh", "plow")
    chosen = slots.select("anchor", *[F.col(f"slots.{f}").alias(f) for f in fields]).join(asked, "anchor")
    found = _crossed(_tiles(chosen, ("anchor", "label", *fields)), blocks, n_blocks, _negatives(negatives, *window))
    return _first(found, ["anchor", "positive"], negatives).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        _score("phigh", "plow").alias("positive_score"), _score("high", "low").alias("negative_score"),
    )
