"""Exact top-k inner products from a bit-sliced index.

Vectors are quantised to integers and dealt into blocks. A block keeps, for every attribute, the bits of its values one
slice at a time, each slice a bitmap over the rows of the block. A query adds the slices, shifted by the bits of its own
components, with bitmap full adders (three bitmaps become a sum and a carry), until the scores of all rows stand as
slices themselves. The top rows come from the most significant slice downward; rows that tie at the boundary are
resolved by their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.llm.common import stored

BLOCK_ROWS, TILE_ROWS = 4096, 256
#: Whole numbers of larger size are held as Python's, which have no limit.
MACHINE_SIZE = float(1 << 61)
#: Scores travel as high * 2**LOW_BITS + low.
LOW_BITS = 62


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    """(id, q array<double>, and more columns) of the vectors that take part: not null, every component present and finite. The components
    of q are whole numbers, which doubles hold exactly whatever their size."""
    v = F.col(vector_col)
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    whole = F.transform(v, lambda x: F.when(F.abs(scaled(x)) < float(1 << 53), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    finite = lambda x: ~F.isnan(x.cast("double")) & (F.abs(scaled(x)) < float("inf"))
    ok = v.isNotNull() & F.forall(v, lambda x: F.when(x.isNull(), False).otherwise(finite(x)))
    return vectors.where(F.col(id_col).isNotNull()).where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("q"), *more)


def integers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as int64, or as Python's integers where one is too large for that."""
    if not values.size or np.abs(values).max() < MACHINE_SIZE:
        return values.astype(np.int64)
    out = np.empty(values.shape, object)
    out.reshape(-1)[:] = [int(x) for x in values.reshape(-1).tolist()]
    return out


def grouped_rows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """((part, dims), ids, matrix) for runs of rows of one part and dimension, of at most limit rows."""
    key, ids, rows = None, [], []
    for batch in batches:
        for part, i, q in zip(batch.column("part").to_pylist(), batch.column("id").to_pylist(), batch.column("q").to_pylist(), strict=True):
            if ids and ((part, len(q)) != key or len(ids) == limit):
                yield key, np.array(ids, np.int64), np.array(rows, np.float64).reshape(len(ids), key[1])
                ids, rows = [], []
            key = (part, len(q))
            ids.append(i)
            rows.append(q)
    if ids:
        yield key, np.array(ids, np.int64), np.array(rows, np.float64).reshape(len(ids), key[1])


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as rows of 64-bit words, the first row of the block in the lowest bit."""
    pad = -bits.shape[-1] % 64
    wide = np.concatenate([bits, np.zeros((*bits.shape[:-1], pad), np.uint8)], -1) if pad else bits
    return np.ascontiguousarray(np.packbits(wide, axis=-1, bitorder="little")).view(np.uint64)


def unpacked(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n]


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index blocks: (part, dims, rows, slices a component, ids, least value of each component, slices)."""
    for (part, dims), ids, matrix in grouped_rows(batches, BLOCK_ROWS):
        least, whole = matrix.min(0) if dims else np.zeros(0), integers(matrix)
        above = whole - integers(least)
        width = max(1, int(above.max()).bit_length()) if dims else 1
        slices = [packed(((above.T >> j) & 1).astype(np.uint8)) for j in range(width)]
        body = np.stack(slices, 1).tobytes() if dims else b""
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "dims": [dims], "n": [len(ids)], "width": [width], "ids": [ids.tobytes()], "least": [least.tobytes()], "slices": [body]},
            pa.schema([("part", pa.int32()), ("dims", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("least", pa.binary()), ("slices", pa.binary())]),
        )


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (_, dims), ids, matrix in grouped_rows(batches, TILE_ROWS):
        yield pa.RecordBatch.from_pydict(
            {"dims": [dims], "qids": [ids.tobytes()], "queries": [matrix.tobytes()]}, pa.schema([("dims", pa.int32()), ("qids", pa.binary()), ("queries", pa.binary())])
        )


def score_slices(slices: np.ndarray, full: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of the scores, least significant first, and the constant to add; slices: component, bit, word."""
    dims, width, words = slices.shape
    size = np.abs(query)
    # a negative factor takes the complement: -a * x = a * (top - x) - a * top
    down = (query < 0).astype(bool)
    constant = -sum(size[down].tolist()) * ((1 << width) - 1)
    y = np.where(down[:, None, None], ~slices & full, slices)
    waiting: list[list[np.ndarray]] = [[] for _ in range(int(size.max(initial=0)).bit_length() + width + 1)]
    for i in range(int(size.max(initial=0)).bit_length()):
        chosen = y[((size >> i) & 1 == 1).astype(bool)]
        for j in range(width):
            if len(chosen):
                waiting[i + j].append(chosen[:, j])
    result = []
    weight = 0
    while weight < len(waiting):
        stack = np.concatenate(waiting[weight]) if waiting[weight] else np.zeros((0, words), np.uint64)
        carries = []
        while len(stack) > 1:
            if len(stack) == 2:
                carries.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
                break
            k = len(stack) // 3
            a, b, c = stack[:k], stack[k : 2 * k], stack[2 * k : 3 * k]
            ab = a ^ b
            carries.append((a & b) | (ab & c))
            stack = np.concatenate([ab ^ c, stack[3 * k :]])
        if carries:
            if weight + 1 == len(waiting):
                waiting.append([])
            waiting[weight + 1] += carries
        result.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        weight += 1
    return result, constant


def top_rows(scores: list[np.ndarray], valid: np.ndarray, k: int, n: int) -> np.ndarray:
    """Rows of the k highest scores among valid, from the most significant slice downward; ties to earlier rows."""
    sure, open_ = np.zeros_like(valid), valid.copy()
    if int(np.bitwise_count(valid).sum()) <= k:
        return np.flatnonzero(unpacked(valid, n))
    for s in reversed(scores):
        with_bit = open_ & s
        count = int(np.bitwise_count(sure | with_bit).sum())
        if count > k:
            open_ = with_bit
        else:
            sure, open_ = sure | with_bit, open_ & ~s
            if count == k:
                return np.flatnonzero(unpacked(sure, n))
    missing = k - int(np.bitwise_count(sure).sum())
    return np.concatenate([np.flatnonzero(unpacked(sure, n)), np.flatnonzero(unpacked(open_, n))[:missing]])


@dataclass
class Block:
    n: int
    ids: np.ndarray
    least: np.ndarray
    slices: np.ndarray
    full: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        slices = np.frombuffer(row["slices"], np.uint64).reshape(row["dims"], row["width"], -(-row["n"] // 64))
        return cls(row["n"], np.frombuffer(row["ids"], np.int64), integers(np.frombuffer(row["least"], np.float64)), slices, packed(np.ones(row["n"], np.uint8)))

    def best(self, qid: int, query: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        """Ids and scores of the k best rows but the query's own."""
        scores, constant = score_slices(self.slices, self.full, query)
        constant += sum(a * b for a, b in zip(query.tolist(), self.least.tolist(), strict=True))
        found = top_rows(scores, self.full & ~packed((self.ids == qid).astype(np.uint8)), k, self.n)
        values = [constant] * len(found)
        for w, s in enumerate(scores):
            hit = s[found >> 6] >> (found & 63).astype(np.uint64) & np.uint64(1)
            values = [v + (int(h) << w) for v, h in zip(values, hit, strict=True)]
        return self.ids[found].tolist(), values


def _search(k: int):
    """Answers from rows sorted by part, dims and kind: the blocks of a part first, then the tiles that meet them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks = None, []
        most = (1 << 63) - 1
        for batch in batches:
            for row in batch.to_pylist():
                if (row["part"], row["dims"]) != key:
                    key, blocks = (row["part"], row["dims"]), []
                if row["kind"] == 0:
                    blocks.append(Block.of(row))
                    continue
                qids = np.frombuffer(row["qids"], np.int64)
                queries = np.frombuffer(row["queries"], np.float64).reshape(len(qids), row["dims"])
                out: list[list] = [[], [], [], []]
                for block in blocks:
                    for qid, query in zip(qids.tolist(), queries, strict=True):
                        ids, values = block.best(qid, integers(query), k)
                        out[0] += [qid] * len(ids)
                        out[1] += ids
                        out[2] += [max(-most, min(most, v >> LOW_BITS)) for v in values]
                        out[3] += [v & ((1 << LOW_BITS) - 1) for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "high", "low"])

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query vector the k other rows of highest integer inner product.

    Components become floor(scale * x), of any size. Ties go to the smaller id. Vectors that are null, hold null or
    non-finite components, or have no id take no part; only vectors of the same length meet. Of rows that repeat a
    query's id one asks (the least vector) and none answers; other repeated rows each count. Scores beyond a long are
    ranked by their true value (beyond 2**124 as equal) and given as the largest or smallest long. Fewer than k
    candidates give fewer rows; an empty table gives an empty result; further columns are ignored.
    """
    rows = stored(quantised(vectors, scale, id_col, vector_col))
    asked = quantised(vectors.where(F.coalesce(is_query, F.lit(False))), scale, id_col, vector_col).groupBy("id").agg(F.min("q").alias("q"))
    n_blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    part = F.pmod(F.xxhash64("id", "q"), F.lit(n_blocks)).cast("int")
    shape = "part int, dims int, n int, width int, ids binary, least binary, slices binary"
    blocks = rows.withColumn("part", part).repartition("part").sortWithinPartitions("part", F.size("q"), "id").mapInArrow(build, shape)
    n_tiles = max(1, -(-asked.count() // TILE_ROWS))
    tiled = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_tiles)).cast("int")).repartition("part").sortWithinPartitions("part", F.size("q"))
    tiled = stored(tiled.mapInArrow(tiles, "dims int, qids binary, queries binary"))
    # blocks stay as they are built, one move each; copies of the tiles come to them
    meets = tiled.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("kind", F.lit(1))
    met = blocks.withColumn("kind", F.lit(0)).unionByName(meets, allowMissingColumns=True)
    # sorting keeps ids in order within a part, whose blocks are built in that order
    found = met.repartition(n_blocks, "part").sortWithinPartitions("part", "dims", "kind").mapInArrow(_search(k), "query_id long, vec_id long, high long, low long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id"))
    limit = F.lit((1 << 63) - 1)
    score = F.when(F.col("high") > 1, limit).when(F.col("high") < -2, -limit - 1).otherwise(F.shiftleft("high", LOW_BITS) + F.col("low"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
