"""Sharding by minimax contiguous partition.

Groups of equal texts are atoms. Ordered by a 64-bit hash of the text, they are cut into at most n_shards runs so that
the largest run is as small as possible: a binary search finds the smallest capacity for which filling shards greedily
needs no more than n_shards.

The driver never sees the groups. It sees totals of cells, ranges of the hash, and works with two bounds: a cell that
counts as an atom (no cut inside: an upper bound of the capacity) and a cell that can be cut anywhere (a lower bound).
Only cells that can hold a cut are split further, so each round gathers a number of cells that depends on n_shards and
not on the data. When both bounds agree, the greedy cuts of that capacity fall on borders of cells and are exact.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.llm.common import stored

FIRST_BITS, STEP_BITS = 12, 5


def _cells(groups: DataFrame, bits: int, inside: tuple[int, list[int]] | None = None) -> dict[tuple, tuple]:
    """(bits, prefix) -> (least hash, total, largest group, groups) of every cell, or of those inside wider ones."""
    if inside:
        groups = groups.where(F.shiftright("h", 64 - inside[0]).isin(inside[1]))
    prefix = F.shiftright("h", 64 - bits) if bits < 64 else F.col("h")
    rows = groups.groupBy(prefix.alias("p")).agg(F.min("h"), F.sum("w"), F.max("w"), F.count("*")).collect()
    return {(bits, r[0]): tuple(r[1:]) for r in rows}


def _greedy(sizes: list[int], capacity: int) -> list[int] | None:
    """Indices of the cells that open a shard, or None if one cell exceeds the capacity."""
    cuts, room = [0], capacity
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if size > room:
            cuts.append(i)
            room = capacity
        room -= size
    return cuts


def _fluid_shards(cells: list[tuple], capacity: int) -> int:
    """Shards that greedy filling needs at least, if cells of several groups can be cut anywhere."""
    shards, room = 1, capacity
    for _, total, largest, n in cells:
        if largest > capacity:
            return 1 << 60
        if n == 1:
            if total > room:
                shards, room = shards + 1, capacity
            room -= total
        else:
            if total > room:
                more = -(-(total - room) // capacity)
                shards, room = shards + more, room + more * capacity
            room -= total
    return shards


def _smallest(low: int, high: int, feasible) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def _may_hold_cuts(cells: list[tuple], n_shards: int, low: int, high: int) -> list[bool]:
    """Which cells of several groups can contain a greedy cut for some capacity from low to high."""
    starts, at = [], 0
    for c in cells:
        starts.append(at)
        at += c[1]
    marked, early, late = [False] * len(cells), 0, 0
    for _ in range(n_shards):
        reach = early + low
        if reach < at:
            k = bisect_right(starts, reach) - 1
            early = max(starts[k], reach - cells[k][2], early)
        else:
            early = at
        late = min(at, late + high)
        if early >= at:
            break
        for k in range(bisect_right(starts, early) - 1, bisect_right(starts, late)):
            marked[k] = marked[k] or cells[k][3] > 1
    return marked


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[list[int], int]:
    """For groups (h long, w long: one row per atom) the least hash of every shard but the first, and the capacity."""
    found = _cells(groups, FIRST_BITS)
    while found:
        keys = sorted(found, key=lambda k: found[k][0])
        cells = [found[k] for k in keys]
        sizes = [c[1] for c in cells]
        floor = max(max(c[2] for c in cells), -(-sum(sizes) // n_shards))
        low = _smallest(floor, sum(sizes), lambda x: _fluid_shards(cells, x) <= n_shards)
        high = _smallest(low, sum(sizes), lambda x: (g := _greedy(sizes, x)) is not None and len(g) <= n_shards)
        if low == high:
            return [cells[i][0] for i in _greedy(sizes, low)[1:]], low
        split = [k for k, m in zip(keys, _may_hold_cuts(cells, n_shards, low, high), strict=True) if m]
        width = min(k[0] for k in split)
        wide = [k for k in split if k[0] == width]
        for k in wide:
            del found[k]
        found |= _cells(groups, min(64, width + STEP_BITS), (width, [k[1] for k in wide]))
    return [], 0


def shard(
    df: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16,
    bucket_rows: tuple[int, int] = (1000, 500_000),
) -> DataFrame:
    """Assign every row a shard; returns (id, size, text_crc32, shard, slot).

    Rows of equal texts share a shard; null is a text of its own (no bytes, checksum of nothing). Sizes of shards are
    as near equal as whole groups in hash order permit. slot numbers the rows of a shard from 0 without gaps; within a
    shard rows are dealt into buckets of bounded size by their id, so no shard is sorted in one task. Repeated rows
    each get a slot. An empty table gives an empty result; further columns are ignored.
    """
    text = F.col(text_col)
    rows = stored(
        df.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text).alias("h"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        )
    )
    groups = stored(rows.groupBy("h").agg(F.sum("size").alias("w")))
    cuts, _ = minimax_cuts(groups, n_shards)
    rows = rows.withColumn("shard", _at_or_after(F.col("h"), cuts))
    counts = {r[0]: r[1] for r in rows.groupBy("shard").count().collect()}
    aim = min(max(sum(counts.values()) // (8 * n_shards), bucket_rows[0]), bucket_rows[1])
    buckets = F.array(*[F.lit(max(1, -(-counts.get(s, 0) // aim))).cast("long") for s in range(n_shards)])
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "size"), F.get(buckets, F.col("shard"))))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    starts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", before.alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy("id", "h")
    return (
        rows.withColumn("k", F.row_number().over(order) - 1)
        .join(starts, ["shard", "bucket"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("k")).alias("slot"))
    )


def _at_or_after(h: Column, cuts: list[int]) -> Column:
    """How many of the cuts lie at or before h."""
    found = F.lit(0)
    for cut in cuts:
        found = found + (h >= F.lit(cut).cast("long")).cast("int")
    return found
