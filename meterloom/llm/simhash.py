"""SimHash near-duplicates through covering locality-sensitive hashing.

Bit i of a fingerprint gets a vector of radius + 1 bits, and the mask of each non-zero vector v has the bits whose own
vectors have an odd product with v. Two fingerprints that differ in at most radius bits agree under some mask: their
differing bits give at most radius linear equations in radius + 1 unknowns, which have a non-zero solution v. So
2**(radius + 1) - 1 tables of masked fingerprints find every pair within the radius, and no other pair is ever linked,
as distances are checked.

Only distinct fingerprints enter the tables. A bucket of two is checked with column expressions; a larger one goes to a
task that walks it and returns a spanning forest of its links, never all pairs. Buckets beyond bucket_rows are cut into
chunks, and every two chunks meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import portions, stored, text_bytes
from meterloom.llm.components import components

SHINGLE_WORDS, SEED, BUCKET_ROWS = 4, 42, 4096


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The masks as signed longs; vectors are dealt to bits in turn, so all masks keep about half of the bits."""
    n = (1 << (radius + 1)) - 1
    masks = [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint(text: bytes, digest) -> int:
    """The signed 64-bit SimHash of the shingles of lower-cased words; digest gives big-endian XXH64 bytes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate(map(len, words), lambda at, n: at + n + 1, initial=0))
    if len(words) < SHINGLE_WORDS:
        hashes = digest(joined, SEED)
    else:
        hashes = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts, starts[SHINGLE_WORDS:], strict=False)])
    n = len(hashes) // 8
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8 << 16):
        part = np.frombuffer(hashes[at : at + (8 << 16)], np.uint8)
        counts += np.unpackbits(part).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored (id, fp): fp is the fingerprint as a signed long; null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in portions(batches, "text"):
            found = [fingerprint(t or b"", xxhash.xxh64_digest) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return stored(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long"))


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of values that differ in at most radius bits."""
    rest, links = np.unique(values), []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            value = todo.pop()
            near = np.bitwise_count(rest ^ value) <= radius
            if near.any():
                found = rest[near]
                links += [(value, x) for x in found]
                todo.extend(found)
                rest = rest[~near]
    return links


def _forests(radius: int):
    """Links within each run of rows of one group; batches come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        group = None
        out: list[tuple[int, int]] = []

        def emit():
            a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("t", "key", "i", "j")]
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for start, end in zip([0, *change], [*change, len(values)], strict=True):
                if start == end:
                    continue
                now = tuple(k[start] for k in keys)
                if now != group and held:
                    out += forest(np.concatenate(held), radius)
                    held = []
                    if len(out) > 100_000:
                        yield emit()
                group = now
                held.append(values[start:end].copy())
        if held:
            out += forest(np.concatenate(held), radius)
        if out:
            yield emit()

    return run


def links(nodes: DataFrame, radius: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that connect all that are within the radius of each other."""
    masked = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks(radius)])
    rows = nodes.select("fp", F.posexplode(masked).alias("t", "key")).withColumn("t", F.col("t").cast("byte"))
    buckets = stored(
        rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = buckets.where((F.col("n") == 2) & near).select("a", "b")
    large = rows.join(buckets.where("n > 2").select("t", "key", "n"), ["t", "key"])
    chunks = F.ceil(F.col("n") / bucket_rows).cast("int")
    dealt = large.withColumn("k", chunks).withColumn("c", F.pmod(F.hash("fp"), F.col("k")))
    meets = F.when(F.col("k") == 1, F.array(F.col("c"))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda x: x != F.col("c")))
    dealt = dealt.withColumn("o", F.explode(meets)).select("t", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    sorted_rows = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return pairs.unionByName(sorted_rows.mapInArrow(_forests(radius), "a long, b long")).distinct()


def near_duplicates(df: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each row of df: (id, fp, root, component_id).

    fp is the fingerprint as a signed long, root a fingerprint that names the component, component_id the least id in
    it (null if all its ids are null). Wordless and null texts have fingerprint 0 and are linked like any other;
    repeated rows share their component; an empty table gives an empty result; further columns are ignored.
    """
    rows = fingerprints(df, id_col, text_col)
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes, radius, bucket_rows))
    nodes = stored(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.select("fp", "root").join(least, "root")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "root", "component_id")


def one_of_each(df: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with its columns, that have the least id of their component; one row where several have."""
    found = near_duplicates(df, radius, id_col, text_col)
    first = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("fp", id_col)).alias("k"))
    keep = first.select(F.col("k.fp").alias("_fp"), F.col(f"k.{id_col}").alias("_id"))

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for part in texts:
            yield pd.Series([fingerprint(t.encode() if t else b"", xxhash.xxh64_digest) for t in part], dtype="int64")

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), fp(F.col(f"`{text_col}`")).alias("_fp"), F.col(f"`{id_col}`").alias("_id"))
    rows = rows.join(keep.withColumnRenamed("_id", "_keep"), "_fp").where(F.col("_id").eqNullSafe(F.col("_keep")))
    return rows.groupBy("_fp", "_id").agg(F.first("row").alias("row")).select("row.*")
