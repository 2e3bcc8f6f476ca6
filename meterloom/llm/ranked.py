"""Ranked lexical search without random access (NRA).

Documents are indexed in shards where they lie: a shard holds, for each term that is asked for, the documents it occurs in
and how often. Counts over all documents give the weights of terms and the mean length. Each shard then answers every
item: the lists of its terms are sorted by impact and read from the top only, all to the same depth. What was read gives
each document a lower bound; the next impact of each list not yet seen for it gives an upper one. Reading goes on until
the best documents, their ties and their scores are settled, and the shards' answers merge by score.

Items come in groups of a bounded size (GROUP_BYTES of text, or one item), which are sent to all machines; each group is
one pass over the texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.llm.common import portions, small_batches, stored, text_bytes

#: Documents and occurrences of asked terms of a shard, at most (one document at least).
SHARD_DOCS, SHARD_POSTINGS = 8192, 2_000_000
#: Bytes of item texts of a group, about; first depth of reading; cells of (term, document) looked at together.
GROUP_BYTES, DEPTH, CELLS = 8 << 20, 128, 1 << 24
# Fixed values of the score: 100 * (1 - b), 100 * b, the factor of impacts and of term counts, the factor of lengths.
BASE, SLOPE, UNIT, COUNT_FACTOR, LENGTH_FACTOR = 25, 75, 1_000_000_000, 1000, 8

#: Bytes that aren't in terms become blanks, A-Z lower case.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


#: A group of items: numbers of its distinct terms; (id, terms, times) of each item. Plain values, as workers needn't have
#: this package.
Group = tuple[dict[bytes, int], list[tuple[int, np.ndarray, np.ndarray]]]


def grouped(rows: list[tuple[int, bytes]]) -> Group:
    """Items (id, text) that are searched together."""
    numbers: dict[bytes, int] = {}
    items = []
    for item, text in rows:
        counts = Counter(terms_of(text))
        terms = [numbers.setdefault(t, len(numbers)) for t in counts]
        items.append((item, np.array(terms, np.int64), np.array(list(counts.values()), np.int64)))
    return numbers, items


SHARD = "ids array<{kind}>, lengths binary, starts binary, terms binary, docs binary, counts binary"


def _shards(sent: Broadcast, kind: pa.DataType):
    """Shards of documents. Postings come sorted by term: terms and where their postings start, then documents and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value
        ids, lengths, terms, docs, counts = [], [], [], [], []

        def shard():
            term, doc, count = (np.array(x, np.int64) for x in (terms, docs, counts))
            by = np.argsort(term, kind="stable")
            own, starts = np.unique(term[by], return_index=True)
            parts = (np.array(lengths, np.int64), starts.astype(np.int32), own.astype(np.int32), doc[by].astype(np.int32), count[by].astype(np.int32))
            out = pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["ids", "lengths", "starts", "terms", "docs", "counts"])
            for x in (ids, lengths, terms, docs, counts):
                x.clear()
            return out

        for batch in portions(batches, "text"):
            for i, text in zip(batch.column("id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                found = Counter(terms_of(text))
                own = [(numbers[t], n) for t, n in found.items() if t in numbers]
                if ids and (len(ids) == SHARD_DOCS or len(terms) + len(own) > SHARD_POSTINGS):
                    yield shard()
                docs.extend([len(ids)] * len(own))
                terms.extend(t for t, _ in own)
                counts.extend(n for _, n in own)
                ids.append(i)
                lengths.append(found.total())
        if ids:
            yield shard()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents of each term of a shard; term -1 has documents with a term, -2 all terms with repeats."""
    for batch in batches:
        for row in batch.to_pylist():
            lengths, terms = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["terms"], np.int32)
            ends = [*np.frombuffer(row["starts"], np.int32)[1:].tolist(), len(row["docs"]) // 4][: len(terms)]
            df = np.diff(np.array([0, *ends], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *terms.tolist()], pa.int32()), pa.array([int((lengths > 0).sum()), int(lengths.sum()), *df.tolist()], pa.int64())], ["term", "n"])


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 ln((2 n + 2) / (2 df + 1))) of each document frequency."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)


def impacts(counts: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """The part of the score that doesn't depend on the term, for documents of the given lengths."""
    m = BASE + SLOPE * lengths * n // total
    return UNIT * counts // (COUNT_FACTOR * counts + LENGTH_FACTOR * m)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], order: np.ndarray, k: int, depth: int = 0) -> list[tuple[int, int]]:
    """(document, score) of the k highest sums above 0, ties by order; lists: documents and their positive addends, the
    highest addends first. Lists are read from the top only, to a depth that doubles until all is settled."""
    n, depth = len(order), depth or DEPTH
    low, seen, at = np.zeros(n, np.int64), np.zeros((len(lists), n), bool), 0
    alive = np.arange(n)
    while True:
        next_best = np.zeros(len(lists), np.int64)
        for t, (docs, addends) in enumerate(lists):
            part = docs[at:depth]
            low[part] += addends[at:depth]
            seen[t, part] = True
            if len(docs) > depth:
                next_best[t] = addends[depth]
        at, depth = depth, depth * 2
        high = low[alive] + next_best @ ~seen[:, alive]
        rank = np.lexsort((order[alive], -low[alive]))[:k]
        top = alive[rank]
        if not next_best.any():
            return [(d, s) for d, s in zip(top.tolist(), low[top].tolist(), strict=True) if s > 0]
        if len(top) == k and low[top[-1]] > 0:
            # what can't reach the k-th lower bound is out, whatever is read later
            rivals = high >= low[top[-1]]
            alive, settled = alive[rivals], (high[rank] == low[top]).all()
            if settled and rivals.sum() == k:
                return list(zip(top.tolist(), low[top].tolist(), strict=True))


def _answers(sent: Broadcast, n: int, total: int, k: int, arrow: pa.DataType):
    """The k best documents of each shard for each item of a group: (item, doc, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = row["ids"], np.frombuffer(row["lengths"], np.int64)
                starts, terms, docs, counts = (np.frombuffer(row[c], np.int32) for c in ("starts", "terms", "docs", "counts"))
                order = np.empty(len(ids), np.int64)
                order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))] = np.arange(len(ids))
                gain = impacts(counts.astype(np.int64), lengths[docs], n, total)
                ends = np.append(starts[1:], len(docs)).astype(np.int64) if len(starts) else starts
                by_term = {}
                for t, a, b in zip(terms.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    by = np.argsort(-gain[a:b], kind="stable")
                    by_term[t] = (docs[a:b][by], gain[a:b][by])
                out: tuple[list, list, list] = ([], [], [])
                for item, own, times in items:
                    lists = [(by_term[t], w) for t, w in zip(own.tolist(), (weight[own] * times).tolist(), strict=True) if t in by_term and w]
                    width = max(1, CELLS // max(1, len(lists)))  # documents that are looked at together
                    found: list[tuple[int, int]] = []
                    for base in range(0, len(ids), width):
                        cut = lambda d, g, w: (d, g * w) if width >= len(ids) else (d[(m := (d >= base) & (d < base + width))] - base, g[m] * w)
                        found += [(base + d, s) for d, s in nra([cut(d, g, w) for (d, g), w in lists], order[base : base + width], k)] if lists else []
                    for d, s in sorted(found, key=lambda x: (-x[1], order[x[0]]))[:k]:
                        out[0].append(item)
                        out[1].append(ids[d])
                        out[2].append(s)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], arrow), pa.array(out[2], pa.int64())], ["item_id", "doc", "score"])

    return run


def _groups(spark: SparkSession, items: DataFrame) -> Iterator[Group]:
    """Items in groups of about GROUP_BYTES (one item at least)."""
    sized = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-sized // GROUP_BYTES))
    for g in range(n) if sized else ():
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == g).orderBy("item").collect()
        if rows:
            yield grouped([(r["item"], r["text"].encode()) for r in rows])


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, exactly; equal scores by
    ascending id.

    A score sums, over the terms of an item with repeats, the term's weight times its impact in the document (see
    weights and impacts); frequencies, lengths and the number of documents with a term are counted over all documents.
    Null texts have no term; empty and termless documents take no part and are never returned; an item without a term
    that occurs has no rows. Repeated rows of documents each count and each are returned; documents without an id count
    but come last among equal scores. Of rows that repeat an item's id one asks (the greatest text); items without an id
    ask nothing. Long texts are read whole. An empty table on either side gives an empty result; further columns are
    ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"))
    asked = asked.where("item IS NOT NULL").groupBy("item").agg(F.max("text").alias("text"))
    parts = []
    for numbers, own in _groups(spark, asked):
        sent = spark.sparkContext.broadcast(numbers)
        shards = stored(texts.mapInArrow(_shards(sent, arrow), SHARD.format(kind=name)))
        counted = shards.select("lengths", "starts", "terms", "docs").mapInArrow(_counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
        found = {r["term"]: r["n"] for r in counted.collect()}  # no more rows than the group has terms
        n, total = found.pop(-1, 0), found.pop(-2, 0)
        if not total:
            continue
        df = np.zeros(len(numbers), np.int64)
        df[list(found)] = list(found.values())
        weight = np.where(df > 0, weights(df, n), 0)
        told = spark.sparkContext.broadcast((own, weight))
        parts.append(stored(shards.mapInArrow(_answers(told, n, total, k, arrow), f"item_id long, doc {name}, score long")))
    if not parts:
        return spark.createDataFrame([], f"item_id long, rank int, doc_id {name}, score long")
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", F.col("doc").alias(id_col), "score")
