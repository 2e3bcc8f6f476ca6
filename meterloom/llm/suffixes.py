"""Repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

A string of `length` bytes that starts at two places is the same there down to the least hash of its grams (`gram` bytes
each), so it is enough to sort the suffixes that start at such a gram (an anchor), together with what lies before them.
Anchors whose gram occurs once can't be part of a repeated string and drop out, as in sorting by distinguishing prefixes.

1. Texts are packed into compressed blocks once. Anchors are counted by the hash of their gram, first within a block; the
   hashes that occur again come back to their blocks.
2. Tasks sort their anchors' suffixes into runs: a key is the suffix, at most `length` bytes of it, followed by the bytes
   before the anchor in reverse, as far as strings reach of which it is the leftmost least gram. Equal keys become one entry with a count. Runs are kept as front-coded pages: the
   length of the prefix shared with the key before, and the rest.
3. Heads of pages give the limits of ranges. Pages are cut at them and exchanged; each range merges its runs with a loser
   tree whose nodes hold shared prefixes: keys are compared only beyond the prefix that both share with the last winner,
   and the prefixes shared by neighbours in the merged order come out of the tree.
4. For each distance from the start of a string to its anchor, keys are equal if they share the part after the anchor
   (neighbours in the merged order) and the part before it (neighbours in the order of those parts).

Limits lie between grams, so a class of equal strings lies in one range, unless so many keys share a gram that several
ranges begin inside it. Strings of classes that reach over such a limit are counted once more by their digest.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import bucketed, discard, portions, scratch_path, small_batches, stored, text_bytes

#: A block holds about so many bytes of text (or one text); texts are hashed in segments of so many bytes.
BLOCK_BYTES, SEGMENT_BYTES = 1 << 20, 1 << 19
#: Entries of a run, of a page of it, and of a range (about); ranges that keys of one gram may fill before they are split.
RUN_ENTRIES, PAGE_ENTRIES, RANGE_ENTRIES, GRAM_RANGES = 120_000, 4096, 60_000, 5


def squeezed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def expanded(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _packed_blocks(kind: pa.DataType):
    """Blocks of texts: (block, ids, sizes, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, total = [], [], 0

        def block():
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([squeezed(b"".join(texts))], pa.binary())],
                ["block", "ids", "sizes", "body"],
            )

        for batch in portions(batches, "text"):
            for i, text in zip(batch.column("id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                text = text or b""
                if ids and total + len(text) > BLOCK_BYTES:
                    yield block()
                    ids, texts, total = [], [], 0
                ids.append(i)
                texts.append(text)
                total += len(text)
        if ids:
            yield block()

    return run


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram of data; composed from hashes of powers of two."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62)) * 2 + 1
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    part, size, whole, done = rng.integers(1 << 63, size=256, dtype=np.uint64)[data], 1, None, 0
    while True:
        if gram & size:
            whole, done = (part, size) if whole is None else (whole[: len(data) - done - size + 1] * power(size) + part[done:], done + size)
        if size * 2 > gram:
            break
        part = part[: len(part) - size] * power(size) + part[size:]
        size *= 2
    whole = whole[: len(data) - gram + 1]
    whole ^= whole >> np.uint64(29)
    whole *= np.uint64(0xBF58476D1CE4E5B9)
    whole ^= whole >> np.uint64(32)
    return whole | np.uint64(1)


def sliding(values: np.ndarray, width: int, better) -> np.ndarray:
    """The least (np.minimum) or greatest (np.maximum) of each run of width values."""
    span = 1
    while span * 2 <= width:
        values = better(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return better(values[:-rest], values[rest:]) if rest else values


def anchors(body: bytes, sizes: list[int], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all grams that have the least hash of some string of length bytes within one text."""
    data = np.frombuffer(body, np.uint8)
    ends = np.cumsum(np.asarray(sizes, np.int64))
    width, found, hashes = length - gram + 1, [], []
    for low in range(0, max(0, len(data) - length + 1), SEGMENT_BYTES):
        part = data[low : low + SEGMENT_BYTES + length - 1]
        h = gram_hashes(part, gram)
        least = sliding(h, width, np.minimum)
        # strings that would reach over the end of a text have no least gram
        for end in ends[(ends > low) & (ends < low + len(part))] - low:
            least[max(0, end - length + 1) : end] = 0
        most = sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
        at = np.flatnonzero(h == most)
        found.append(at + low)
        hashes.append(h[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    positions, first = np.unique(np.concatenate(found), return_index=True)
    return positions, np.concatenate(hashes)[first]


def reach(at: np.ndarray, h: np.ndarray, sizes: list[int], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the bytes of the strings whose leftmost least gram is at each anchor; to - from < length if none is."""
    ends = np.cumsum(np.asarray(sizes, np.int64))
    text = np.searchsorted(ends, at, "right")
    low = np.maximum(ends[text] - np.asarray(sizes, np.int64)[text], at - length + gram)
    high = np.minimum(ends[text], at + length)
    for side in (-1, 1):
        rest, step = np.arange(len(at)), 0
        while len(rest):  # the nearest anchor that wins, by one more step aside each time
            step += side
            other = rest + step
            near = (other >= 0) & (other < len(at))
            rest, other = rest[near], other[near]
            near = at[other] >= low[rest] if side < 0 else at[other] + gram <= high[rest]
            rest, other = rest[near], other[near]
            wins = h[other] <= h[rest] if side < 0 else h[other] < h[rest]
            if side < 0:
                low[rest[wins]] = at[other[wins]] + 1
            else:
                high[rest[wins]] = at[other[wins]] + gram - 1
            rest = rest[~wins]
    return low, high


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, n = np.unique(anchors(expanded(row["body"], sum(row["sizes"])), row["sizes"], length, gram)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), row["block"])), pa.array(n.astype(np.int32))], ["h", "block", "n"])

    return run


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix of a and b, of which known bytes are known."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def page_body(keys: list[bytes], shared: list[int], after: list[int], counts: list[int]) -> bytes:
    """Front-coded keys: shared prefixes, sizes, sizes of the parts after the anchor, counts, and the bytes that are new."""
    head = np.array([[0, *shared[1:]], [len(k) for k in keys], after, counts], np.uint32)
    return squeezed(head.tobytes() + b"".join([keys[0], *(k[s:] for k, s in zip(keys[1:], shared[1:], strict=True))]))


def page_rows(body: bytes, n: int, size: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(key, prefix shared with the key before, size of the part after the anchor, count) of a page's entries."""
    data = expanded(body, size)
    shared, sizes, after, counts = np.frombuffer(data, np.uint32, 4 * n).reshape(4, n).tolist()
    at, key = 16 * n, b""
    for s, k, r, c in zip(shared, sizes, after, counts, strict=True):
        key = key[:s] + data[at : at + k - s]
        at += k - s
        yield key, s, r, c


PAGES = "run long, first int, n int, size int, head binary, body binary, entry array<int>, block array<long>, at array<int>"
_PAGES = pa.schema([
    ("run", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("head", pa.binary()), ("body", pa.binary()),
    ("entry", pa.list_(pa.int32())), ("block", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())),
])


def _unpacked_size(keys: list[bytes], shared: list[int]) -> int:
    return 16 * len(keys) + sum(map(len, keys)) - sum(shared[1:])


def sorted_pages(run: int, keys: list[bytes], after: list[int], blocks: list[int], places: list[int]) -> Iterator[dict]:
    """Pages of one run; places of equal keys are kept beside their common entry."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    entries: list[int] = []  # the first member of each entry
    members: list[list[int]] = []
    shared: list[int] = []
    for i in order:
        s = shared_prefix(keys[entries[-1]], keys[i]) if entries else 0
        if entries and s == len(keys[i]) == len(keys[entries[-1]]) and after[i] == after[entries[-1]]:
            members[-1].append(i)
        else:
            entries.append(i)
            members.append([i])
            shared.append(s)
    for low in range(0, len(entries), PAGE_ENTRIES):
        own, ms = entries[low : low + PAGE_ENTRIES], members[low : low + PAGE_ENTRIES]
        ks, ss = [keys[i] for i in own], shared[low : low + PAGE_ENTRIES]
        flat = [(low + e, i) for e, m in enumerate(ms) for i in m]
        yield {
            "run": run, "first": low, "n": len(own), "size": _unpacked_size(ks, ss), "head": ks[0], "body": page_body(ks, ss, [after[i] for i in own], [len(m) for m in ms]),
            "entry": [e for e, _ in flat], "block": [blocks[i] for _, i in flat], "at": [places[i] for _, i in flat],
        }


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys, after, blocks, places = [], [], [], []

        def pages():
            nonlocal number
            number += 1
            for page in sorted_pages(number, keys, after, blocks, places):
                yield pa.RecordBatch.from_pylist([page], _PAGES)
            for x in (keys, after, blocks, places):
                x.clear()

        for batch in batches:
            for row in batch.to_pylist():
                body = expanded(row["body"], sum(row["sizes"]))
                all_at, h = anchors(body, row["sizes"], length, gram)
                low, high = reach(all_at, h, row["sizes"], length, gram)
                chosen = np.flatnonzero(np.isin(h, np.array(row["again"], np.int64).view(np.uint64)))
                chosen = chosen[high[chosen] - low[chosen] >= length]
                for at, start, end in zip(all_at[chosen].tolist(), low[chosen].tolist(), high[chosen].tolist(), strict=True):
                    keys.append(body[at:end] + body[start:at][::-1])
                    after.append(end - at)
                    blocks.append(row["block"])
                    places.append(at)
                    if len(keys) == RUN_ENTRIES:
                        yield from pages()
        if keys:
            yield from pages()

    return run


def limits_of(heads: list[bytes], gram: int) -> list[bytes]:
    """Limits of ranges from the least heads of the parts of a range partitioning: cut before the end of the gram, so
    that keys of one gram stay together, unless the limit before lies in the same gram."""
    limits: list[bytes] = []
    inside = 0
    for head in sorted(heads)[1:]:
        short = head[: gram - 1]
        inside = inside + 1 if limits and short <= limits[-1] else 0
        if not inside:
            limits.append(short)
        elif inside % GRAM_RANGES == 0 and head > limits[-1]:
            limits.append(head)
    return limits


def _cut(limits: list[bytes]):
    """Pages cut at the limits: (part, run, first, n, size, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, shared, after, counts = map(list, zip(*page_rows(row["body"], row["n"], row["size"]), strict=True))
                at, out = 0, []
                while at < len(keys):
                    part = bisect_left(limits, keys[at] + b"\0") if limits else 0
                    end = bisect_left(keys, limits[part], at) if part < len(limits) else len(keys)
                    ks, ss = keys[at:end], shared[at:end]
                    out.append({"part": part, "run": row["run"], "first": row["first"] + at, "n": end - at, "size": 16 * len(ks) + sum(map(len, ks)) - sum(ss[1:]), "body": page_body(ks, ss, after[at:end], counts[at:end])})
                    at = end
                yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("run", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("body", pa.binary())]))

    return run


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge sorted streams of (key, prefix shared with the stream's key before, ...) by a loser tree; yields
    (key, prefix shared with the key yielded before, ...). Bytes of a prefix that two keys are known to share are never
    compared again."""
    leaves = 1 << max(0, len(runs) - 1).bit_length()
    rows: list = [next(r, None) for r in runs] + [None] * (leaves - len(runs))
    shared = [0] * leaves  # with the last winner

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), with the loser's prefix shared with the winner."""
        if rows[a] is None or rows[b] is None:
            return (b, a) if rows[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = rows[a][0], rows[b][0]
        common = shared_prefix(x, y, shared[a])
        if common == len(x) or (common < len(y) and x[common] < y[common]):
            shared[b] = common
            return a, b
        shared[a] = common
        return b, a

    losers, level = [0] * leaves, list(range(leaves))
    while len(level) > 1:
        played = [duel(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        for i, (_, loser) in enumerate(played):
            losers[len(played) + i] = loser
        level = [winner for winner, _ in played]
    best = level[0]
    while rows[best] is not None:
        row = rows[best]
        yield row[0], shared[best], *row[2:]
        rows[best] = next(runs[best], None)
        if rows[best] is not None:
            shared[best] = rows[best][1]
        node = (leaves + best) >> 1
        while node:
            best, losers[node] = duel(best, losers[node])
            node >>= 1


def repeats(keys: list[bytes], shared: np.ndarray, after: np.ndarray, counts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Whether the string that starts d bytes before the anchor of each entry occurs again: (distances, entries)."""
    n = len(keys)
    before = [k[a:] for k, a in zip(keys, after.tolist(), strict=True)]
    order = sorted(range(n), key=before.__getitem__)
    common = np.array([0, *(shared_prefix(before[i], before[j]) for i, j in pairwise(order))])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sizes = np.array([len(b) for b in before])
    out = np.zeros((length - gram + 1, n), bool)
    for d in range(length - gram + 1):
        rest = length - d
        met = np.flatnonzero((after >= rest) & (sizes >= d))
        if not len(met):
            continue
        left = np.cumsum(common < d) if d else np.zeros(n, np.int64)
        key = np.cumsum(shared < rest)[met] * (n + 1) + left[place[met]]
        by = np.argsort(key)
        starts = np.flatnonzero(np.diff(key[by], prepend=-1))
        again = np.repeat(np.add.reduceat(counts[met][by], starts) > 1, np.diff([*starts, len(by)]))
        out[d, met[by[again]]] = True
    return out


def reaching(keys: list[bytes], shared: np.ndarray, after: np.ndarray, low: bytes | None, high: bytes | None, length: int, gram: int) -> Iterator[tuple[int, int, bytes]]:
    """(entry, distance, string) of the strings whose class may go on in a neighbouring range."""
    n, first, last = len(keys), shared_prefix(keys[0], low) if low else 0, shared_prefix(keys[-1], high) if high else 0
    for d in range(length - gram + 1):
        rest = length - d
        breaks = np.flatnonzero(shared[1:] < rest) + 1
        spans = ([(0, breaks[0] if len(breaks) else n)] if first >= rest else []) + ([(breaks[-1] if len(breaks) else 0, n)] if last >= rest else [])
        for e in sorted({e for a, b in spans for e in range(a, b)}):
            part = keys[e][after[e] :]
            if after[e] >= rest and len(part) >= d:
                yield e, d, part[:d][::-1] + keys[e][:rest]


def _merge(limits: list[bytes], length: int, gram: int):
    """(run, entry, low, high): distances at which strings occur again; or (run, entry, low, digest, n) of those to be
    counted over ranges. Rows come sorted by part, run and first."""

    def judged(part: int, pages: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
        stream = lambda run, own: ((*row, run, p["first"] + i) for p in own for i, row in enumerate(page_rows(p["body"], p["n"], p["size"])))
        rows = list(merged([_front(stream(run, own)) for run, own in pages.items()]))
        keys, shared, after, counts, runs, entries = map(list, zip(*rows, strict=True))
        del rows
        shared, after, counts = np.array(shared), np.array(after), np.array(counts)
        shared[0] = 0
        found = repeats(keys, shared, after, counts, length, gram)
        edges = np.diff(np.pad(found, ((1, 1), (0, 0))).astype(np.int8), axis=0).T
        e, low = np.nonzero(edges == 1)
        high = np.nonzero(edges == -1)[1] - 1
        runs, entries = np.array(runs), np.array(entries, np.int32)
        yield _judgement(runs[e], entries[e], low, high, [None] * len(e), [0] * len(e))
        far = reaching(keys, shared, after, limits[part - 1] if part else None, limits[part] if part < len(limits) else None, length, gram)
        while chunk := list(islice(far, 10_000)):
            es, ds = [e for e, *_ in chunk], [d for _, d, _ in chunk]
            yield _judgement(runs[es], entries[es], ds, ds, [hashlib.blake2b(x, digest_size=16).digest() for *_, x in chunk], counts[es])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pages = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part and pages:
                    yield from judged(part, pages)
                    pages = {}
                part = row["part"]
                pages.setdefault(row["run"], []).append(row)
        if pages:
            yield from judged(part, pages)

    return run


def _front(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The same rows; the first of each page of a run but the first gets its shared prefix, which pages don't keep."""
    before = None
    for row in rows:
        yield row if before is None or row[1] else (row[0], shared_prefix(before, row[0]), *row[2:])
        before = row[0]


JUDGED = "run long, entry int, low int, high int, digest binary, n int"


def _judgement(runs, entries, low, high, digests, n) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((runs, entries, low, high, digests, n), kinds, strict=True)], ["run", "entry", "low", "high", "digest", "n"])


def _kept(kind: pa.DataType):
    """(id, n_bytes, spans, kept) of each text of the blocks, from (start, end) pairs within the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                body, base = expanded(row["body"], sum(row["sizes"])), 0
                pairs = sorted((s["start"], s["end"]) for s in row["spans"] or [])
                spans, kept, at = [], [], 0
                for size in row["sizes"]:
                    own: list[list[int]] = []
                    while at < len(pairs) and pairs[at][0] < base + size:
                        start, end = pairs[at][0] - base, pairs[at][1] - base
                        if own and start <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], end)
                        else:
                            own.append([start, end])
                        at += 1
                    edges = [0, *(x for pair in own for x in pair), size]
                    kept.append(b"".join(body[base + a : base + b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"start": a, "end": b} for a, b in own])
                    base += size
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], kind), pa.array(row["sizes"], pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return run


def repeated_spans(df: DataFrame, length: int = 200, gram: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept) of each row of df: the maximal runs of UTF-8 bytes that are covered by strings of
    length bytes which start anywhere else as well (same text included, overlapping or not), and the bytes outside them.

    Strings never cross the ends of texts. Null texts count as empty; empty texts and those shorter than length have no
    spans. Repeated rows are each other's copies, so they go whole if they are long enough. Long texts are hashed in
    segments and stay one row. An empty table gives an empty result; ids may be null or of any type; further columns are
    ignored. Order of rows and layout of files don't matter.
    """
    if not 0 < gram <= length:
        raise ValueError("a gram has 1 to length bytes")
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[id_col].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = bucketed(texts.mapInArrow(_packed_blocks(arrow), f"block long, ids array<{name}>, sizes array<int>, body binary"), "block", "uncompressed")
    path = scratch_path(spark)
    found = stored(blocks.select("block", "sizes", "body").mapInArrow(_anchor_rows(length, gram), "h long, block long, n int"), path=path)
    twice = found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    again = found.select("h", "block").join(twice, "h", "left_semi").groupBy("block").agg(F.collect_list("h").alias("again"))
    pages = stored(blocks.select("block", "sizes", "body").join(again, "block").mapInArrow(_runs(length, gram), PAGES))
    discard(spark, path)
    n_ranges = max(1, -(-(pages.agg(F.sum("n")).first()[0] or 0) // RANGE_ENTRIES))
    heads = pages.select("head").repartitionByRange(n_ranges, "head").groupBy(F.spark_partition_id()).agg(F.min("head").alias("head"))
    limits = limits_of([bytes(r["head"]) for r in heads.collect()], gram) if n_ranges > 1 else []
    cut = pages.select("run", "first", "n", "size", "body").mapInArrow(_cut(limits), "part int, run long, first int, n int, size int, body binary")
    dealt = cut.repartition(len(limits) + 1, "part").sortWithinPartitions("part", "run", "first")
    judged = stored(dealt.mapInArrow(_merge(limits, length, gram), JUDGED))
    far = judged.where("digest IS NOT NULL")
    met = far.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    marks = judged.where("digest IS NULL").unionByName(far.join(met, "digest", "left_semi")).select("run", "entry", "low", "high")
    members = pages.select("run", F.explode(F.arrays_zip("entry", "block", "at")).alias("m")).select("run", "m.*")
    spans = members.join(marks, ["run", "entry"]).select("block", F.struct((F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end")).alias("s"))
    joined = blocks.join(spans.groupBy("block").agg(F.collect_list("s").alias("spans")), "block", "left")
    shape = f"id {name}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return joined.select("ids", "sizes", "body", "spans").mapInArrow(_kept(arrow), shape).withColumnRenamed("id", id_col)
