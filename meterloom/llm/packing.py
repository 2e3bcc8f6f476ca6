"""Packing token sequences: concatenate all documents and cut into fixed windows.

Pass one tokenises each partition and keeps, for each document, how many tokens stand before it in its partition. The
partition totals (one number a partition) are summed to partition offsets. Pass two adds them to the stored rows: every
document then knows its global offset, and cutting at multiples of the window needs no shuffle.
"""

from __future__ import annotations

import itertools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import BATCH_BYTES, portions, process_cache, stored, text_bytes

#: A worker keeps the ids of about this many words, in two generations.
CACHE_ENTRIES = 600_000
PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Letters beyond ASCII whose lower case and composition need no context.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def joins_no_words(description: str) -> bool:
    """Whether a tokenizer's JSON has only steps that keep words apart: lower case, composition, white space made equal,
    a split that leaves white space out and ends words before punctuation, and bytes as characters."""
    d = json.loads(description)
    steps = (d.get("normalizer") or {}).get("normalizers") or []
    splits = (d.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        {x["type"] for x in steps} <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in {x["type"] for x in steps}
        and all(x["pattern"] == {"Regex": r"\s+"} for x in steps if x["type"] == "Replace")
        and [x["type"] for x in splits] == ["Split", "ByteLevel"] and not splits[1]["add_prefix_space"]
        and splits[0]["invert"] and splits[0]["behavior"] == "Removed" and splits[0]["pattern"]["Regex"].endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    )


class ChunkEncoder:
    """Token ids of texts as packed little-endian integers.

    Where the tokenizer drops white space, ignores case and never joins across white space or from letters to
    punctuation (joins_no_words), a text's ids are those of its chunks between ASCII white space, one after another, and
    those of a word with punctuation behind it are the word's and the punctuation's. All other chunks are encoded
    whole, and with other tokenizers all texts.
    """

    def __init__(self, path: str, end_id: int, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        kept = process_cache(f"ids of {path}")
        if not kept:
            kept |= {"tokenizer": Tokenizer.from_file(path), "young": {}, "old": {}}
        self.kept, self.tokenizer, self.model = kept, kept["tokenizer"], kept["tokenizer"].model
        self.cache_entries = cache_entries
        self.by_words = joins_no_words(self.tokenizer.to_str())
        wide = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) >= 1 << 16
        self.kind, self.code = ("<u4", "I") if wide else ("<u2", "H")
        self.end = np.array([end_id], self.kind).tobytes()

    def _encode(self, words: list[bytes]) -> None:
        young, old = self.kept["young"], self.kept["old"]
        new = []
        for w in words:
            if w in old:
                young[w] = old[w]
            elif w.isalpha():  # ASCII letters in lower case are one piece, which the model takes as it is
                young[w] = array(self.code, [t.id for t in self.model.tokenize(w.decode())]).tobytes()
            else:
                new.append(w)
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                young[w] = array(self.code, e.ids).tobytes()

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        if not self.by_words:
            whole = [(t or b"").decode() for t in texts]
            return [array(self.code, e.ids).tobytes() + self.end for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        if len(self.kept["young"]) > self.cache_entries // 2:
            long = [w for w in self.kept["young"] if len(w) > 60]
            self.kept["old"], self.kept["young"] = self.kept["young"], {}
            for w in long:
                del self.kept["old"][w]
        split = [(t or b"").split() for t in texts]
        young = self.kept["young"]
        ids: dict[bytes, bytes] = {}
        later: list[tuple[bytes, bytes, bytes]] = []
        for c in set(itertools.chain.from_iterable(split)):
            word = stem = c.rstrip(PUNCTUATION)
            if stem.isalpha():
                word = stem.lower()
            elif LETTERS.fullmatch(stem):
                word = stem.decode().lower().encode()
            else:
                word = stem = c
            tail = c[len(stem) :]
            known = young.get(word)
            if known is not None and not tail:
                ids[c] = known
            elif known is not None and (behind := young.get(tail)) is not None:
                ids[c] = known + behind
            else:
                later.append((c, word, tail))
        if later:
            self._encode(list({w for _, *parts in later for w in parts if w and w not in young}))
            young[b""] = b""
            ids.update((c, young[word] + young[tail]) for c, word, tail in later)
        return [b"".join([ids[c] for c in chunks]) + self.end for chunks in split]


def tokenised(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, cache_entries: int) -> DataFrame:
    """Stored rows (doc_id, ids, part, before): before counts the tokens that precede the row in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encode, before = TaskContext.get(), ChunkEncoder(tokenizer_path, end_id, cache_entries), 0
        part, width = context.partitionId() if context else 0, len(encode.end)
        for batch in portions(batches, "text"):
            ids = encode(text_bytes(batch.column("text")))
            counts = np.array([len(x) // width for x in ids], np.int64)
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.binary()), pa.array(counts), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts)],
                ["id", "ids", "n", "part", "before"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(source.mapInArrow(run, f"id {kind}, ids binary, n long, part int, before long"))


def pack(
    df: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    cache_entries: int = CACHE_ENTRIES,
) -> DataFrame:
    """Cut the concatenated tokens of all documents into windows; one row for each piece of a document in a window.

    Returns (id, start, length, doc_tokens, sequence_id, offset, ids): ids are little-endian unsigned 32-bit. A null
    text counts as empty and has only its end token; a very long one is cut into as many windows as it needs. Only the
    last window can hold fewer tokens than window. Ids may be of any type; repeated rows are packed as often as they
    occur; an empty table gives an empty result; further columns are ignored.
    """
    rows = tokenised(df, tokenizer_path, end_id, id_col, text_col, cache_entries)
    totals = {r[0]: r[1] for r in rows.groupBy("part").agg(F.sum("n")).collect()}
    bases = dict(zip(sorted(totals), itertools.accumulate((totals[k] for k in sorted(totals)), initial=0), strict=False))
    shared = df.sparkSession.sparkContext.broadcast(bases)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, size = shared.value, 0
        out: list[tuple] = []
        id_type = None
        for batch in batches:
            id_type = batch.column("id").type
            for key, ids, n, part, before in zip(*(batch.column(k).to_pylist() for k in ("id", "ids", "n", "part", "before")), strict=True):
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                at, first = 0, base[part] + before
                while at < n:
                    sequence, offset = divmod(first + at, window)
                    length = min(window - offset, n - at)
                    out.append((key, at, length, n, sequence, offset, wide[4 * at : 4 * (at + length)]))
                    at += length
                    size += 4 * length + 48
                    if size > BATCH_BYTES:
                        yield flush(out, id_type)
                        out, size = [], 0
        if out:
            yield flush(out, id_type)

    def flush(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return rows.mapInArrow(run, f"id {kind}, {PIECES}").withColumnRenamed("id", id_col)
