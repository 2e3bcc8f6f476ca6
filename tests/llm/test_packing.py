import random

import pytest

from meterloom.llm.packing import ChunkEncoder, pack

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_chunks_equal_whole_texts(spark):
    from tokenizers import Tokenizer

    whole, chunks = Tokenizer.from_file(PATH), ChunkEncoder(PATH, 1)
    rng = random.Random(1)
    alphabet = "aAbBzéÉßΣσς'’sStTdD019.,!? \t\n\r\v\f\x1c\x85\xa0  é̈漢字🙂<|endoftext|>İı"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", " ", "a<|endoftext|>b <|startoftext|> C", "It's they'll WE'D"]
    for text, ids in zip(texts, chunks([t.encode() for t in texts]), strict=True):
        import numpy as np

        assert np.frombuffer(ids, chunks.kind).tolist() == whole.encode(text, add_special_tokens=False).ids + [1], text


def test_round_trip(spark):
    import numpy as np
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(rng.randrange(40))), 0) for i in range(200)]
    rows += [(200, None, 0), (201, "", 0), (202, "word " * 5000, 0), (None, "q", 0), (5, rows[5][1], 0)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(5), PATH, window=64).collect()
    assert all(0 < r.length <= 64 and r.offset + r.length <= 64 and len(r.ids) == 4 * r.length for r in got)
    last = max(r.sequence_id for r in got)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert all(filled[k] == 64 for k in range(last)) and sorted(filled) == list(range(last + 1))
    encode = Tokenizer.from_file(PATH)
    for doc, text, _ in rows:
        if doc == 5:
            continue
        pieces = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        ids = [x for r in pieces for x in np.frombuffer(bytes(r.ids), "<u4").tolist()]
        assert ids == encode.encode(text or "", add_special_tokens=False).ids + [1]
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert all(r.doc_tokens == len(ids) for r in pieces)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
