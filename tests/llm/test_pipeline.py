"""The pipeline's stages on a small corpus, compared with plain Python."""

import random

import pytest
import xxhash

import corpus_pipeline
from meterloom.llm.secrets import redact
from meterloom.llm.simhash import fingerprint, one_of_each

pytest.importorskip("public_tokenizers")


def test_redact(spark):
    key = "AKIA" + "Q7" * 8
    rows = [(1, f"é x password=abcdefgh12 y {key} z"), (2, None), (3, "clean text"), (4, "token: hunter2hunter2 password: tok")]
    got = {r.doc_id: r.text for r in redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "é x <assign> y <access> z", 2: None, 3: "clean text", 4: "<assign> password: tok"}


def test_one_of_each(spark):
    rows = [(i, "a b c d e f g " * (1 + i % 3), 1) for i in range(9)] + [(20, None, 1), (21, "", 1), (None, "lonely words in a row here", 1), (None, "lonely words in a row here", 1), (0, "a b c d e f g ", 1)]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string, root int")).collect()
    fps = {fingerprint((t or "").encode(), xxhash.xxh64_digest) for _, t, _ in rows}
    assert len(got) <= len(fps) and len({r.text or "" for r in got}) == len(got)
    assert sorted(str(r.doc_id) for r in got)[-1] == "None" and got[0].asDict().keys() == {"doc_id", "text", "root"}


def test_stages(spark, tmp_path):
    rng = random.Random(15)
    docs, labels = [], []
    for i in range(300):
        body = ["".join(rng.choice(["ba", "do", "ki", "lu", "me"]) for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(30, 60))]
        if i % 10 == 1:
            body[5:5] = ["grunk", "blarf"]
        if i % 10 == 2:
            body.insert(3, "password=abcdefgh12")
        docs.append((i, " ".join(body), "en", f"s{min(i % 7, 2)}", 0))
        labels.append((i, 1, int(i % 10 == 1)))
    docs += [(300 + i, docs[i * 10][1], "en", "s0", 0) for i in range(20)] + [(400, None, "en", "s0", 0), (401, "", None, None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept[name] = at.collect()
        if name != "packing":
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: sorted(r.doc_id for r in kept[name])
    toxic = {i for i in range(300) if i % 10 == 1}
    assert set(ids("toxicity")) == {d[0] for d in docs} - toxic
    assert set(ids("simhash")) == {d[0] for d in docs[:300] if d[0] not in toxic} | {400} and len(ids("simhash")) == len(set(ids("simhash")))
    assert ids("secrets") == ids("simhash") and not any("abcdefgh12" in (r.text or "") for r in kept["secrets"])
    assert set(ids("mixture")) <= set(ids("secrets")) and len(ids("mixture")) > 200
    assert sorted({r.doc_id for r in kept["packing"]}) == sorted(set(ids("mixture")))
    last = max(r.sequence_id for r in kept["packing"])
    filled = {}
    for r in kept["packing"]:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert all(filled[k] == 2048 for k in range(last))
