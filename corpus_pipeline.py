"""The corpus pipeline: stages over documents, each writing Parquet that the next one reads.

Toxic documents go, one document of each group of near copies stays, secrets are replaced by their kinds, sources are
mixed to target weights (documents of small sources come more than once, some of large ones not at all), and the tokens
are packed into windows. All stages but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm import common
from meterloom.llm.mixture import Mixture
from meterloom.llm.nearcopies import one_near_copy
from meterloom.llm.packing import pack
from meterloom.llm.secrets import redact
from meterloom.llm.toxicity import fit_toxicity, toxicity_score

WINDOW, END_ID, TOXIC, SIMILAR = 2048, 1, 0.5, 0.8
#: Words whose ids a worker keeps in the last stage, and rows of an Arrow batch; workers may still hold what other stages
#: took.
CACHED_WORDS, BATCH_ROWS = 40_000, 1000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC, after the labels of four fifths of them. Repeated rows share their fate; null and
    empty texts go only if most labelled documents without words are toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(common.id_remainder("doc_id", 5) != 0)
    return docs.where(toxicity_score(F.col("text"), fit_toxicity(docs, labels), spark) < TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group whose texts are chained by similarities of SIMILAR or more. Null
    and wordless texts are one group."""
    return one_near_copy(docs, least=SIMILAR)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kinds; null and empty texts stay as they are."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them; those without words use no budget, a null source is a
    source of its own."""
    return Mixture(docs, entropy=0.98, most_passes=4.0).documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of WINDOW tokens; a null or empty text has its end token alone."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), WINDOW, END_ID, cache_entries=CACHED_WORDS)


def in_small_batches(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release_memory()  # of the stages before
        common.small_batches(spark, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("simhash", in_small_batches(drop_copies)),
    ("secrets", in_small_batches(hide_secrets)),
    ("mixture", in_small_batches(mix_sources)),
    ("packing", in_small_batches(pack_windows)),
]

#: No SQL: nearest examples, fingerprints and token ids are beyond it. The tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline/{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
