"""The numbered queries: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm import common
from meterloom.llm.bitsliced import top_k
from meterloom.llm.language import fit_language, language
from meterloom.llm.mixing_lm import score_texts
from meterloom.llm.mixture import Mixture
from meterloom.llm.negatives import hard_negatives
from meterloom.llm.packing import pack
from meterloom.llm.quality import outliers
from meterloom.llm.ranked import search
from meterloom.llm.secrets import find_secrets
from meterloom.llm.sharding import shard
from meterloom.llm.simhash import near_duplicates
from meterloom.llm.suffixes import repeated_spans
from meterloom.llm.toxicity import fit_toxicity, toxicity


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    return shard(common.table(spark, sf_dir, "documents"), n_shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def span_list(spans):
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts and digests of the fixed patterns, and all spans."""
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = span_list(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens: one row for each piece."""
    import public_tokenizers

    pieces = pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose fingerprints differ in at most four bits."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"), radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors by inner product of every vector whose id is divisible by 50."""
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from four fifths of them."""
    docs, held_out = common.table(spark, sf_dir, "documents"), common.id_remainder("doc_id", 5) == 0
    model = fit_language(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language(F.col("text"), model, spark).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op3_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learnt from six sevenths of them."""
    return score_texts(common.table(spark, sf_dir, "documents"), common.id_remainder("doc_id", 7) != 2)


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 0.98 of the entropy of equal weights, with at most four passes over a source."""
    mixed = Mixture(common.table(spark, sf_dir, "documents"), entropy=0.98, most_passes=4.0)
    weights = mixed.weights.select("source", "weight", "passes")
    return mixed.listed().join(weights, "source").select(F.col("id").alias("doc_id"), F.expr("nullif(source, '~')").substr(2, 1 << 30).alias("source"), "tokens", "epoch", "position", "weight", "passes")


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
a AS (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM a JOIN v b ON a.vec_id <> b.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, from the labels of four fifths of them."""
    docs, held_out = common.table(spark, sf_dir, "documents"), common.id_remainder("doc_id", 5) == 0
    labels = common.table(spark, sf_dir, "labels").where(~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity(F.col("text"), fit_toxicity(docs, labels), spark).alias("s"))
    return scored.select("doc_id", "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.evidence")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of all documents, with outliers by language and source."""
    return outliers(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur again, removed from all documents."""
    found = repeated_spans(common.table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; one label in seven is moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=5, window=(80, 100), scale=256)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= 5
"""


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
c AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM terms WHERE len(t) > 0),
o AS (SELECT doc_id, len(t) AS size, unnest(t) AS term FROM terms),
tf AS (SELECT doc_id, size, term, count(*) AS tf FROM o GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c WHERE term IN (SELECT term FROM q) GROUP BY term, n),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10
"""


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_language": op2_language,
    "op3_mixing_lm": op3_mixing_lm,
    "op4_mixture": op4_mixture,
    "op5_topk": op5_topk,
    "op6_secrets": op6_secrets,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_suffixes": op11_suffixes,
    "op12_negatives": op12_negatives,
    "op13_ranked": op13_ranked,
}
ORACLE_SQL: dict[str, str] = {"op5_topk": OP5_SQL, "op12_negatives": OP12_SQL, "op13_ranked": OP13_SQL}
