"""Registered queries of the text operators: name -> f(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (
    alignment,
    bpe,
    common,
    hamming,
    html,
    language,
    negatives,
    packing,
    quality,
    recurrent,
    repeats,
    simhash,
    tokencount,
    toxicity,
)


def vocabulary() -> str:
    """The vocabulary file that the token queries use."""
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    samples = language.fit_languages(docs)
    return language.identify_languages(docs.select("doc_id", "text"), samples) \
        .select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(common.table(spark, sf_dir, "documents"), size=100)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model) \
        .select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "passages")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"), words=4, radius=4)


def op5_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality.quality_verdicts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary()
    return bpe.encode_digests(docs, bpe.fit_lexicon(docs, path), path).drop("text")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hamming.search(rows, rows.where(F.col("vec_id") % 50 == 0), k=10)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), vocabulary())


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(common.table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return alignment.align_documents(docs, vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(common.table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.score(common.table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


REGISTRY = {f.__name__: f for f in (op1_language_id, op2_repeated_passages, op3_toxicity, op4_simhash, op5_token_fertility, op6_bpe, op7_top_k, op8_token_counts,
                                    op9_best_fit_packing, op10_main_text, op11_token_alignment, op12_hard_negatives, op13_lm_scores, pipeline)}

ORACLE: dict[str, str] = {
    "op7_top_k": """
WITH v AS (
  SELECT vec_id, CAST(rpad(array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END for x in embedding[1:64]], ''), 64, '0') AS BIT) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, CAST(bit_count(xor(a.code, b.code)) AS INTEGER) AS distance,
  CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY bit_count(xor(a.code, b.code)), b.vec_id) AS INTEGER) AS rank
FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
QUALIFY rank <= 10
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5
""",
}
