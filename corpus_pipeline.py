"""A training-data pipeline over ``documents``: five stages, each one operator's decisions.

Every stage takes ``(spark, docs, sf_dir)`` and returns what it keeps; all but the last return the
columns of ``documents``. Each works on all that the stage before kept. The rows of the last stage
are pieces of packed sequences. Null texts go at the first stage; an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import common, language, packing, repeats, simhash, toxicity

#: Most bits a byte that a document needs under its language's sample: as many as its bytes have, whatever the number of languages.
MAX_LANGUAGE_BITS = 8.0


def _carried(docs: DataFrame) -> DataFrame:
    """Documents as one struct beside their id and text, so that no column of an operator can take the place of one of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "doc_id", "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined (a null text or one without a letter goes, and one that no language's sample explains)."""
    found = language.identify_languages(_carried(docs), language.fit_languages(docs))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("bits_per_byte") <= MAX_LANGUAGE_BITS)).select("__doc.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    model = toxicity.fit_toxicity(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(_carried(docs), model).where("predicted = 0").select("__doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id (none comes last), then the least row hash.

    Rows are told apart by id and content, so different texts under one id, or without one, all stay.
    """
    keyed = _carried(docs).withColumn("__row", F.xxhash64("text", *[F.col("__doc").getField(c) for c in docs.columns if c not in ("doc_id", "text")]))
    prints = common.checkpointed(simhash.fingerprints(keyed, words=4, carry=("__row",)))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("__id"), F.col("__row").alias("__first"))
    classes = simhash.linked_fingerprints(prints.groupBy("fp").agg(F.min(key).alias("key")), radius=4)
    first = common.written(classes.groupBy("component").agg(F.min("key").alias("key")).select("key.__id", "key.__first"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__first"))
    kept = keyed.join(first.hint("shuffle_hash"), same, "left_semi")
    repeated = not prints.groupBy("doc_id", "__row").count().where("count > 1").isEmpty()
    return (kept.dropDuplicates(["doc_id", "__row"]) if repeated else kept).select("__doc.*")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier; a document of which nothing is left goes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = repeats.remove_repeats(docs, with_text=True, carry=rest or ["doc_id"])
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.where("n_removed < n_bytes or n_bytes = 0").select(*[columns.get(c, F.col(f"carried.{c}")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 1,024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("toxicity", toxic), ("simhash", near_duplicates),
          ("suffix_dedup", passages), ("packing", pack)]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
