"""A document pipeline over the training-data operators: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and gives the rows read back to the next stage. Only ids meet texts in the joins, so
texts are not shuffled unless more than ``BROADCAST_IDS`` ids are to be dropped.

Edge cases: documents without an id can't be in a group, nor be named by the decontamination, and stay
(the toxicity stage reads them as others); empty texts stay, each its own group; of rows that repeat
an id and a text one stays; rows of one id with different texts stay if one of them does; other
columns are kept up to the last stage, which returns the encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import decontaminate, near_dedup, prefix_bpe, toxicity
from foldwise.llm.common import broadcast_up_to, table, write_shared

BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (doc_id)."""
    gone = broadcast_up_to(write_shared(ids.select(F.col("doc_id").alias("gone")).distinct(), name), BROADCAST_IDS)
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5."""
    score = toxicity.toxicity_scorer(docs, table(spark, sf_dir, "labels"))
    return docs.where(score(F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates."""
    classes = near_dedup.near_duplicates(docs).where("doc_id IS NOT NULL")
    by_id = write_shared(classes.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("class_id")).cast("int")).alias("stays"), F.count("*").alias("n")), "kept")
    kept = without(docs, by_id.where("stays = 0"), "copies")
    repeated = by_id.where("stays = 1 AND n > 1")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated.select(F.col("doc_id").alias("again")), kept["doc_id"] == F.col("again"), "left_semi").dropDuplicates(["doc_id", "text"])
    return without(kept, repeated, "repeated").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even re-parameterised."""
    return without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")), "leaks")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, ids)."""
    import public_tokenizers

    return prefix_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated), ("encode", encode)]

#: SQL can't express the first two stages; tests/llm compares the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return docs
