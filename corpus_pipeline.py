"""A training-data pipeline over ``documents``.

Stages, in order: drop texts without an identifiable language; keep one document of each
near-duplicate group; drop documents that hold benchmark passages; mix the sources to
their target weights; write token ids and read them back.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and
returns the columns of documents; the last returns the written documents' index.  ``run``
writes each stage's result as Parquet in the shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commerce_lake.llm import op1_decontamination, op4_language_id, op5_jaccard_join, op6_mixing, op9_token_output, shuffle

#: Near duplicates share 80 % of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null and letterless texts go."""
    model = op4_language_id.fit(docs)
    names = shuffle.fresh(docs, "lang_pred", "score")
    return op4_language_id.predict(docs, model, tuple(names)).where(F.col(names[0]) != "und").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id (null last), then the smallest hash of its text.

    Rows are told apart by a number of their own, so that rows of one doc_id (or none) with
    different texts are different documents, and repeated rows are copies."""
    (key,) = shuffle.fresh(docs, "row_key")
    rows = shuffle.cut(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    groups = op5_jaccard_join.jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"), SHINGLE, PERCENT).select(F.col("doc_id").alias(key), F.col("component_id").alias("group"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "hash", key)
    named = rows.select(key, "doc_id", F.xxhash64("text").alias("hash")).join(groups, key)
    keep = named.groupBy("group").agg(F.min(order).alias("first")).select(F.col(f"first.{key}").alias(key))
    return rows.join(keep, key, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return op1_decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks."""
    return op6_mixing.emit(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the token files."""
    path = shuffle.shared_dir(spark, "tokens")
    op9_token_output.write_tokens(docs, path)
    return op9_token_output.read_documents(spark, path)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shuffle.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
