"""A corpus pipeline over ``documents``: toxic documents out, one of each near-duplicate group, benchmark leaks out, secrets masked, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again as the next stage's documents, so each stage starts from files and a lost executor repeats tasks of one stage.
Rows without a doc_id, and rows that share one, are documents like any other: a stage decides on each by its text. Helper
columns get names that the documents don't have, so columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import decontaminate, ngram_join, packing, secret_scan, toxicity
from sessionloom.llm.common import fresh, hot_join, stored, word_vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = fresh(docs, "toxicity")
    return toxicity.score_texts(docs, toxicity.learned(spark, sf_dir), score).filter(F.col(score) < 0.5).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group, one without an id where all are so.

    Rows are numbered in a written copy, so that they can be told apart whatever their doc_id.
    """
    row = fresh(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    groups = ngram_join.near_groups(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    named = stored(groups.join(rows.select(F.col(row).alias("row"), "doc_id"), "row"), "pipeline-groups")
    first = named.groupBy("group").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    dropped = hot_join(named, stored(first, "pipeline-first"), ["group"], "n", ["row"]).filter("row <> first").select(F.col("row").alias(row))
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal texts are one document to the search, known by a hash."""
    key = fresh(docs, "key")
    by_text = F.when(F.length("text") > 0, F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    keyed = docs.withColumn(key, by_text)
    found = decontaminate.contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(stored(packing.pieces(docs, word_vocabulary()), "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]
#: A learnt model and tokenisation are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
