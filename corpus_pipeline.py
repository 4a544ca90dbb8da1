"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

STAGES holds (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import fm, queries, simhash, surrogates, tiling
from lodestone.llm.text import held_out
from lodestone.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels outside the held-out fold."""
    labels = queries.table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    return fm.score(docs, fm.fit(docs, labels, "quality"), score_column="_quality").where("_quality >= 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return tiling.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; the number of characters follows the text."""
    replaced = surrogates.pseudonymise(docs, surrogates.session_key(spark), mentions_column="_mentions").drop("_mentions")
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else replaced


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences; one row per piece, with its ids."""
    return queries.pack_documents(docs)


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal data", personal_data), ("packing", packing)]

# Classifier, fingerprints and tokens have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the intermediate tables go to the folder in spark.checkpoint.dir."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = queries.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
