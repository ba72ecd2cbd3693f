"""Documents to training sequences: five stages over the whole table.

Each stage takes all rows that the one before kept and returns the columns of
``documents`` (the last one: pieces of sequences).  Rows with null texts or ids,
repeated rows and further columns pass through as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm import decontam, gray_simhash, packing, pii, quality
from civicflow.llm.common import documents, materialise
from civicflow.session import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier (fitted on the rated ones) does not reject."""
    model = quality.fit_quality(docs, quality.rated(table(spark, sf_dir, "labels")))
    rows = docs.select(F.struct("*").alias("row"))  # the text goes to Python once, inside its row
    return quality.score_quality(rows, model, "row.text").where(quality.keep(text="row.text")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates (3-word shingles, 2 bits)."""
    return gray_simhash.keep_one(docs)


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    return decontam.remove_overlapping(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers replaced by their kind and ``n_chars`` counted anew."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all documents, with their ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_overlaps),
    ("PII", mask_personal_data),
    ("packing", pack),
]

#: Trained weights, fingerprint graphs and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again.

    What is written stays in the shared folder until the caller, done with the
    result, calls :func:`civicflow.llm.common.release_scratch`.
    """
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
