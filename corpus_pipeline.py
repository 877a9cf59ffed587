"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and
returns a DataFrame. Its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcast.llm.decontaminate import find_contamination
from gridcast.llm.frames import KEY, row_key
from gridcast.llm.ngram_join import near_duplicates
from gridcast.llm.packing import pack
from gridcast.llm.pii import detect
from gridcast.llm.quality import score_quality
from gridcast.plans.storage import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text is judged as an empty one; equal rows stay or go together; without labels of both
    kinds among the documents all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs.select(*COLUMNS), labels)
    return scored.where("quality_keep").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id; of repeated rows, one.

    Copies share 0.8 of their runs of five words. Documents without words link with
    nothing and stay.
    """
    linked = near_duplicates(docs, size=5, percent=80)
    first = linked.where("is_first").select(*KEY, (F.col("n_shingles") == 0).alias("blank")).distinct()
    rows = docs.select(*COLUMNS, *row_key(F.col("doc_id"), F.col("text"))).join(first, list(KEY))
    w = Window.partitionBy(*KEY).orderBy("lang", "source", "n_chars")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1 OR blank").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    A null or blank text holds none and stays; repeated rows stay or go together.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs.select(*COLUMNS), benchmark)
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and the number of characters counted anew.

    Every row stays; a null text stays null, with a null number.
    """
    masked = detect(docs.select(*COLUMNS))
    text = F.col("pii_masked")
    return masked.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into training sequences.

    A null or blank text is its end token alone; repeated rows are packed each.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicate", near_duplicate),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: SQL cannot express the classifier; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to packed sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
