"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import embedding_dedup, html_text, importance, infill, packing, quality, token_files
from gridcast.llm.decontaminate import find_contamination
from gridcast.llm.licenses import scan_licenses
from gridcast.llm.ngram_join import near_duplicates
from gridcast.llm.pii import BASE_KINDS, detect
from gridcast.llm.substring_dedup import remove_repeats
from gridcast.llm.suffix_dedup import remove_passages
from gridcast.plans.storage import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(_table(spark, sf_dir, "documents").select("doc_id", "text"), masked=False)
    spans = F.col("pii_spans")
    return found.select(
        "doc_id",
        *[_count(spans, k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_spans_text(F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        _spans_text(spans).alias("spans"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_passages(_table(spark, sf_dir, "documents"), least_words=50)
    runs = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["start"], r["end"])), ",")
    return out.select("doc_id", "n_words", "n_removed", runs.alias("removed_words"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_text.fit(_table(spark, sf_dir, "documents"))
    out = html_text.extract_text(_table(spark, sf_dir, "pages"), model)
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.NEW)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    return out.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")



def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = importance.Resampling(low=1, high=1, buckets=10_000, least_words=20, percent=10, seed=2024)
    out = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), how)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = infill.Infill(seed=42, percent=50, spm_percent=80)
    out = infill.rearrange(_table(spark, sf_dir, "documents"), how, with_text=False)
    return out.withColumnRenamed("n_units", "n")



def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_documents(spark, path)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_html_text": op3_html_text,
    "op4_licenses": op4_licenses,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_ngram_join": op10_ngram_join,
    "op11_resampling": op11_resampling,
    "op12_infill": op12_infill,
    "op13_token_files": op13_token_files,
}
