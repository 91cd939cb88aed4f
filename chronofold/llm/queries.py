"""Queries of this subpackage's operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(table(spark, sf_dir, "documents"))
    return out.withColumn("probability", F.round("probability", 6)).withColumn("weight", F.round("weight", 6))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_runs import drop_later_copies

    out = drop_later_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multiset import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_products import top_products

    return top_products(table(spark, sf_dir, "embeddings"))


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiered_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_co_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .co_buckets import co_bucket

    return co_bucket(table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .mixing import mix_sql
    from .tiered_search import search_sql
    from .top_products import top_products_sql

    return {"op2_mixing": mix_sql(), "op11_top_products": top_products_sql(), "op12_tiered_search": search_sql()}
