"""The queries of this package for `__spark_entry__.py`, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import mixing, topk


#: A key for tests; production passes its own.
PII_KEY = "quillgraph test key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.media import texts_as_media

    return texts_as_media(table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.tokenfile import tokenize_to_files

    return tokenize_to_files(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillgraph.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"), key=PII_KEY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_top_k": op2_top_k,
    "op3_urls": op3_urls,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_token_files": op6_token_files,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op2_top_k": topk.ORACLE,
    "op8_mixing": mixing.oracle(mixing.Mix()),
}
