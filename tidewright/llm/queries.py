"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .counts import token_counts
from .language import document_languages, page_languages
from .leaks import leak_pairs
from .lines import SQL as LINES_SQL
from .lines import line_digests
from .mixing import SQL as MIX_SQL
from .mixing import mix_sizes
from .nearest import nearest
from .repeats import SQL as REPEATS_SQL
from .repeats import repeat_digests
from .secrets import SQL as SECRETS_SQL
from .secrets import secret_digests
from .simhash import simhash_components
from .store import token_store


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, table.where("vec_id % 50 = 0"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(_documents(spark, sf_dir))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(_documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(_documents(spark, sf_dir))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op7 on web pages, which also have addresses and markup."""
    return page_languages(spark.read.parquet(f"{sf_dir}/pages.parquet"), _documents(spark, sf_dir))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_pairs(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), lower=True)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_counts": op5_token_counts,
    "op6_secret_spans": op6_secret_spans,
    "op7_language_id": op7_language_id,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op9_token_store": op9_token_store,
    "op10_repeats": op10_repeats,
    "pages_language_id": pages_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": LINES_SQL,
    "op4_mix_sources": MIX_SQL,
    "op6_secret_spans": SECRETS_SQL,
    "op10_repeats": REPEATS_SQL,
}
