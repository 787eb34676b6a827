"""From raw documents to token ids: each stage reads what the one before kept.

All stages take any columns beside doc_id, text, lang and source, and all but the last return them
as they came; an empty table passes all of them and gives an empty result. What nulls, empty texts,
ties and repeated rows become is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.common import settle
from tidewright.llm.language import in_known_language
from tidewright.llm.leaks import without_leaks
from tidewright.llm.mixing import mix
from tidewright.llm.shingles import without_near_duplicates
from tidewright.llm.store import token_store


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus knows, or declared to be in one too rare to tell, stay.

    Null, empty and letterless texts go; a null lang or source is no evidence; equal rows stay or go
    together, and rows with one doc_id are judged one by one.
    """
    return in_known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, 0.8 or more of them in common.

    The covering tables of SimHash propose pairs, bands those that lie beyond their radius, and all
    are compared exactly. The smallest doc_id of a group stays, a null one only where there is no
    other, and of rows with that id and text one. Texts without words, null ones too, are one group.
    """
    return without_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts hold none; equal rows stay or go together; an empty benchmark removes nothing.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, twice at most.

    A null source is one of its own; empty texts, null ones too, have no words and add none. Places
    in the order follow from doc_id (null: from the text), so equal rows get equally many copies.
    """
    return mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the token store.

    In ascending doc_id order, null last; repeated rows are documents of their own, and a null or
    empty text is one of its end id alone. Workers hold fewer words than by default, as they have
    served the other stages before.
    """
    return token_store(docs, public_tokenizers.path("word_bpe_49k.json"), lower=True, words=150_000, at_once=1_500_000)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]

#: SQL has neither the hashes nor the tokenizers of the stages; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
