"""Documents to training tokens: quality, language, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Rows whose text is null, empty or
without a word end at the first stage. Ids may be null or repeated and columns of docs may have any names; all but
the last stage return the columns of docs unchanged. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, langid, mixing, neardup, quality
from millrace.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled ones among docs.

    A probability equal to the limit is accepted, equal texts share their fate, texts without a word go.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages known from docs; letterless texts go, equal texts share their fate."""
    return langid.keep_identified(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id, nulls last; of equal rows one."""
    return neardup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture by target weights, up to the budget; ties by source, then by the shuffle's hash; a null source is ''."""
    return mixing.keep_mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; columns token_ids and n_tokens are replaced where docs have them."""
    return bpe.with_tokens(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express the trained and hashed stages; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
