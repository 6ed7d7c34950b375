"""From raw documents to packed sequences: select, drop near-duplicates, cut repeats, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vespera.llm import ordinal, packing, simhash, suffixes
from vespera.llm.common import scratch_path, table
from vespera.llm.tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the highest grade is a half or more, by a classifier fitted on the labelled ones."""
    model = ordinal.train(docs, ordinal.graded(table(spark, sf_dir, "labels")), grades=3)
    return ordinal.select_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints of three-word shingles link at 2 or fewer differing bits."""
    return simhash.keep_one(docs, most=2, words_per_shingle=3)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that stand in an earlier one."""
    return suffixes.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, each in the corpus' proportions of sources."""
    return packing.pack(docs, tokenizer_path(), length=2048, end_id=1)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("pack", pack)]

#: No SQL expresses a fitted classifier or the other stages after it; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
