"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing. Each stage works on all that the one before kept.

Every stage but the last returns the columns of documents; the last returns pieces of token ids with their sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lureline.llm import mixing, nearjoin, packing, perplexity, repeats
from lureline.llm.common import cut
from lureline.llm.queries import documents, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose perplexity is outside their language's band, go. Null and empty texts fail the base
    rules; repeated rows are judged alike and all stay or go."""
    return perplexity.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity of 0.8 or more): that with the smallest id, one row of
    repeated rows. Null and wordless texts are linked with nothing and stay."""
    return nearjoin.distinct_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that also start elsewhere go; the documents stay, with an empty text if nothing is left. A null text stays null."""
    return repeats.trimmed_documents(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated towards the target weights; every document is there once at least. A null source is a source; null and
    empty texts have no tokens and are there once."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids (where they start, how long they are, their crc32, the ids), with sequence and offset. Null and
    empty texts give the end id alone; repeated rows give repeated pieces."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mixing", mixed_sources), ("packing", packed_sequences)]
#: Perplexity, signatures and token ids have no SQL form; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
