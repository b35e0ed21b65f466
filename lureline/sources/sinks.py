"""Writing splits, the split index and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


def write_splits(records: DataFrame, path: str) -> DataFrame:
    """One folder per split. An unknown split is an error before anything is written; the write is committed as a whole."""
    bad = records.where(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).select("id", "split").take(1)
    if bad:
        raise ValueError(f"unsupported split {bad[0]['split']!r} in record {bad[0]['id']}")
    records.write.partitionBy("split").mode("overwrite").json(path)
    return split_counts(records)


def split_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("split").agg(F.count(F.lit(1)).alias("records"))


def split_index(records: DataFrame) -> DataFrame:
    return records.select("id", "split", "campaign_group_id", "variant_family_id")


def write_index(records: DataFrame, path: str) -> None:
    """A8."""
    split_index(records).write.mode("overwrite").option("header", True).csv(path)


def write_results(scores: DataFrame, path: str) -> None:
    """One JSON document per message."""
    scores.write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str) -> None:
    """A5: CSV with a header, every value quoted and a null apart from a blank, so that ``intake.table`` reads back what was written."""
    rows.write.mode("overwrite").options(header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"', nullValue="\\N", emptyValue="").csv(path)
