"""Q: samples and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureline.functions.rows import lookup


def first_per_group(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """Q1: the first k rows per group. Spark keeps at most k rows of a group per task before the shuffle, so a large group is no burden."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("place") <= k)


QUOTAS = {"legitimate": 128, "awareness": 64, "ambiguous_ood": 64}


def evaluation_slice(records: DataFrame, per_leaf: int = 8, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """Q2, Q3: a fixed number per leaf and per label from the test split, named by slice."""
    slice_name = F.when(F.col("label") == "scam", F.concat(F.lit("leaf:"), "taxonomy_id")).otherwise(F.concat(F.lit("label:"), "label"))
    labels = list(quotas)
    at = F.nullif(F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")), F.lit(0)).cast("int") - 1
    quota = F.when(F.col("label") == "scam", per_leaf).otherwise(lookup(list(quotas.values()), at))
    test = records.where(F.col("split") == "test").withColumn("slice", slice_name).withColumn("quota", quota)
    top = first_per_group(test, "slice", "id", max(per_leaf, *quotas.values()))
    return top.where(F.col("place") <= F.col("quota"))


def allotments(df: DataFrame, group: str, quotas: DataFrame, total: int) -> DataFrame:
    """Q2: how many rows each slice gives: group, quota, rows, missing, allotted, a row for each slice of the quota table.

    A slice gives its quota or all it has. What is missing to ``total`` is taken from the slices with most rows to spare, ties by name, so
    the sum is ``total`` wherever the slices hold that many rows. ``quotas`` has (group, quota); the windows are over slices, not rows.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    q = quotas.select(group, F.col("quota").cast("long").alias("quota")).join(sizes, group, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    q = q.withColumn("taken", F.least("quota", "rows")).withColumn("spare", F.col("rows") - F.col("taken"))
    before = Window.orderBy(F.col("spare").desc(), group).rowsBetween(Window.unboundedPreceding, -1)
    lacking = F.greatest(F.lit(total) - F.sum("taken").over(Window.partitionBy()), F.lit(0))
    q = q.withColumn("extra", F.greatest(F.least(F.col("spare"), lacking - F.coalesce(F.sum("spare").over(before), F.lit(0))), F.lit(0)))
    return q.select(group, "quota", "rows", F.greatest(F.col("quota") - F.col("rows"), F.lit(0)).alias("missing"), (F.col("taken") + F.col("extra")).alias("allotted"))


def quota_sample(df: DataFrame, group: str, order: str, quotas: DataFrame, total: int) -> DataFrame:
    """Q2: the first rows of each slice, as many as ``allotments`` says. A slice is cut to ``total`` rows before it is shuffled."""
    given = allotments(df, group, quotas, total).select(group, "allotted")
    return first_per_group(df, group, order, total).join(given, group).where(F.col("place") <= F.col("allotted"))


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q4: a count per value of each column, in one pass over grouping sets."""
    g = df.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("rows"), *[F.grouping(c).alias(f"_g_{c}") for c in columns])
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        dimension = F.when(F.col(f"_g_{c}") == 0, c).otherwise(dimension)
        value = F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    return g.select(dimension.alias("dimension"), value.alias("value"), "rows")


def language_audit(records: DataFrame) -> DataFrame:
    """Q6."""
    other = F.col("language") != "en"
    cue = other & F.coalesce(F.contains("text", F.col("scenario_cue_en")), F.lit(False))
    return records.agg(F.count(F.when(other, 1)).alias("non_english"), F.count(F.when(other & (F.col("review_status") == "native_speaker_review_required"), 1)).alias("needing_review"), F.count(F.when(cue, 1)).alias("english_cue_left"))


def review_queue(df: DataFrame, group: str, key: str, minimum: int, exempt: tuple[str, ...] = ("en",)) -> DataFrame:
    """Q7: the records to review first per language, by a fixed hash order."""
    keyed = df.where(~F.col(group).isin(*exempt)).withColumn("o", F.sha2(F.col(key).cast("string"), 256))
    return first_per_group(keyed, group, "o", minimum).drop("o")
