"""Sharding by a two-pass external shuffle, in SQL functions only.

Pass one scatters the records by seeded hashes into buckets that fit in memory and writes them. Pass two reads bucket by bucket, puts each
into random order (Spark's shuffle() is a Fisher-Yates shuffle of an array) and numbers the records of each shard without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lureline.llm.common import cut, packed


def weights(doc_id: Column, shards: int, seed: int) -> Column:
    """For each shard 0 .. shards - 1 a hash of the id and the shard: the largest wins, so one more shard takes rows only into itself."""
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.struct(F.xxhash64(F.lit(seed), doc_id, k).alias("h"), k.alias("k")))


def scatter(docs: DataFrame, shards: int = 24, seed: int = 29, bucket_bytes: int = 16_000_000, payload: bool = True) -> DataFrame:
    """Pass one: size, text_crc32, shard, grown_shard and bucket of each record, and with payload its columns as `row`; written.

    The law is `key`: the id and the number of shards decide the shard (null is an id like others). Within a shard the hash of id and
    text picks the bucket; the number of buckets follows from the bytes, so each fits in memory.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    rows = docs.select(packed(docs).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    drawn = rows.withColumn("w", weights(F.col("doc_id"), shards + 1, seed)).withColumn("old", F.array_max(F.slice("w", 1, shards))).withColumn("new", F.array_max("w"))
    drawn = drawn.select(*(["row"] if payload else []), "doc_id", "size", "text_crc32", F.col("old.k").alias("shard"), F.col("new.k").alias("grown_shard"), F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int").alias("bucket"))
    return cut(drawn)


def shard(docs: DataFrame, shards: int = 24, seed: int = 29, bucket_bytes: int = 16_000_000, payload: bool = True) -> DataFrame:
    """Both passes: each record with its law, shard, slot (gapless from 0 in its shard) and grown_shard (with one more shard).

    Null text: empty. Repeated rows are records of their own. The records' columns stay inside `row`, so names can't clash. No rows in,
    no rows out. Copies of one text spread over shards by their ids.
    """
    rows = scatter(docs, shards, seed, bucket_bytes, payload)
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    record = ["text_crc32", "doc_id", "size", "grown_shard", *(["row"] if payload else [])]
    # Sorted first, so that the order in which records arrive doesn't matter.
    mixed = rows.groupBy("shard", "bucket").agg(F.shuffle(F.sort_array(F.collect_list(F.struct(*record))), F.lit(seed)).alias("records"))
    out = mixed.join(sizes, ["shard", "bucket"]).select("shard", "base", F.posexplode("records").alias("at", "r"))
    return out.select("r.doc_id", "r.size", "r.text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("at")).alias("slot"), "r.grown_shard", *(["r.row"] if payload else []))


def write_shards(docs: DataFrame, folder: str, shards: int = 24, seed: int = 29, bucket_bytes: int = 16_000_000) -> None:
    """Write the records of each shard below folder/shard=N, with their slots."""
    shard(docs, shards, seed, bucket_bytes).select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).write.partitionBy("_shard").parquet(folder)
