"""The operators as queries with production parameters: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline.llm import aligning, bestfit, fim, langfamily, licences, mixing, nearjoin, packing, perplexity, planes, repeats, shards, vptree
from lureline.llm.common import shared_folder

#: The tokenizer file; another may be given to the operators.
TOKENIZER = "byte_bpe_50k.json"
#: The other side of the alignment.
PIECE_TOKENIZER = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


@query
def op1_temperature_mixing(spark, d):
    return mixing.mix(documents(spark, d)).select("doc_id", "source", "epoch", "n_tokens", "place", "alpha", "weight")


@query
def op2_run_index(spark, d):
    out = repeats.without_repeats(documents(spark, d), carry=["doc_id"])
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_packing(spark, d):
    return packing.pack(documents(spark, d), tokenizer_path()).drop("ids")


@query
def op4_minhash(spark, d):
    return nearjoin.near_duplicates(documents(spark, d)).drop("rk", "lead")


@query
def op5_perplexity(spark, d):
    return perplexity.judged(documents(spark, d)).drop("rk", "n_scored")


@query
def op6_language_family(spark, d):
    return langfamily.languages(documents(spark, d))


@query
def op7_licence_index(spark, d):
    return licences.licences(documents(spark, d))


@query
def op8_sharding(spark, d):
    return shards.shard(documents(spark, d)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op9_vantage_points(spark, d):
    return vptree.nearest(spark.read.parquet(f"{d}/embeddings.parquet"))


@query
def op10_bit_planes(spark, d):
    folder = shared_folder(spark)
    planes.write_ids(documents(spark, d), folder, tokenizer_path())
    return planes.read_ids(spark, folder).drop("ids")


@query
def op11_best_fit(spark, d):
    return bestfit.pack(documents(spark, d), tokenizer_path()).drop("ids")


@query
def op13_fill_in_middle(spark, d):
    out = fim.transform(documents(spark, d))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query
def op12_interval_coalescing(spark, d):
    return aligning.align(documents(spark, d), tokenizer_path(), tokenizer_path(PIECE_TOKENIZER)).drop("groups")
