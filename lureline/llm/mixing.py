"""Mixing sources to target weights, in SQL functions only.

A source's weight is its token share to the power alpha, normalised. Alpha is bisected, ten steps at a time in one job each, to the largest
value at which the weights' entropy still meets a target, but not below the smallest at which no source is repeated more than a limit
relative to the least repeated. The budget gives the least repeated source one whole pass. Each pass of a source is a permutation of
blocks of documents and of the documents in each block; the last, partial pass takes documents while they fit in what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lureline.llm.common import WORD, cut, packed, row_key

STEPS, PARTS = 1024, 64


def _draw(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def alpha(sources: DataFrame, entropy: float, repeats: float) -> float:
    """The exponent, to 1 / STEPS^2. sources: share, one row for each. Each job gives a few numbers for each of STEPS exponents."""

    def bounds(low: float, width: float) -> tuple[float, float]:
        """Of the exponents low + k * width: the smallest within the limit of repeats, the largest that meets the entropy."""
        tried = sources.select("share", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("k")).withColumn("a", F.lit(low) + F.col("k") * F.lit(width))
        p = F.pow("share", F.col("a"))
        sums = tried.groupBy("k", "a").agg(F.sum(p).alias("z"), F.sum(p * F.col("a") * F.log("share")).alias("e"), F.max(p / F.col("share")).alias("most"), F.min(p / F.col("share")).alias("least"), F.count(F.lit(1)).alias("n"))
        within = F.col("most") <= F.lit(repeats) * F.col("least") * F.lit(1 + 1e-12)
        meets = F.log("z") - F.col("e") / F.col("z") >= F.lit(entropy) * F.log("n") - F.lit(1e-12)
        got = sums.agg(F.min(F.when(within, F.col("a"))), F.max(F.when(meets, F.col("a")))).first()
        return (1.0 if got[0] is None else got[0]), (0.0 if got[1] is None else got[1])

    first, second = bounds(0.0, 1 / STEPS)
    fine = 1 / STEPS**2
    least = 0.0 if first <= 0 else bounds(first - 1 / STEPS, fine)[0]
    most = 1.0 if second >= 1 else bounds(second, fine)[1]
    return min(1.0, max(least, most))


def mix(docs: DataFrame, entropy: float = 0.97, repeats: float = 4.0, seed: int = 11, block_docs: int = 1024) -> DataFrame:
    """A row for each document and pass that takes it: key, doc_id, source, epoch, n_tokens, place (tokens of the pass before it), alpha, weight.

    Tokens are words. Null text is empty; a null source is the source `(none)`; documents without tokens weigh nothing and are in each
    whole pass; a source without tokens gets one pass. Repeated rows are documents of their own. Every document is in one pass at least.
    A hot source costs no hot task: sums before a document come from its block's, and a block holds about `block_docs` documents.
    An empty table gives no rows.
    """
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("(none)")).alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    rows = cut(rows)
    sizes = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    sizes = cut(sizes)
    total = sizes.agg(F.sum("tokens")).first()[0] or 1
    sizes = sizes.withColumn("share", F.col("tokens") / F.lit(total))
    live = sizes.filter("tokens > 0")
    a = alpha(live, entropy, repeats)
    powers = live.withColumn("p", F.pow("share", F.lit(a)))
    z, per = powers.agg(F.sum("p"), F.max(F.col("tokens") / F.col("p"))).first()
    quotas = powers.select("source", (F.col("p") / F.lit(z)).alias("weight"), F.round(F.col("p") * F.lit(per)).cast("long").alias("quota"))
    plan = sizes.join(quotas, "source", "left").select("source", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.ceil(F.col("n_docs") / block_docs).cast("long").alias("blocks"), F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(1).cast("long").alias("whole"), F.when(F.col("tokens") > 0, F.expr("quota % tokens")).otherwise(0).cast("long").alias("rest"))
    # Dealt by source and a part of it, so that a hot source is joined in many tasks.
    parts = plan.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    placed = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")).join(parts, ["source", "part"]).drop("part").withColumn("block", F.pmod(F.conv(F.substring(_draw(seed, F.coalesce(F.col("doc_id"), F.lit(-1))), 1, 8), 16, 10).cast("long"), F.col("blocks")))
    placed = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1))))
    of_blocks = placed.groupBy("source", "epoch", "block").agg(F.sum("n_tokens").alias("in_block"))
    order = Window.partitionBy("source", "epoch").orderBy("drawn", "block").rowsBetween(Window.unboundedPreceding, -1)
    of_blocks = of_blocks.withColumn("drawn", _draw(seed + 1, F.col("epoch"), F.col("source"), F.col("block"))).select("source", "epoch", "block", F.coalesce(F.sum("in_block").over(order), F.lit(0)).alias("before"))
    inner = Window.partitionBy("source", "epoch", "block").orderBy("drawn", "doc_id", "n_tokens", "key").rowsBetween(Window.unboundedPreceding, 0)
    within = placed.withColumn("drawn", _draw(seed + 2, F.col("epoch"), F.coalesce(F.col("doc_id"), F.lit(-1)))).withColumn("upto", F.sum("n_tokens").over(inner))
    out = within.join(of_blocks, ["source", "epoch", "block"]).withColumn("place", F.col("before") + F.col("upto") - F.col("n_tokens"))
    out = out.filter((F.col("epoch") < F.col("whole")) | (F.col("place") + F.col("n_tokens") <= F.col("rest")))
    return out.select("key", "doc_id", "source", "epoch", "n_tokens", "place", F.lit(a).alias("alpha"), "weight")


def mixed_documents(docs: DataFrame, entropy: float = 0.97, repeats: float = 4.0, seed: int = 11) -> DataFrame:
    """The documents' own columns, a row for each pass that takes the document. Repeated rows share their passes evenly, rounded down."""
    taken = mix(docs, entropy, repeats, seed).groupBy("key").agg(F.count(F.lit(1)).alias("passes"), F.sum((F.col("epoch") == 0).cast("long")).alias("same"))
    rows = docs.select(packed(docs).alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    each = taken.select("key", F.expr("passes div same").alias("each"))
    return rows.join(each, "key").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("each"))).alias("_")).select("row.*")
