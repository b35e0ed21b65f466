"""Near-duplicate documents: b-bit MinHash signatures, a multi-index Hamming join, links confirmed on full shingle sets.

A signature has CHUNKS * SYMBOLS values of 16 bits. By the pigeonhole principle, two signatures that differ in at most 2 * CHUNKS - 1
values have a chunk that differs in at most one. So each chunk is indexed once for each value left out: all pairs under that distance
share a key. Documents with equal sets are one class from the start; only classes are indexed.

Within a key, members are first compared with one of them, the largest set. For members of keys that this leaves apart, the shingles that
some other of them has are counted, in all and in GROUPS groups by hash: two members share at most the sum of the smaller counts, so pairs
that cannot be links need no comparison.
Then members are compared with the one that shares most of its set, then with another. At last, what is still apart meets on the
rarest shingles of each member: links share at least `percent` of a set, so they share one of its (100 - percent) percent rarest (and one
more), in one order for all. So a large group of near copies costs about as many comparisons as it has members, and no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lureline.llm.common import cut, packed, row_key
from lureline.llm.components import components
from lureline.llm.tokens import forgotten, released, runs
from lureline.llm.words import LOWER, mix64, shingle_sets

CHUNKS, SYMBOLS, GROUPS = 10, 5, 64
_A = mix64(np.arange(1, CHUNKS * SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix64(np.arange(1001, CHUNKS * SYMBOLS + 1001, dtype=np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each smallest hash. Long sets go by blocks, so memory stays bounded."""
    least = np.full(CHUNKS * SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(least, (_A[:, None] * shingles[None, i : i + 4096] + _B[:, None]).min(axis=1), out=least)
    return (mix64(least) >> np.uint64(48)).astype("<u2")


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(documents, CHUNKS * SYMBOLS): a key for each chunk with one value left out."""
    s = signatures.reshape(-1, CHUNKS, SYMBOLS).astype(np.uint64)
    out = np.empty((len(s), CHUNKS, SYMBOLS), np.uint64)
    for gap in range(SYMBOLS):
        rest = np.zeros((len(s), CHUNKS), np.uint64)
        for k in (k for k in range(SYMBOLS) if k != gap):
            rest = (rest << np.uint64(16)) | s[:, :, k]
        out[:, :, gap] = mix64(mix64(rest) + np.arange(CHUNKS, dtype=np.uint64)[None, :] * np.uint64(SYMBOLS) + np.uint64(gap))
    return out.reshape(len(s), -1).view(np.int64)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """rk (names the row), doc_id, n_shingles, node (names the set), sig of each document."""
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forgotten()
        for run in runs(parts):
            sets = shingle_sets([r[2].encode().translate(LOWER) for r in run], width)
            nodes = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in run], pa.binary()), pa.array([r[1] for r in run], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=["rk", "doc_id", "n_shingles", "node", "sig"])

    return rows.mapInArrow(sign, "rk binary, doc_id long, n_shingles long, node long, sig binary")


def keyed(classes: DataFrame) -> DataFrame:
    """node, n, key: a row for each key of each class."""

    def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                found = chunk_keys(np.frombuffer(b"".join(part["sig"].to_pylist()), "<u2"))
                for i in range(0, part.num_rows, 1000):
                    own = found[i : i + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part[c].to_numpy()[i : i + 1000], own.shape[1])) for c in ("node", "n")] + [pa.array(own.ravel())], names=["node", "n", "key"])
        released()

    return classes.select("node", "n", "sig").mapInArrow(keys, "node long, n long, key long")


def set_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, shingles of the wanted rows (rk, node)."""
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, "rk").select("node", "text")

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(parts):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in run], pa.int64()), pa.array([s.view(np.int64) for s in shingle_sets([r[1].encode().translate(LOWER) for r in run], width)], pa.list_(pa.int64()))], names=["node", "shingles"])

    # A repeated row gives its set twice; one is enough.
    return rows.mapInArrow(sets, "node long, shingles array<long>").dropDuplicates(["node"])


def similar(a: Column, b: Column, both: Column, percent: int) -> Column:
    return 100 * both >= percent * (a + b - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs a, b that are links, judged on the full sets."""
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    met = pairs.join(two, "b").join(one, "a")
    return met.filter(similar(F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb")), percent)).select("a", "b")


def shingles_of(members: DataFrame, sets: DataFrame) -> DataFrame:
    """node, shingle of the members."""
    return sets.join(members.select("node").distinct(), "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))


def shared_sizes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The members with s, how many of their shingles some other of these members has, and v, the same by GROUPS groups.

    The j-th entry of v has a bit for each group with j such shingles or more, so the smaller counts of two members add up to the bits that
    their entries have in common.
    """
    alone = shingles_of(members, sets).groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node")).filter("times = 1").groupBy("node").agg(F.collect_list("shingle").alias("alone"))
    own = sets.join(members.select("node").distinct(), "node", "left_semi").join(alone, "node", "left")
    left = own.select("node", F.array_except("shingles", F.coalesce("alone", F.array().cast("array<bigint>"))).alias("left"))
    counts = F.expr(f"transform(sequence(0, {GROUPS - 1}), k -> size(filter(transform(left, x -> pmod(x, {GROUPS})), x -> x = k)))")
    levels = F.expr(f"transform(if(array_max(c) > 0, sequence(1, array_max(c)), array()), j -> aggregate(sequence(0, {GROUPS - 1}), 0L, (bits, k) -> bits | if(c[k] >= j, shiftleft(1L, k), 0L)))")
    grouped = left.select("node", F.size("left").cast("long").alias("s"), counts.alias("c")).select("node", "s", levels.alias("v"))
    return members.drop("s", "v").join(cut(grouped), "node")


def rarest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, shingle: of each member's set the rarest shingles among these members, one more than a link may lack, without those no other has."""
    long = shingles_of(members, sets)
    often = cut(long.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
    met = long.join(often, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("own"))
    # Shingles without company come first in the order and take up places.
    sized = met.join(sets.select("node", F.size("shingles").alias("n")), "node")
    places = F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1 - (F.col("n") - F.size("own"))
    return sized.filter(places > 0).select("node", F.explode(F.slice("own", F.lit(1), places)).alias("r")).select("node", "r.shingle")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, rounds: int = 2) -> DataFrame:
    """rk, doc_id, n_shingles, component_id (smallest id reachable over links), kept (the id is the component's), lead (rk of the one to keep).

    Null or wordless texts have an empty set and no links. A null id is no component's smallest unless the component has no other id,
    then component_id is null and nothing of it is kept but rows with a null id. Repeated rows are in one component and kept alike.
    Other columns are not read. An empty table gives no rows. Sets and shingles are told apart by 64-bit hashes.
    """
    rows = cut(signed(docs, width))
    classes = cut(rows.filter("n_shingles > 0").groupBy("node").agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("least")))
    classes = classes.withColumn("rk", F.col("least.rk"))
    keys = keyed(classes)
    shared = cut(keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other")).filter("hub <> other").select("key"))
    members = cut(keys.join(shared, "key"))
    sets = cut(set_of(docs, classes.join(members.select("node").distinct(), "node", "left_semi").select("rk", "node"), width))
    plain = (F.col("a") != F.col("b")) & similar(F.col("na"), F.col("nb"), F.least("sa", "sb"), percent)
    both = F.aggregate(F.zip_with("va", "vb", lambda x, y: F.coalesce(F.bit_count(x.bitwiseAND(y)), F.lit(0))), F.lit(0), lambda x, y: x + y)
    sharp = plain & similar(F.col("na"), F.col("nb"), both, percent)  # the costlier bound for what the plain one lets through
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    labelled = members.withColumn("label", F.col("node")).withColumn("s", F.col("n")).withColumn("v", F.array().cast("array<bigint>"))  # see shared_sizes()
    side = [[F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}"), F.col("v").alias(f"v{c}"), F.col("label").alias(f"l{c}")] for c in "ab"]
    links, tested, labels = None, None, None
    for turn in range(rounds + 2):
        if turn <= rounds:  # one member of each key against the others
            order = [[-F.col("n")], [F.col("n") - F.col("s"), -F.col("n")]][turn] if turn < 2 else []
            hubs = cut(labelled.groupBy("key").agg(F.min_by(F.struct(*side[0]), F.struct(*order, F.xxhash64(F.col("node"), F.lit(turn)))).alias("h")).select("key", "h.*"))
            pairs = hubs.join(labelled.select("key", *side[1]), "key").filter("la <> lb")
        else:  # whatever is still apart
            rare = cut(labelled.select("node", "n", "s", "v", "label").distinct().join(rarest(labelled, sets, percent), "node"))
            pairs = rare.select("shingle", *side[0]).join(rare.select("shingle", *side[1]), "shingle").filter("la < lb")
        pairs = pairs.filter(sharp if turn else plain).select(*pair).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            found = cut(confirmed(pairs, sets, percent))
            links = found if links is None else links.union(found)
            tested = pairs if tested is None else tested.union(pairs)
            labels = components(links)
            named = labelled.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            # Keys whose members are all connected have nothing left to compare.
            apart = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
            labelled = cut(named.join(cut(apart), "key", "left_semi"))
        if turn == 0:
            labelled = cut(shared_sizes(labelled, sets))
        if labelled.isEmpty():
            break
    if labels is None:
        of = classes.select("node", F.col("least").alias("lead"))
    else:
        named = classes.select("node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        of = named.join(named.groupBy("label").agg(F.min("least").alias("lead")), "label").select("node", "lead")
    whole = rows.join(of, "node", "left")
    linked = F.col("n_shingles") > 0
    out = whole.select("rk", "doc_id", "n_shingles", F.when(linked, F.col("lead.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, F.col("lead.rk")).otherwise(F.col("rk")).alias("lead"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents' own columns, one document of each component: that with the smallest id (a null id only if there is no other)."""
    kept = near_duplicates(docs, width, percent).filter("rk = lead").select("rk").distinct()
    rows = docs.select(packed(docs).alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("rk"))
    return rows.join(kept, "rk", "left_semi").dropDuplicates(["rk"]).select("row.*")
