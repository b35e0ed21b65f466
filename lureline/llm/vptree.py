"""Nearest neighbours with a vantage-point tree for each shard of the vectors.

Vectors are dealt to shards of about `shard_rows` by a hash. A task reads a shard's vectors, builds its tree, and then streams the queries
through it; only each shard's best few go on, and the best of all shards are kept. A node holds a vantage point and the ranges of distance of its
two halves from it; a half is skipped where the triangle inequality, relaxed by `factor`, rules it out. With factor 1 nothing near is ever
skipped and the search is exact; a larger factor skips more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureline.llm.common import cut


def distances(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision. vectors: (dimensions, n), so squares are summed one dimension after the other."""
    d = vectors - q[:, None]
    return np.sqrt(np.add.reduce(d * d, axis=0))


class Tree:
    """A vantage-point tree over the columns of vectors; ids break ties."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = 64, seed: int = 3) -> None:
        self.vectors, self.ids = vectors, ids
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []
        self.leaf = leaf
        draw = np.random.default_rng(seed)
        work = [(0, len(ids), -1, 0)]
        while work:
            a, b, parent, side = work.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][2 + side] = me
            if b - a <= leaf:
                self.nodes.append([a, b, -1, -1, None, None])
                continue
            pick = a + int(draw.integers(b - a))
            point = self.order[pick]
            d = distances(self.vectors[:, self.order[a:b]], self.vectors[:, point])
            by = np.argsort(d, kind="stable")
            self.order[a:b] = self.order[a:b][by]
            d, mid = d[by], (b - a) // 2
            self.nodes.append([int(point), None, -1, -1, (d[0], d[mid - 1]), (d[mid], d[-1])])
            work += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        # Leaves side by side: a leaf is one block of columns.
        self.vectors = np.ascontiguousarray(self.vectors[:, self.order])
        self.ids = self.ids[self.order]
        self.place = np.empty(len(ids), np.int64)
        self.place[self.order] = np.arange(len(ids))
        self.seen = 0

    def search(self, q: np.ndarray, k: int, own: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest but `own`, nearest first, ties to the smaller id."""
        best_d, best_i = np.empty(0), np.empty(0, np.int64)
        far = np.inf
        work = [(0.0, 0)] if self.nodes else []
        while work:
            least, me = work.pop()
            if least > far:
                continue
            a, b, left, right, near, wide = self.nodes[me]
            if left < 0:
                self.seen += b - a
                d = distances(self.vectors[:, a:b], q)
                keep = (d <= far) & (self.ids[a:b] != own)
                if keep.any():
                    best_d = np.concatenate([best_d, d[keep]])
                    best_i = np.concatenate([best_i, self.ids[a:b][keep]])
                    by = np.lexsort((best_i, best_d))[:k]
                    best_d, best_i = best_d[by], best_i[by]
                    if len(by) == k:
                        far = best_d[-1]
                continue
            at = self.place[a]
            d = float(distances(self.vectors[:, at : at + 1], q)[0])
            # Distance of a half's range from d; a little is given back for rounding.
            gaps = [(max(lo - d, d - hi, 0.0) * factor * (1 - 1e-12), child) for (lo, hi), child in ((near, left), (wide, right))]
            gaps.sort(reverse=True)
            work += [g for g in gaps if g[0] <= far]
        return best_i, best_d


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles), dim of the vectors that take part: no nulls, zeros only, or non-finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(fine & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0, shard_rows: int = 16_384, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every` its k nearest others.

    Vectors without an id, null, zero, or with null or non-finite components take no part; a query meets vectors of its own number of
    dimensions only. Repeated rows: each is a candidate, except for a query of the same id; of several query rows with one id the smallest
    vector is taken. Fewer candidates than k: all of them. No rows in, no rows out. Only vec_id and embedding are read.
    """
    rows = cut(usable(vectors))
    shards = max(1, -(-rows.count() // shard_rows))
    # A hash of the place as well, so that rows with one id (or one vector) spread too.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(shards)).cast("int"))
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    spread = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = dealt.withColumn("query", F.lit(False)).unionByName(spread.withColumn("query", F.lit(True)))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at, ids, cols = None, None, [], []
        for part in parts:
            out: list[tuple] = []
            for dim, shard, query, vec_id, v in zip(*(part[c].to_pylist() for c in ("dim", "shard", "query", "vec_id")), part["v"], strict=True):
                if (dim, shard) != at:  # a new shard: its vectors come before its queries
                    tree, at, ids, cols = None, (dim, shard), [], []
                own = v.values.to_numpy()
                if not query:
                    ids.append(vec_id)
                    cols.append(own)
                    continue
                if tree is None:
                    tree = Tree(np.array(cols).T if cols else np.zeros((dim, 0)), np.array(ids, np.int64))
                    ids, cols = [], []
                found, score = tree.search(own, k, vec_id, factor)
                out += [(vec_id, int(i), float(s)) for i, s in zip(found, score, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    met = both.repartition(F.col("dim"), F.col("shard")).sortWithinPartitions("dim", "shard", "query")
    found = met.select("dim", "shard", "query", "vec_id", "v").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
