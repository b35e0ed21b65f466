import numpy as np
import pytest

from lureline.llm import vptree


def by_hand(rows, every, k):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in {(i, tuple(v)): (i, v) for i, v in rows if i % every == 0}.values():
        near = sorted((np.sqrt(np.add.accumulate((v - a) ** 2)[-1]), i) for i, v in rows if i != q and len(v) == len(a))[:k]
        out += [(q, n + 1, i, round(float(d), 12)) for n, (d, i) in enumerate(near)]
    return sorted(out)


def found(df, **how):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in vptree.nearest(df, **how).collect())


def table(spark, rows):
    return spark.createDataFrame([(i, v, i, "s") for i, v in rows], "vec_id long, embedding array<float>, shard long, v string")


def test_exact_with_factor_one(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.integers(0, 4, 6).astype(float).tolist()) for i in range(900)]  # many ties
    assert found(table(spark, rows), every=20, k=10, shard_rows=200) == by_hand(rows, 20, 10)


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, []), (9, [3.0, 4.0]), (9, [3.0, 4.0]), (10, [2.0, 2.0]), (10, [2.0, 2.0]), (20, [5.0])]
    assert found(table(spark, rows), every=10, k=10) == by_hand(rows, 10, 10)
    assert vptree.nearest(table(spark, rows[2:3])).count() == 0
    assert vptree.nearest(table(spark, rows).limit(0)).count() == 0


def test_relaxed_pruning_looks_at_less(spark):
    draw = np.random.default_rng(4)
    v = draw.normal(size=(4, 4000))
    tree = vptree.Tree(v, np.arange(4000))
    seen, hits = {}, {}
    exact = [set(tree.search(v[:, q], 10, q)[0].tolist()) for q in range(0, 4000, 100)]
    for factor in (1.0, 1.5):
        tree.seen = 0
        got = [set(tree.search(v[:, q], 10, q, factor)[0].tolist()) for q in range(0, 4000, 100)]
        seen[factor], hits[factor] = tree.seen, np.mean([len(a & b) / 10 for a, b in zip(exact, got, strict=True)])
    assert seen[1.5] < seen[1.0] < 40 * 4000 / 2 and hits[1.0] == 1 and hits[1.5] >= 0.9


@pytest.mark.parametrize("factor", [1.0])
def test_given_vectors(spark, factor):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert found(df, factor=factor) == by_hand(rows, 100, 10)
