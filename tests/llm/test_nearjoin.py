import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lureline.llm import nearjoin
from lureline.llm.components import components
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def by_hand(rows, width=3, percent=85):
    sets = [shingles(t, width) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    both = Counter((a, b) for own in where.values() for k, a in enumerate(own) for b in own[k + 1 :])
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[root(a)] = root(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = (min(least[root(i)]) if least[root(i)] else None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def found(df, **how):
    return sorted((tuple(r) for r in nearjoin.near_duplicates(df, **how).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_signature_pairs_within_the_distance_share_a_key():
    draw = np.random.default_rng(5)
    size = nearjoin.CHUNKS * nearjoin.SYMBOLS
    one = draw.integers(0, 1 << 16, (200, size)).astype("<u2")
    two = one.copy()
    for row in two:
        row[draw.choice(size, 2 * nearjoin.CHUNKS - 1, replace=False)] ^= 1
    a, b = nearjoin.chunk_keys(one), nearjoin.chunk_keys(two)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_edge_table(spark):
    assert found(edge.table(spark)) == by_hand(edge.texts())
    assert nearjoin.near_duplicates(edge.table(spark).limit(0)).count() == 0


@pytest.mark.parametrize("how", [{}, {"width": 5, "percent": 80}])
def test_given_documents(spark, how):
    rows = edge.documents("sf0.01")
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), **how)
    assert got == by_hand(rows, **how) and any(not r[3] for r in got)


def test_chain_of_near_copies(spark):
    words = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(60):  # each differs a little from the one before, the ends a lot
        words[3 * i] = f"new{i}"
        rows.append((i, " ".join(words)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)] + [(300, 300 + k) for k in range(1, 30)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[150] == 100 and got[310] == 300
