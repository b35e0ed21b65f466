import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lureline.llm import bestfit, queries
from tests.llm import edge

PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(sizes, capacity):
    """Best-fit decreasing, each item looked up in all bins: the rooms left."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return Counter(rooms)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_runs_are_best_fit_decreasing(case):
    capacity, sizes = case
    counts = Counter(sizes)
    bins, placed = defaultdict(list), Counter()
    for length, at, n, first, each, offset in bestfit.best_fit(counts, capacity):
        assert at == placed[length]
        placed[length] += n
        for k in range(n):
            bins[first + k // each].append((offset + k % each * length, length))
    assert placed == counts
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter(capacity - sum(n for _, n in held) for held in bins.values()) == one_by_one(sizes, capacity)


def test_many_copies_of_a_length_are_few_runs():
    draw = np.random.default_rng(5)
    counts = {k: int(n) for k, n in enumerate(draw.integers(1, 10**9, 1024), 1)}
    runs = bestfit.best_fit(counts, 1024)
    assert sum(r[2] for r in runs) == sum(counts.values()) and len(runs) < 200_000


@pytest.fixture(scope="module")
def plain():
    of = Tokenizer.from_file(PATH)
    return lambda t: [*of.encode(t or "", add_special_tokens=False).ids, 2]


def check(rows, texts, plain, length=1024):
    own, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    want, sizes = defaultdict(list), []
    for d, t in texts:
        ids = plain(t)
        first = len(ids) % length or length
        edges = [0, *range(first, len(ids), length), len(ids)] if len(ids) > length else [0, len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[d].append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            sizes.append(b - a)
    assert {d: sorted(x) for d, x in own.items()} == {d: sorted(x) for d, x in want.items()}
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= length
    assert Counter(length - sum(n for _, n in h) for h in bins.values()) == one_by_one(sizes, length)


def test_edge_table(spark, plain):
    df = edge.table(spark)
    rows = bestfit.pack(df, PATH).collect()
    check(rows, edge.texts(), plain)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert bestfit.pack(df.limit(0), PATH).count() == 0


def test_repeated_rows_and_many_tasks(spark, plain):
    texts = [(1, "the same row")] * 700 + [(i, "word " * (i * 37 % 900)) for i in range(2, 300)] + [(None, "")] * 5
    check(bestfit.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), PATH, length=256).collect(), texts, plain, 256)


def test_query_on_given_documents(spark, plain):
    rows = queries.QUERIES["op11_best_fit"](spark, "/root/testdata/sf0.001").collect()
    check(rows, edge.documents(), plain)
    tokens = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-tokens // 1024) + 1
