"""Packing when rows repeat, tie and crowd one group."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lureline.llm import packing, queries
from tests.llm import edge

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(rows, texts, capacity=1024):
    of = Tokenizer.from_file(PATH)
    want, own, bins = Counter(), Counter(), defaultdict(list)
    for d, t in texts:
        ids = [*of.encode(t or "", add_special_tokens=False).ids, 0]
        want.update((d, a, zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for a in range(0, len(ids), capacity))
    for r in rows:
        own[r.doc_id, r.start, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert own == want
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    return bins


def test_a_row_repeated_for_a_third_of_the_table_is_spread(spark):
    texts = [(1, "the same row every time")] * 600 + [(i, f"row {i} with words of its own " * (i % 9)) for i in range(2, 1202)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    groups = packing.pieces(df, PATH, group_docs=100).groupBy("grp").count().collect()
    assert len(groups) == 18 and max(r["count"] for r in groups) < 250
    whole(packing.pack(df, PATH, group_docs=100).collect(), texts)


def test_ties_of_length_are_packed_alike_in_any_order(spark):
    texts = [(i % 40, "five words of one size") for i in range(400)] + [(None, "five words of one size")] * 3
    one, two = (spark.createDataFrame(rows, "doc_id long, text string").coalesce(1) for rows in (texts, texts[::-1]))
    a, b = (packing.pack(df, PATH, length=64) for df in (one, two))
    whole(a.collect(), texts, 64)
    assert sorted(map(str, a.drop("ids").collect())) == sorted(map(str, b.drop("ids").collect()))


def test_ids_go_with_their_pieces(spark):
    for r in packing.pack(edge.table(spark), PATH).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_query_on_given_documents(spark):
    rows = queries.QUERIES["op3_packing"](spark, "/root/testdata/sf0.001").collect()
    whole(rows, edge.documents())
