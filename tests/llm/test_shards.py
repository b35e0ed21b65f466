import zlib
from collections import defaultdict

from lureline.llm import shards
from lureline.llm.common import shared_folder
from tests.llm import edge


def check(rows, texts):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_given_documents(spark):
    texts = edge.documents("sf0.01")
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = shards.shard(df, bucket_bytes=20_000).collect()
    check(rows, texts)
    moved = sum(r.grown_shard == 24 for r in rows)
    assert 10 < moved < 90
    one_more = {r.doc_id: r.shard for r in shards.shard(df, shards=25).collect()}
    assert one_more == {r.doc_id: r.grown_shard for r in rows}
    # Within a shard the order has little to do with the ids.
    own = [r.doc_id for r in sorted((r for r in rows if r.shard == 0), key=lambda r: r.slot)]
    rising = sum(a < b for a, b in zip(own, own[1:], strict=False))
    assert 0.25 < rising / (len(own) - 1) < 0.75


def test_edge_table(spark):
    df = edge.table(spark)
    check(shards.shard(df).collect(), edge.texts())
    assert shards.shard(df).select("row.*").columns == df.columns
    assert shards.shard(df.limit(0)).count() == 0


def test_written_shards(spark):
    df, folder = edge.table(spark), shared_folder(spark)
    shards.write_shards(df, folder, shards=4)
    back = spark.read.parquet(folder)
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    placed = {(str(r.doc_id), r.size): (r.shard, r.slot) for r in shards.shard(df.filter("doc_id < 9 AND doc_id <> 4"), shards=4).collect()}
    assert len(placed) == df.filter("doc_id < 9 AND doc_id <> 4").count()
