import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lureline.llm import packing, planes, tokens
from lureline.llm.common import shared_folder
from tests.llm import edge

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    of = Tokenizer.from_file(PATH)
    return lambda t: of.encode(t or "", add_special_tokens=False).ids


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_pieces_give_the_ids_of_the_whole_text(plain, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 500)  # both generations are used
    texts = [t or "" for _, t in edge.texts()] + [t or "" for _, t in edge.documents()] + ["a  b", " a", "a ", "  ", "x \n y", "n b c d e", "don't we'll I've", "a" * 200 + " b", "1 2 33 4a5 !? .", "\U0001f600 \U0001f600 ok", "tab\t x\t y"]
    of = tokens.Encoder(PATH)
    for _ in range(2):
        for i in range(0, len(texts), 20):
            assert [ids(r) for r in of.encode(texts[i : i + 20])] == [plain(t) for t in texts[i : i + 20]]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, of = Tokenizer.from_file(path), tokens.Encoder(path)
    assert [ids(r) for r in of.encode(["Some  TEXT here", ""])] == [own.encode(t, add_special_tokens=False).ids for t in ("Some  TEXT here", "")]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    draw = np.random.default_rng(3)
    for n in (1, 7, 8, 1000, 5000):
        held = draw.integers(0, 1 << 32, n).astype("<u4")
        chunks, data = planes.encode_blocks(held, 1024, kind, 3)
        assert np.concatenate([planes.decode_block(c, data, kind) for c in chunks]).tolist() == held.tolist()
        assert planes.decode_block(chunks[-1], data, kind).tolist() == held[chunks[-1]["first"] :].tolist()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_ids_written_and_read(spark, plain, kind):
    df, folder = edge.table(spark), shared_folder(spark)
    planes.write_ids(df, folder, PATH, block=500, segment=3000, planes=kind)
    got = planes.read_ids(spark, folder).orderBy("start").collect()
    want = sorted(((d, [*plain(t), 2]) for d, t in edge.texts()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(ids(r.ids)) and r.ids_crc32 == zlib.crc32(r.ids)
        start += r.n_tokens
    assert sorted((str(r.doc_id), ids(r.ids)) for r in got) == sorted((str(d), k) for d, k in want)
    empty = shared_folder(spark)
    planes.write_ids(df.limit(0), empty, PATH)
    assert planes.read_ids(spark, empty).count() == 0


def test_first_fit_against_a_plain_search():
    draw = np.random.default_rng(9)
    for n in (0, 1, 5, 300):
        sizes = sorted(draw.integers(1, 1025, n).tolist(), reverse=True)
        room, want = [], []
        for s in sizes:
            k = next((i for i, r in enumerate(room) if r >= s), len(room))
            room += [1024] * (k == len(room))
            room[k] -= s
            want.append(k)
        assert packing.first_fit(sizes, 1024) == want


@pytest.mark.parametrize("group", [4, 16_384])
def test_every_id_in_one_piece(spark, plain, group):
    df = edge.table(spark)
    rows = packing.pack(df, PATH, group_docs=group).collect()
    own, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(ids(r.ids)) and r.ids_crc32 == zlib.crc32(r.ids)
        own[r.doc_id].append((r.start, r.doc_tokens, ids(r.ids)))
        bins[r.sequence_id].append(r)
    want = defaultdict(list)
    for d, t in edge.texts():
        k = [*plain(t), 0]
        want[d] += [(a, len(k), k[a : a + 1024]) for a in range(0, len(k), 1024)]
    assert {d: sorted(x) for d, x in own.items()} == {d: sorted(x) for d, x in want.items()}
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and {r.padded_length for r in held} == {at if at & (at - 1) == 0 else 1024}
    without = packing.pack(df, PATH, group_docs=group, with_ids=False).drop("ids")
    assert sorted(map(str, without.collect())) == sorted(map(str, packing.pack(df, PATH, group_docs=group).drop("ids").collect()))
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_little_padding(spark):
    df = spark.createDataFrame(edge.documents("sf0.01"), "doc_id long, text string")
    rows = packing.pack(df, PATH, with_ids=False)
    filled, room = rows.selectExpr("sum(length)", "count(distinct sequence_id) * 1024").first()
    assert filled / room > 0.99
