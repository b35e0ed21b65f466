import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lureline.llm import aligning, queries
from tests.llm import edge

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sides():
    """Token lists (id, bytes) of a text on both sides, by the libraries alone."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    table = aligning.byte_level()
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def of(text):
        x = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = []
        for i in b.encode([text], num_threads=1)[0]:
            p = b.id_to_piece(i)
            y.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == raw == b"".join(t for _, t in y) else ([], [])

    return of


def by_hand(rows):
    of, out, total = sides(), [], Counter()
    for d, text in rows:
        x, y = of(text) if text else ([], [])
        ends, spans = [], []
        for own in (x, y):
            at, placed = 0, []
            for i, raw in own:
                placed.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(placed)
            ends.append({e for _, _, e in placed})
        links = [(i, j) for i, a, b in spans[0] for j, c, e in _near(spans[1], a, b) if a < e and c < b]
        total.update(links)
        groups, start = [], 0
        for stop in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(i) for i, a, _ in side if start <= a < stop) for side in (_cut(spans[0], start, stop), _cut(spans[1], start, stop))))
            start = stop
        out.append((d, len(x), len(y), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, j), n in total.items():
        best[j] = max(best[j], n)
    return [(d, a, b, g, len(links), sum(total[p] == best[p[1]] for p in links), sum(total[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else "") for d, a, b, g, links, text in out], total


def _near(spans, a, b):
    import bisect

    starts = [s for _, s, _ in spans]
    return spans[max(0, bisect.bisect_left(starts, a) - 1) : bisect.bisect_left(starts, b)]


def _cut(spans, start, stop):
    return [s for s in _near(spans, start, stop) if start <= s[1] < stop]


def short(rows):
    """The very long text goes through other tests: the plain version takes a minute for it."""
    return [(d, t if t is None or len(t) < 20_000 else t[:3000]) for d, t in rows]


ODD = [(30, "a▁b"), (31, "x\x00y"), (32, "<s> </s> <unk> <0x41>"), (33, "ﬁne café café ​\U0001f600"), (34, " lead"), (35, "\n"), (36, "a  b\t\tc\r\n"), (37, "　wide blank"), (38, "<|endoftext|>")]


@pytest.mark.parametrize("block", [300, 4_000_000])
def test_edge_table(spark, block, monkeypatch):
    monkeypatch.setattr(aligning, "HOT", 3 if block == 300 else 20_000)
    rows = short([*edge.texts(), *ODD])
    want, total = by_hand(rows)
    df = edge.table(spark, rows)
    got = aligning.align(df, A, B, block_chars=block, with_groups=True).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(want, key=str)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 if r.n_a else r.groups == r.groups_sha256 == "" for r in got)
    assert aligning.align(df.limit(0), A, B).count() == 0
    counts = aligning.pair_counts(aligning.blocks(df, A, B, block)).collect()
    assert {(r.a, r.b): r.n for r in counts} == total
    tops = {}
    for (_, j), n in total.items():
        tops[j] = max(tops.get(j, 0), n)
    assert all(r.best == (r.n == tops[r.b]) for r in counts)


def test_bytes_of_tokens():
    of = aligning.Both(A, B)
    assert of.bytes_a.of(of.a.flat([" héllo\n<|endoftext|> 日"])[0].astype(int))[0].tobytes() == " héllo\n<|endoftext|> 日".encode()


def test_texts_whose_bytes_differ_have_no_tokens(spark):
    got = aligning.align(spark.createDataFrame([(1, "a▁b"), (2, "ab")], "doc_id long, text string"), A, B).collect()
    assert [(r.doc_id, r.n_a > 0) for r in sorted(got)] == [(1, False), (2, True)]


def test_a_row_repeated_for_most_of_the_table(spark):
    rows = [(1, "the same row again and again")] * 400 + [(i, f"other words {i}") for i in range(2, 30)]
    want, _ = by_hand(rows)
    got = aligning.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), A, B, block_chars=500).drop("groups").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_query_on_given_documents(spark):
    want, _ = by_hand(edge.documents())
    assert sorted(map(tuple, queries.QUERIES["op12_interval_coalescing"](spark, "/root/testdata/sf0.001").collect())) == sorted(want)


def test_few_blocks_share_a_row_group(spark):
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"text number {i} " * 20_000) for i in range(7)], "doc_id long, text string").coalesce(1)
    held = aligning.blocks(docs, A, B, block_chars=500)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in held.inputFiles()]
    assert sum(m.num_rows for m in files) == 7  # a block holds megabytes; Parquet alone would keep 100 of them before it looks at their size
    assert max(m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)) <= 2
