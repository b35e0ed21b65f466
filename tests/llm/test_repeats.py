import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lureline.llm import repeats
from tests.llm import edge


def by_hand(rows, length):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[i : i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((d, len(r), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, length):
    rows = repeats.without_repeats(df, length, carry=["doc_id"]).collect()
    return sorted(((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows), key=str)


def test_matching_statistics():
    draw = random.Random(1)
    for trial in range(40):
        pieces = [bytes(draw.choice(b"ab") for _ in range(draw.randint(1, 25))) for _ in range(draw.randint(1, 7))]
        pieces += pieces[:1] * (trial % 3 == 0)
        places = [(k, i) for k, p in enumerate(pieces) for i in range(len(p))]

        def common(a, b):
            return next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

        want = [max([common(pieces[k][i:], pieces[m][j:]) for m, j in places if (m, j) != (k, i)], default=0) for k, i in places]
        assert repeats.RunIndex(pieces).matching_statistics().tolist() == want


def test_runs_are_fewer_than_bytes_in_repetitive_text():
    piece = bytes(random.Random(2).choice(b"abcdef") for _ in range(500))
    index = repeats.RunIndex([piece] * 20)
    assert index.runs < 0.2 * len(index.text)


def test_every_window_in_one_span():
    for text in (bytes(random.Random(3).choice(b"abc") for _ in range(3000)), b"a" * 1000, b"abcdefgh" * 200):
        first, windows, _ = repeats.spans(np.frombuffer(text, np.uint8), 60)
        assert windows.sum() == len(text) - 59 and (first[1:] == (first + windows)[:-1]).all() and first[0] == 0


@pytest.mark.parametrize("limit", [1_000_000, 0])  # 0: every anchor is split by its windows
def test_edge_table(spark, monkeypatch, limit):
    monkeypatch.setattr(repeats, "INDEX_BYTES", limit)
    rows = [r for r in edge.texts() if len(r[1] or "") < 20_000]
    assert found(edge.table(spark, rows), 60) == by_hand(rows, 60)


def test_given_documents(spark):
    rows = edge.documents()
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), 400)
    assert got == by_hand(rows, 400) and any(r[2] for r in got)


def test_documents_keep_their_columns(spark):
    df = edge.table(spark)
    out = repeats.trimmed_documents(df, 60)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.filter("text IS NULL").count() == 2
    assert repeats.trimmed_documents(df.limit(0), 60).count() == 0
