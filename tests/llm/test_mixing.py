import hashlib
import math
from collections import defaultdict

import pytest

from lureline.llm import mixing
from tests.llm import edge
from tests.llm.test_perplexity import WORD


def by_hand(rows, entropy=0.97, repeats=4.0, seed=11):
    """rows: doc_id, text, source -> doc_id, source, epoch, n_tokens, place."""
    own = defaultdict(list)
    for d, t, s in rows:
        own[s or "(none)"].append((d, len(WORD.findall(t or "")), t))
    tokens = {s: sum(n for _, n, _ in r) for s, r in own.items()}
    total = sum(tokens.values()) or 1
    share = {s: n / total for s, n in tokens.items() if n}

    def fits(k):
        a = k / mixing.STEPS**2
        p = {s: x**a for s, x in share.items()}
        z = sum(p.values())
        ratio = [p[s] / share[s] for s in p]
        h = -sum(x / z * math.log(x / z) for x in p.values())
        return max(ratio) <= repeats * min(ratio) * (1 + 1e-12), h >= entropy * math.log(len(p)) - 1e-12

    def bisect(ok):  # smallest k in 0 .. STEPS^2 for which it holds, from there on
        low, high = 0, mixing.STEPS**2
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if ok(mid) else (mid + 1, high)
        return low

    least = bisect(lambda k: fits(k)[0])
    most = mixing.STEPS**2 if fits(mixing.STEPS**2)[1] else bisect(lambda k: not fits(k)[1]) - 1
    a = max(least, most, 0) / mixing.STEPS**2
    p = {s: x**a for s, x in share.items()}
    per = max(tokens[s] / p[s] for s in p)

    def draw(seed, *parts):
        return hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()

    out = []
    for s, docs in own.items():
        blocks = -(-len(docs) // 1024)
        quota = round(p[s] * per) if s in p else 0
        whole, rest = divmod(quota, tokens[s]) if tokens[s] else (1, 0)
        for epoch in range(whole + (rest > 0)):
            def at(r):
                d = -1 if r[0] is None else r[0]
                block = int(draw(seed, d)[:8], 16) % blocks
                return draw(seed + 1, epoch, s, block), block, draw(seed + 2, epoch, d), r[0] is not None, d, r[1], r[2] or ""
            place = 0
            for d, n, _ in sorted(docs, key=at):
                if epoch < whole or place + n <= rest:
                    out.append((d, s, epoch, n, place))
                place += n
    return sorted(out, key=str), a


def found(df, **how):
    rows = mixing.mix(df, **how).collect()
    return sorted(((r.doc_id, r.source, r.epoch, r.n_tokens, r.place) for r in rows), key=str), {r.alpha for r in rows}


@pytest.mark.parametrize("how", [{}, {"entropy": 0.999, "repeats": 8.0}, {"entropy": 0.0}, {"entropy": 1.0, "repeats": 1000.0}])
def test_given_documents(spark, how):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "CASE WHEN doc_id % 10 < 6 THEN 'big' WHEN doc_id % 10 < 9 THEN 'mid' ELSE source END AS source")
    want, alpha = by_hand([tuple(r) for r in df.collect()], **how)
    got, alphas = found(df, **how)
    assert len(alphas) == 1 and abs(alphas.pop() - alpha) < 1e-9
    assert got == want
    assert {r[0] for r in got} == set(range(1000))


def test_edge_table(spark):
    rows = [r for r in edge.texts() if len(r[1] or "") < 20_000]
    df = edge.table(spark, rows)
    got, _ = found(df)
    sources = [(r.doc_id, r.text, r.source) for r in df.collect()]
    want, _ = by_hand(sources)
    # Rows with a null id have one draw, so only their tokens order them.
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(r[0], r[1], r[2], r[3]) for r in want]
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(d, t) for d, t in rows}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_no_source_with_tokens(spark):
    df = edge.table(spark, [(1, None), (2, ""), (3, " ")])
    assert sorted(r.doc_id for r in mixing.mix(df).collect()) == [1, 2, 3]
