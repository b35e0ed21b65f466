import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lureline.llm import fim, queries
from tests.llm import edge

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    hexed = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, n, "plain", None, None, text
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if h[3] % 100 < spm:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200_000), st.integers(1, 9000), st.integers(1, 5)), min_size=1, max_size=5))
def test_select_in_every_kind_of_container(spans):
    """Runs (step 1), sparse arrays and dense bitmaps, over several containers."""
    held = np.unique(np.concatenate([np.arange(a, a + n * step, step) for a, n, step in spans]))
    bounds = fim.Boundaries(held)
    assert len(bounds) == len(held)
    for i in {0, len(held) - 1, len(held) // 2, *np.linspace(0, len(held) - 1, 40).astype(int).tolist()}:
        assert bounds.select(i) == held[i]


def test_kinds_of_containers():
    draw = np.random.default_rng(2)
    assert {c.kind for c in fim.Boundaries(np.r_[np.arange(0, 60000), 70000, 70005, (1 << 17) + np.unique(draw.integers(0, 1 << 16, 30000))]).containers} == {"run", "array", "bitmap"}
    dense = np.unique(draw.integers(0, 1 << 16, 40000))
    assert [fim.Boundaries(dense).select(i) for i in range(0, len(dense), 97)] == dense[::97].tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\x1cé 日", max_size=30))
def test_unit_ends(text):
    assert fim.unit_ends(text).tolist() == [m.end() for m in UNIT.finditer(text)]


def test_edge_table(spark):
    rows = [*edge.texts(), (20, "has <P> inside"), (21, "has <M>"), (22, "near < P> <S <M"), (23, "<S"), (24, "P> ends with <"), *[(100 + i, f"< <S <P> no{'' if i % 2 else '<'} M> {i}"[2 if i % 3 else 5 :]) for i in range(40)]]
    got = fim.transform(edge.table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((by_hand(d, t) for d, t in rows), key=str)
    back = got.select("doc_id", fim.restored(got.output, got.form).alias("t")).collect()
    assert sorted(((r.doc_id, r.t) for r in back), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    assert fim.transform(edge.table(spark).limit(0)).count() == 0


@pytest.mark.parametrize(("rate", "spm", "form"), [(100, 100, "spm"), (100, 0, "psm"), (0, 50, "plain")])
def test_rates(spark, rate, spm, form):
    rows = [(i, "one two  three\nfour ") for i in range(50)]
    got = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), rate, spm)
    assert sorted(map(tuple, got.collect())) == sorted(by_hand(d, t, rate, spm) for d, t in rows)
    assert {r.form for r in got.collect()} == {form}


def test_query_on_given_documents(spark):
    got = queries.QUERIES["op13_fill_in_middle"](spark, "/root/testdata/sf0.01").collect()
    want = []
    for d, t in edge.documents("sf0.01"):
        *digest, output = by_hand(d, t)
        want.append((*digest, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
