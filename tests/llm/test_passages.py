"""Passages of words that also start elsewhere, beside strings of 400 bytes."""

import random
import re
from collections import Counter

from lureline.llm import repeats
from tests.llm import edge


def ranges_by_hand(rows, width):
    texts = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((d, sorted(gone)))
    return sorted(((d, g) for d, g in out if g), key=str)


def ranges_found(df, width):
    keys = {bytes(r.rk): r.doc_id for r in df.select("doc_id", repeats.row_key(df.doc_id, df.text).alias("rk")).collect()}
    found, copies = {}, Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    for r in repeats.repeated_words(df, width).collect():
        found.setdefault(bytes(r.rk), set()).update(range(r.start, r.stop))
    text = {bytes(r.rk): (r.doc_id, r.text) for r in df.select("doc_id", "text", repeats.row_key(df.doc_id, df.text).alias("rk")).collect()}
    return sorted(((keys[k], sorted(g)) for k, g in found.items() for _ in range(copies[text[k]])), key=str)


def some_rows():
    """Texts of few words, so that windows repeat in and across texts at all shifts; some rows are there twice."""
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice("abc") for _ in range(draw.randint(0, 60)))) for i in range(40)]
    passage = [f"w{i}" for i in range(30)]
    rows += [(100 + i, "\n".join([f"x{i}y{j}" for j in range(i)] + passage[i:])) for i in range(12)]
    return rows + rows[:3] + [(200, " ".join(passage)), (201, None), (202, "é " * 40)] + [(300, " ".join(passage + ["end"]))] * 5


def test_ranges_against_every_window(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (5, 20, 24):
        assert ranges_found(df, width) == ranges_by_hand(rows, width)


def test_edge_table(spark):
    rows = [r for r in edge.texts() if len(r[1] or "") < 20_000]
    assert ranges_found(edge.table(spark, rows), 8) == ranges_by_hand(rows, 8)


def test_trimming_takes_a_short_passage_of_over_fifty_words(spark):
    """52 words of 259 bytes stand in three texts, once with other blanks; 50 words stand in two and stay."""
    draw = random.Random(6)
    passage, short = ([f"{k}{i:03d}" for i in range(n)] for k, n in (("p", 52), ("s", 50)))

    def own(k):
        return [f"{draw.getrandbits(40):x}" for _ in range(k)]

    a, b, c, d = own(70), own(60), own(80), own(40)
    texts = {1: " ".join(a + passage + b), 2: " ".join(passage + c), 3: " ".join(d) + "\n" + "\t ".join(passage), 4: " ".join(own(30) + short), 5: " ".join(short + own(30)), 6: " ".join(own(200))}
    want = {1: " ".join(a) + "  " + " ".join(b), 2: " " + " ".join(c), 3: " ".join(d) + "\n", **{k: texts[k] for k in (4, 5, 6)}}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in repeats.trimmed_documents(docs).collect()} == texts
    assert {r.doc_id: r.text for r in repeats.trimmed_documents(docs, words=51).collect()} == want
