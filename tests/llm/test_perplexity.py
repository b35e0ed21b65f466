import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lureline.llm import perplexity, queries
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts_by_hand(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def symbols(text):
    return [int(s) for s in perplexity._SYMBOL[[ord(c) if ord(c) < 1 << 16 else ord(c) % 29 + 0x4E00 // 29 * 29 for c in text]]] if text else []


class ByHand:
    """Modified Kneser-Ney with dictionaries."""

    def __init__(self, texts):
        raw = Counter()
        for t in texts:
            s = [0, 0, 0, *symbols(t)]
            raw.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
        self.counts = {4: raw}
        for n in (3, 2, 1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.off, self.sums = {}, {}
        for n, c in self.counts.items():
            n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
            if min(n1, n2, n3, n4):
                y = n1 / (n1 + 2 * n2)
                self.off[n] = [min(max(d, 0), k - 1e-3) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
            else:
                self.off[n] = [0.5, 0.75, 0.9]
            self.sums[n] = defaultdict(lambda: [0, 0.0])
            for g, v in c.items():
                self.sums[n][g[:-1]][0] += v
                self.sums[n][g[:-1]][1] += self.off[n][min(v, 3) - 1]

    def p(self, g):
        n = len(g)
        if n == 0:
            return 1 / 64
        total, gone = self.sums[n].get(g[:-1], (0, 0))
        if not total:
            return self.p(g[1:])
        v = self.counts[n].get(g, 0)
        own = (v - self.off[n][min(v, 3) - 1]) / total if v else 0
        return own + gone / total * self.p(g[1:])

    def log_perplexity(self, text):
        s = [0, 0, 0, *symbols(text)]
        return -sum(math.log(self.p(tuple(s[i : i + 4]))) for i in range(len(s) - 3)) / (len(s) - 3) if len(s) > 3 else None


def verdicts_by_hand(rows, reach=3.0):
    """rows: doc_id, text, lang."""
    model = ByHand([t for _, t, _ in rows if t])
    out = []
    for d, t, lang in rows:
        n = counts_by_hand(t)
        out.append([d, *n, n[0] < 50 or 100 * n[4] > 50 * n[0], model.log_perplexity(t or ""), lang or "und"])
    by_lang = defaultdict(list)
    for r in out:
        if not r[6] and r[7] is not None:
            by_lang[r[8]].append(math.floor(r[7] / 0.001))
    band = {}
    for lang, own in by_lang.items():
        own.sort()
        q1, q3 = ((own[max(0, math.ceil(q * len(own)) - 1)] + 0.5) * 0.001 for q in (0.25, 0.75))
        apart = max(q3 - q1, perplexity.BINS)
        band[lang] = (q1 - reach * apart, q3 + reach * apart)
    return [(*r[:7], r[7], bool(not r[6] and r[8] in band and band[r[8]][0] <= r[7] <= band[r[8]][1])) for r in out]


def compare(df, rows):
    got = sorted((tuple(r) for r in perplexity.judged(df).select("doc_id", *perplexity.FEATURES[:5], "base_failed", "log_perplexity", "kept").collect()), key=str)
    want = sorted(verdicts_by_hand(rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7] and g[8] == w[8], (g, w)
        assert g[7] == pytest.approx(w[7], abs=1e-4)
    return want


def test_edge_table(spark):
    df = edge.table(spark)
    compare(df, [(r.doc_id, r.text, r.lang) for r in df.collect()])
    assert perplexity.judged(df.limit(0)).count() == 0


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = compare(df, [(r.doc_id, r.text, r.lang) for r in df.collect()])
    assert 0 < sum(not r[8] for r in want) < len(want) / 3


def test_unseen_text_backs_off(spark):
    texts = ["the cat sat on the mat and the dog sat on the log", "a dog and a cat", "abc abd abe"]
    model = perplexity.Model(perplexity.kneser_ney(spark.createDataFrame([(t,) for t in texts], "text string")))
    by_hand = ByHand(texts)
    for t in ("zebra quartz", "the cat", "日本", "x"):
        keys, _ = perplexity.grams([t])
        assert -float(np.mean(model.score(keys))) == pytest.approx(by_hand.log_perplexity(t), abs=1e-4)


def test_most_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    got = perplexity.judged(spark.read.parquet(f"{d}/documents.parquet")).filter("NOT base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality").agg({"kept": "count"}).collect()
    kept = perplexity.judged(spark.read.parquet(f"{d}/documents.parquet")).filter("kept").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("quality = 1").count()
    assert kept >= 0.99 * {r.quality: r[1] for r in got}[1]


def test_labelled_junk_goes_and_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op5_perplexity"](spark, d).filter("NOT base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    junk, clean = ([r.kept for r in got if r.quality == q] for q in (0, 1))
    assert len(junk) > 20 and sum(junk) <= len(junk) / 3
    assert sum(clean) >= 0.99 * len(clean)


def test_a_floor_of_bins_only_meets_a_distance_of_zero(spark):
    rows = [("en", False, 1.6 + 0.01 * i) for i in range(9)] + [("de", False, 1.6)] * 9
    got = {r.lang: (r.low, r.high) for r in perplexity.bands(spark.createDataFrame(rows, "lang string, base_failed boolean, log_perplexity double"), least=perplexity.BINS).collect()}
    assert got["en"][1] - got["en"][0] == pytest.approx(7 * 0.04, abs=1e-6)
    assert got["de"][1] - got["de"][0] == pytest.approx(6 * perplexity.BINS, abs=1e-6)


def test_no_character_beyond_ascii_is_folded_into_another(spark):
    for a, b in (("日", chr(ord("日") + 29)), ("é", chr(ord("é") + 29)), ("😀", chr(ord("😀") + 29)), ("я", "җ"), ("=", "~")):
        assert len(set(perplexity.numbered([a + b])[1].tolist())) == 2
    text = "".join(chr(0x10000 + 7 * i % 90_000) for i in range(150_000)) + "aB1"  # more symbols than one number holds four of
    context, last, times, which, sizes = perplexity.numbered([text, "", "ab2"])
    (every, ends), _ = perplexity.grams([text, "", "ab2"])
    assert len({*zip(context.tolist(), last.tolist(), strict=True)}) == len(last) and times.sum() == len(ends) and sizes.tolist() == [150_003, 0, 3]
    assert np.array_equal(context[which], every) and np.array_equal(last[which], ends)
    words = ["aб", "вг", "де", "жз", "ий"]
    mixed = [(i, " ".join(words[(i * 7 + k * k) % 5] for k in range(60)), "ru") for i in range(12)] + [(99, "日本語のテキスト😀 " * 60, "ja")]
    compare(spark.createDataFrame(mixed, "doc_id long, text string, lang string"), mixed)


def test_blocks_of_texts_meet_the_model_with_the_same_result(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    def rows():
        return {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in perplexity.judged(df).collect()}

    want = rows()
    monkeypatch.setattr(perplexity, "BLOCK", 2000)
    assert rows() == want
