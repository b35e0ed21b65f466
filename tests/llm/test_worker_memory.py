"""The quality rules encode nothing, so their workers drop an encoder that an earlier stage left there."""

import public_tokenizers
import pyarrow as pa

from lureline.llm import nearjoin, perplexity, repeats, tokens


class _Held:
    """Stands in for documents: hands the function of a map to the test."""

    def select(self, *_):
        return self

    def mapInArrow(self, fn, _):
        self.fn = fn
        return self

    def groupBy(self, *_):
        return self

    agg = groupBy


def test_counting_grams_drops_a_left_encoder(spark):
    tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.encoder.cache_info().currsize == 1
    held = _Held()
    perplexity.counted(held)
    out = list(held.fn(iter([pa.RecordBatch.from_pydict({"text": ["abab", None, ""]})])))
    assert sum(sum(x["c"].to_pylist()) for x in out) == 4
    assert tokens.encoder.cache_info().currsize == 0


class _Texts(_Held):
    def filter(self, *_):
        return self


def test_repeats_and_signatures_drop_a_left_encoder_and_read_runs(spark, monkeypatch):
    text = "some words that stand here " * 4000
    part = pa.RecordBatch.from_pydict({"rk": [b"k"] * 30, "doc_id": list(range(30)), "text": [text] * 30, "raw": [text.encode()] * 30})
    for job in (lambda held: repeats.span_rows(held, 400), lambda held: nearjoin.signed(held, 3)):
        tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
        held = _Texts()
        job(held)
        columns = ["rk", "raw"] if job.__code__.co_names[0] == "repeats" else ["rk", "doc_id", "text"]
        out = list(held.fn(iter([part.select(columns)])))
        assert tokens.encoder.cache_info().currsize == 0
        assert len(out) >= 3  # 3.2 MB of texts: never all of them at once as Python objects


def test_left_texts_are_read_in_the_same_worker(spark):
    own = "".join(chr(0xC0 + k) for k in range(30))
    docs = spark.createDataFrame([(1, "ab" * 30 + own), (2, "ab" * 30), (3, None)], "doc_id long, text string")
    out = repeats.trimmed_documents(docs, 40)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: r.text for r in out.collect()} == {1: own, 2: "", 3: None}


def test_windows_of_a_split_span_go_by_runs(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_DIGESTS", 7)
    held = _Texts()
    held.join = lambda *_: held
    repeats.split_ranges(held, 4)
    out = list(held.fn(iter([pa.RecordBatch.from_pydict({"anchor": [5], "span": [b"s"], "bytes": [b"abcdefghijklmnopqrstuvwxyz"]})])))
    assert [x.num_rows for x in out] == [7, 7, 7, 2]
    assert [f for x in out for f in x["first"].to_pylist()] == list(range(23))
