import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_mixing import by_hand as mixed_by_hand
from tests.llm.test_nearjoin import by_hand as components_by_hand
from tests.llm.test_perplexity import verdicts_by_hand
from tests.llm.test_repeats import Counter

D = "/root/testdata/sf0.001"


def trimmed_by_hand(texts, length=400):
    raws = [t.encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(b for b, g in zip(r, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_stages_one_after_the_other_against_plain_versions(spark):
    """Each stage is held against a plain version on what the stage before kept; the last one's ids against the tokenizer's."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "repeated passages", "mixing", "packing"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    rows = docs.collect()
    steps = [f for _, f in corpus_pipeline.STAGES]

    kept = {r[0] for r in verdicts_by_hand([(r.doc_id, r.text, r.lang) for r in rows]) if r[8]}
    docs = steps[0](spark, docs, D)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == kept
    rows = [r for r in rows if r.doc_id in kept]

    kept = {r[0] for r in components_by_hand([(r.doc_id, r.text) for r in rows], 5, 80) if r[3]}
    docs = steps[1](spark, docs, D)
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(kept)
    rows = [r for r in rows if r.doc_id in kept]

    left = dict(zip([r.doc_id for r in rows], trimmed_by_hand([r.text for r in rows]), strict=True))
    docs = steps[2](spark, docs, D)
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == left
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    passes = Counter(r[0] for r in mixed_by_hand([(r.doc_id, left[r.doc_id], r.source) for r in rows])[0])
    docs = steps[3](spark, docs, D)
    assert docs.columns == columns and Counter(r.doc_id for r in docs.collect()) == passes and min(passes.values()) >= 1

    of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = defaultdict(list)
    for r in steps[4](spark, docs, D).collect():
        own[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for d, pieces in own.items():
        want = [*of.encode(left[d], add_special_tokens=False).ids, 0]
        assert sorted(pieces) == sorted([(a, len(want[a : a + 1024]), zlib.crc32(np.array(want[a : a + 1024], "<u4").tobytes())) for a in range(0, len(want), 1024)] * passes[d])
    assert set(own) == set(left)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, D).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and re.match("quality", corpus_pipeline.STAGES[0][0])
