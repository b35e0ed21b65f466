import zlib

import numpy as np
from pyspark.sql import functions as F

from lureline.llm import langfamily
from tests.llm import edge


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    got = langfamily.languages(df, sample_docs=100).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    tried = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in tried]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and {r.family for r in got} == {"germanic", "romance"}


def test_labels_of_held_out_rows_are_not_learned(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = df.selectExpr("doc_id", "text", "source", "n_chars", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 'zz' ELSE lang END AS lang")
    one, two = ({r.doc_id: (r.lang_pred, r.score) for r in langfamily.languages(x).collect()} for x in (df, other))
    assert one == two


def test_edge_table(spark):
    df = edge.table(spark)
    got = langfamily.languages(df).collect()
    assert len(got) == df.count()
    blank = [r for r in got if r.doc_id in (5, 6, 7)]
    assert len(blank) == 3 and all(r.lang_pred == "und" and r.score == 0 for r in blank)
    assert all(r.held_out for r in got if r.doc_id is None)
    assert {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert langfamily.languages(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langfamily.languages(df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def test_an_unknown_language_is_a_family_of_its_own():
    assert langfamily.family_of("xx") == "=xx" and langfamily.family_of("FR") == "romance"


def test_rows_of_a_repeated_id_do_not_grow_the_sample(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    first = df.filter("lang = 'en' AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0").orderBy(F.xxhash64("doc_id")).limit(1)
    samples, fit = [], langfamily.fit
    monkeypatch.setattr(langfamily, "fit", lambda s: samples.append(sorted(map(tuple, s.collect()))) or fit(s))
    copies = df.unionAll(first.crossJoin(spark.range(300)).drop("id"))
    others = df.unionAll(first.crossJoin(spark.range(300)).selectExpr("doc_id", "concat(text, ' ', id)", "lang"))
    for x in (df, copies, others):
        langfamily.languages(x, sample_docs=20)
    plain, repeated, many = samples
    assert repeated == plain
    assert max(sum(lang == k for lang, _ in many) for k in ("en", "de", "fr", "es")) <= 20
