import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ("b9_unicode_signals", "b10_script_profile", "b11_fold", "i4_escalation", "l1_checklist", "m_page_findings", "n2_language", "o5_document_variants", "p_corpus_checks", "o12_dedup", "p12_reserved_urls", "q7_review_queue", "t4_sessions")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, con, name):
    a = entry.queries()[name](spark, FOLDER).toPandas()
    b = con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(str, a[cols].itertuples(index=False, name=None))) == sorted(map(str, b[cols].itertuples(index=False, name=None)))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
