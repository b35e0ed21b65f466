"""The given tables are one row group each: heavy text queries must still run on every core, and do nothing twice."""

import contextlib
import io

from pyspark.sql import functions as F

from lureline.operators import rules, stages
from lureline.operators.normalize import normalize
from lureline.plans import given
from lureline.plans import messages as m
from lureline.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_family_isolation_is_dealt_to_all_cores(spark):
    assert "RoundRobinPartitioning" in _plan(QUERIES["p11_family_isolation"](spark, FOLDER))


def test_families_of_unchanged_and_null_texts(spark):
    docs = spark.createDataFrame([(1, "en", "pay the fee now. thanks: ok!"), (2, "en", None), (3, "en", "plain"), (4, "en", "!?")], "doc_id long, lang string, text string")
    rows = given.families(docs).collect()
    assert len(rows) == 4 * 6
    assert all(r.family is None and r.own is None for r in rows if r.doc_id == 2)
    assert all(r.family == r.own and not r.disguised for r in rows if r.doc_id == 3)
    assert any(r.disguised for r in rows if r.doc_id == 1) and all(r.family == r.own for r in rows if r.doc_id == 1)
    assert any(r.disguised for r in rows if r.doc_id == 4)


def test_family_key_of_the_text_is_computed_before_the_disguises(spark):
    docs = spark.createDataFrame([(1, "en", "abc")], "doc_id long, lang string, text string")
    after = given.families(docs)._jdf.queryExecution().optimizedPlan().toString().rpartition("Generate explode")[2]
    assert "sha2" in after


def test_a_rule_that_is_asked_for_is_found_as_in_the_whole_scan(spark):
    """Every phrase, held against each rule that the whole scan finds in it, and against one that it does not meet."""
    said = normalize(m.phrases(spark).select(F.col("k").alias("message_id"), F.col("phrase").alias("text"))).localCheckpoint()
    whole = rules.findings_table(rules.scan(said))
    kept = ["message_id", "rule_id", "severity", "weight", "evidence"]
    want = sorted(tuple(r) for r in whole.select(*kept).collect())
    assert len({r[1] for r in want}) > 10
    pairs = whole.select("message_id", F.col("rule_id").alias("asked")).union(said.select("message_id", F.lit("not_a_rule"))).union(said.select("message_id", F.lit(None).cast("string")))
    again = rules.scan(said.join(pairs, "message_id"), asked=F.col("asked"))
    assert sorted(tuple(r) for r in rules.findings_table(again).select(*kept).collect()) == want


def test_every_match_of_a_stage_holds_one_of_its_signs(spark):
    said = ["saw your number", "have your cv", "from the hiring desk", "i am a recruiter", "new vacancy", "add me on", "write to me on line", "simple task", "short work", "star and rate the hotel", "watch some clip",
            "click and earn", "little extra bonus", "first payout", "has been credited", "was credited to you", "top-up", "top up", "topup", "recharge", "refill", "reload", "put in 5 first", "asked for a deposit", "now deposit",
            "deposit 5", "send coins", "frozen", "locked out", "negative balance", "minus balance", "wrong order", "made a mistake", "score is", "score fell", "higher tier", "unlock fee", "repair charge",
            "to withdraw you need to", "cash-out now you must first", "cashout unless you", "cash out until you", "refund is behind a", "your winnings until you"]
    lower = F.col("text")
    tests = [F.struct(stages.may_meet(lower, s).alias("may"), lower.rlike(rx).alias("meets")).alias(s) for s, rx in stages.STAGES]
    rows = spark.createDataFrame([(x,) for x in said], "text string").select("text", *tests).collect()
    assert all(any(r[s].meets for s in stages.NAMES) for r in rows)
    assert all(r[s].may for r in rows for s in stages.NAMES if r[s].meets)
