import json

import pytest
from pyspark.sql import functions as F

from lureline.operators import checks, corpus, manifest, pages
from lureline.sources import intake, sinks
from lureline.streaming import jobs


def records(spark, n=640):
    return corpus.records(spark.range(1, n + 1).withColumnRenamed("id", "number"))


def test_splits_are_written_and_counted(spark, tmp_path):
    r = records(spark)
    counts = {x.split: x.records for x in sinks.write_splits(r, str(tmp_path / "out")).collect()}
    assert sum(counts.values()) == 640 and set(counts) <= set(sinks.SPLITS)
    assert spark.read.json(str(tmp_path / "out")).count() == 640 and (tmp_path / "out" / "_SUCCESS").exists()


def test_an_unknown_split_writes_nothing(spark, tmp_path):
    bad = spark.createDataFrame([("a", "train"), ("b", "other")], "id string, split string")
    with pytest.raises(ValueError, match="other"):
        sinks.write_splits(bad, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_the_corpus_passes_its_checks_and_tampering_fails_them(spark):
    r = records(spark, 1280).cache()
    assert {c.check for c in checks.validate(r).collect() if not c.passed} == set()
    broken = r.withColumn("label", F.when(F.col("id") == "LRC-0000001", "legitimate").otherwise(F.col("label"))).withColumn("text", F.when(F.col("id") == "LRC-0000002", "see https://real.com/x").otherwise(F.col("text")))
    assert {"content_hashes_valid", "reserved_urls_only"} <= {c.check for c in checks.validate(broken).collect() if not c.passed}
    assert checks.violations(r, ["id"], checks.record_constraints()).count() == 0 and len(r.columns) == 42


def test_json_lines_keep_broken_rows(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a"}\n\n{"id": \n')
    rows = intake.records(spark, str(tmp_path / "r.jsonl"), "id string").collect()
    assert sorted((r.id or "", r._corrupt_record is not None) for r in rows) == [("", True), ("a", False)]


def test_suffix_file(spark, tmp_path):
    (tmp_path / "s.dat").write_text("// note\n\ncom\nCo.UK\n*.ck\n!www.ck\n")
    s = intake.suffixes(spark, str(tmp_path / "s.dat"))
    assert (set(s.exact), s.wildcard, s.exception) == ({"com", "co.uk"}, ("ck",), ("www.ck",))


def test_csv_and_report(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,included\nx,No\n")
    (tmp_path / "r.json").write_text(json.dumps({"status": "PASS"}, indent=1))
    assert intake.table(spark, str(tmp_path / "t.csv")).first().included == "No" and intake.report(spark, str(tmp_path / "r.json")).first().status == "PASS"


def test_manifest_names_exactly_the_changed_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    (tmp_path / "c.tmp").write_text("x")
    before = manifest.build(spark, str(tmp_path))
    before = spark.createDataFrame(before.collect(), before.schema)
    assert sorted(r.path for r in before.collect()) == ["a.txt", "b.txt"]
    (tmp_path / "b.txt").write_text("2")
    assert [(r.path, r.state) for r in manifest.verify(before, manifest.build(spark, str(tmp_path))).collect()] == [("b.txt", "changed")]


def test_gates_fail_closed(spark):
    ok = spark.createDataFrame([("safe_provenance_flags", True, 0), ("reserved_urls_only", True, 0)], checks.CHECK)
    none = spark.createDataFrame([], "gate_key string, status string, reviewer string, reviewed_at string, evidence string")
    diff = spark.createDataFrame([("a.txt", "changed")], "path string, state string")
    r = manifest.readiness(manifest.gates(ok, none, diff.limit(0), diff.limit(0))).first()
    assert (r.technical_status, r.overall_status, r.blocked_gate_count) == ("PASS", "NOT_READY_FOR_PRODUCTION", 7)
    every = spark.createDataFrame([(k, "approved", "r", "d", "e") for _, _, k, _ in manifest.GOVERNANCE], none.schema)
    assert manifest.readiness(manifest.gates(ok, every, diff.limit(0), diff.limit(0))).first().overall_status == "READY_FOR_PRODUCTION"
    for evidence, blocked in (((None, None), {"T02", "T04"}), ((diff, diff.limit(0)), {"T02"}), ((diff.limit(0), diff), {"T04"}), ((diff.limit(0), None), {"T04"})):
        assert {x.gate for x in manifest.gates(ok, every, *evidence).collect() if x.state != "PASS"} == blocked


def test_reserved_hosts_are_parsed(spark):
    urls = {"https://case.invalid/x": True, "http://a.example": True, "https://evil.com/case.invalid": False, "https://invalid.evil.com": False, "https://x@y.example:8080/": True}
    out = {r.u: r.ok for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", checks.reserved_url(F.col("u")).alias("ok")).collect()}
    assert out == urls


def test_a_password_input_without_value(spark):
    html = "<title>x</title><input type><script>guaranteed profit</script><form><input type='password'></form>"
    r = pages.inspect(spark.createDataFrame([(1, "http://a.example", html)], "page_id long, url string, html string")).first()
    assert (r.password_fields, r.script_tags, r.forms, r.risk_points, r.signals) == (1, 1, 1, 15, ["password form without https"])


def run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_streams(spark, tmp_path):
    turns = [(1, 1, "u", "now deposit 20"), (1, 0, "u", "a recruiter found your number")]
    spark.createDataFrame(turns, "conv_id long, turn long, sender string, text string").write.parquet(str(tmp_path / "t"))
    s = spark.readStream.schema("conv_id long, turn long, sender string, text string").parquet(str(tmp_path / "t"))
    out = run(spark, jobs.running_escalation(s), "complete", "esc").first()
    assert (out.stage_count, out.escalation_score) == (2, 10)
    events = spark.createDataFrame([("2026-01-01 00:05:00", "a"), ("2026-01-01 00:20:00", "a"), ("2026-01-01 05:00:00", "b")], "t string, k string").select(F.to_timestamp("t").alias("ts"), "k")
    events.write.parquet(str(tmp_path / "e"))
    e = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    assert run(spark, jobs.band_counts(e, group="k", late="10 minutes"), "complete", "win").count() == 2
    assert sorted(r.events for r in run(spark, jobs.sessions(e, "k", late="10 minutes"), "complete", "ses").collect()) == [1, 2]


def test_message_stream(spark, tmp_path):
    schema = "message_id long, text string, source_url string, claimed_domain string, recruiter_email string"
    spark.createDataFrame([(1, "Pay the registration fee before you start the job.", None, None, None)], schema).write.parquet(str(tmp_path / "m"))
    out = jobs.score_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "m"))).select("message_id", F.size("findings").alias("n"))
    assert run(spark, out, "append", "msg").first().n >= 1
