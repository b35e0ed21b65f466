import hashlib

import pytest
from pyspark.sql import functions as F

from lureline.functions import places, taxonomy
from lureline.operators import bayes, corpus, manifest, stages, verdict, verify
from lureline.plans import given
from lureline.plans.messages import TURN_PHRASES
from lureline.sources import intake, sinks
from lureline.streaming import jobs

MANIFEST = "path string, size_bytes long, sha256 string"


def rows(n):
    return [(f"d{i % 7}/f{i}.txt", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n)]


def test_tree_of_a_manifest(spark):
    nodes = {r.node: r for r in manifest.tree(spark.createDataFrame(rows(3000), MANIFEST).repartition(5)).collect()}
    lines = {}
    for p, n, h in rows(3000):
        lines.setdefault(hashlib.sha256(p.encode()).hexdigest()[:4], []).append(f"{p}\0{n}\0{h}\n")
    sha = lambda x: hashlib.sha256("".join(sorted(x)).encode()).hexdigest()
    leaves = {k: sha(v) for k, v in lines.items()}
    branches = {b: sha([f"{k}={d}\n" for k, d in leaves.items() if k[:2] == b]) for b in {k[:2] for k in leaves}}
    want = leaves | branches | {"": sha([f"{k}={d}\n" for k, d in branches.items()])}
    assert {k: r.digest for k, r in nodes.items()} == want
    assert (nodes[""].files, nodes[""].bytes) == (3000, sum(range(3000)))


def test_files_are_hashed_in_parts(spark, tmp_path):
    noise = bytes((i * i // 7) % 256 for i in range(50_000))
    held = {"noise.bin": noise, "lines.csv": b"a\r\nb\rc\n\n" * 3000, "open.txt": b"x\ny", "marked.csv": b"\xef\xbb\xbfa,b\n1,2\n", "marked open.csv": b"\xef\xbb\xbfa\n\nb", "mark": b"\xef\xbb\xbf", "two marks": b"\xef\xbb\xbf" * 2,
            "end": b"\n", "ends": b"\n\n\n", "sub/packed.gz": b"no\ngz", "sub/one.parquet": noise[::-1].replace(b"\n", b""), "sub/left.tmp": b"x"}
    for name, raw in held.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    kept = spark.conf.get("spark.sql.sources.binaryFile.maxLength"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:  # no file but the packed one may be read whole, and parts are small
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 7000)
        got = {r.path: (r.size_bytes, r.sha256) for r in manifest.build(spark, str(tmp_path), 1000).collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", kept[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[1])
    assert got == {n: (len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in held.items() if not n.endswith(".tmp")}


def test_trees_differ_where_files_do(spark):
    old = rows(500)
    new = [*old[3:], ("new.txt", 1, "x")]
    new[10] = (new[10][0], new[10][1], "other")
    a, b = (spark.createDataFrame(x, MANIFEST) for x in (old, new))
    got = {tuple(r) for r in manifest.tree_diff(a, b).collect()}
    assert got == {tuple(r) for r in manifest.verify(a, b).collect()} == {(old[i][0], "removed") for i in range(3)} | {("new.txt", "added"), (new[10][0], "changed")}
    assert manifest.tree_diff(a, a).count() == 0 and manifest.tree(a.limit(0)).count() == 0


def test_records_of_a_table(spark):
    df = spark.createDataFrame([(1, "héllo"), (2, None), (3, "")], "k long, t string")
    got = sorted(tuple(r) for r in manifest.of_rows(df, F.col("k").cast("string"), F.col("t")).collect())
    assert got == [(str(k), len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in ((1, "héllo"), (2, None), (3, ""))]


def test_a_family_key_runs_each_of_its_steps_once(spark):
    plan = spark.range(1).select(corpus.family_key(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("hxxps://") <= 2 and len(plan) < 100_000


def test_disguises_stay_in_their_family(spark):
    texts = ["Pay the fee: see https://case.invalid/x now. Then the deposit — profit! Really? Payment.", "Ein Text: mit Zeichen! Und mehr. Ja?", "...", "12 fee 34", "A. B. C"]
    docs = spark.createDataFrame([(i, "en" if i % 2 == 0 else "de", x) for i, x in enumerate(texts)], "doc_id long, lang string, text string")
    out = {r.variant_type: r for r in given.family_isolation(docs).collect()}
    assert set(out) == set(taxonomy.VARIANTS) and all(r.left_family == r.left_split == 0 and r.families == len(texts) for r in out.values())
    assert sum(r.disguised for r in out.values()) >= 6
    one, two = (spark.range(1).select(corpus.family_key(F.lit(x))).first()[0] for x in ("fee a", "fee b"))
    assert one != two


@pytest.mark.parametrize(("code", "label"), [("SG", "Singapore"), ("  sg  ", "Singapore"), ("KR", "South Korea"), ("VN", "Vietnam"), ("TR", "Turkey"), ("IR", "Iran"), ("UG", "Uganda"), ("HR", "Croatia"), ("AE", ""), ("IL", ""), ("QA", ""), ("ZZ", ""), (None, "")])
def test_official_sources(spark, code, label):
    got = verify.sources(spark.createDataFrame([(1, code)], "message_id long, country_code string")).orderBy("ord").collect()
    assert {r.region_label for r in got} == {label}
    assert [(r.source, r.url) for r in got][-len(places.GLOBAL_SOURCES) :] == list(places.GLOBAL_SOURCES)
    assert (len(got) > len(places.GLOBAL_SOURCES)) == bool(label) and ("No list for this country" in got[0].note) != bool(label)


def test_every_country_has_a_source():
    assert len(places.COUNTRY_SOURCES) == 61
    assert all(len(c) == 2 and c.isupper() and listed and all(u.startswith("http") for _, u in listed) for c, (_, listed) in places.COUNTRY_SOURCES.items())


def test_csv_there_and_back(spark, tmp_path):
    held = [("a", 'say "hi", then\ngo'), ("b", None), ("c", ""), ("d", "ü;|\t")]
    sinks.write_table(spark.createDataFrame(held, "k string, v string"), str(tmp_path / "t"))
    assert sorted(map(tuple, intake.table(spark, str(tmp_path / "t")).collect())) == held


def test_turns_keep_long_senders(spark):
    df = spark.createDataFrame([(1, 0, "x" * 200, "hi"), (1, 1, None, "a"), (1, 2, " a  b ", "c"), (1, 3, "z", " ")], "conv_id long, turn long, sender string, text string")
    assert [(r.message, r.sender) for r in intake.turns(df).orderBy("message").collect()] == [(1, "x" * 200), (2, "Unknown"), (3, "a b")]
    assert intake.turns(df, sender_chars=60).orderBy("message").first().sender == "x" * 60


def test_each_stage_phrase_meets_its_stage(spark):
    said = [p for p in TURN_PHRASES if p]
    df = spark.createDataFrame([(1, i, "u", p) for i, p in enumerate(said)], "conv_id long, turn long, sender string, text string")
    assert {s for r in stages.tag(df).collect() for s in r.stages} == set(stages.NAMES)


MESSAGE = "message_id long, text string, source_url string, claimed_domain string, recruiter_email string"


def test_a_stream_is_scored_to_the_verdict(spark, tmp_path):
    held = [(1, "Pay the registration fee before you start the job. Guaranteed profit, no risk. " * 3, "http://dbs-login.top/verify-support", "dbs.com", "x@gmail.com"), (2, "The meeting moves to Tuesday at ten, please bring the printed notes.", None, None, None)]
    for i, r in enumerate(held):
        spark.createDataFrame([r], MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.verdict_stream(stream, lambda df, n: seen.extend((n, r.message_id, r.risk_band, r.risk_score) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    model, fixed = bayes.seed_model(spark)
    want = sorted((r.message_id, r.risk_band, r.risk_score) for r in verdict.score(spark.createDataFrame(held, MESSAGE), model, fixed).collect())
    assert sorted(s[1:] for s in seen) == want and len({s[0] for s in seen}) == 2
