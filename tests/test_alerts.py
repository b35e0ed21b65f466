import os

import pytest
from pyspark.sql import functions as F

from lureline.operators import stages
from lureline.streaming import alerts

SCHEMA = "conv_id long, turn long, sender string, text string, ts timestamp"
SAID = ["a recruiter found your number", "a simple task", "your first payout was credited to you", "now deposit 20", "you made a mistake", "see you on Monday"]
SAID[0] = "I am a recruiter and found your profile, I got your number"


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, alerts.ROCKSDB)
    yield
    spark.conf.set(name, before)


def streamed(spark, folder, batches, name, **options):
    """Each list of rows is one micro-batch."""
    for i, rows in enumerate(batches):
        path = str(folder / f"b{i}")
        df = spark.createDataFrame([(c, t, "u", x, when) for c, t, x, when in rows], "conv_id long, turn long, sender string, text string, ts string")
        df.select("conv_id", "turn", "sender", "text", F.to_timestamp("ts").alias("ts")).coalesce(1).write.parquet(path)
        part = next(f for f in os.listdir(path) if f.startswith("part"))
        os.makedirs(folder / "in", exist_ok=True)
        os.link(os.path.join(path, part), folder / "in" / f"{i}.parquet")
        os.utime(folder / "in" / f"{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = alerts.escalation_alerts(source, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    state = q.lastProgress["stateOperators"][0]
    return [tuple(r) for r in spark.table(name).orderBy("conv_id", F.col("turn").asc_nulls_last()).collect()], state


def test_late_turns_go_early_ones_count_and_idle_state_goes(spark, tmp_path, rocksdb):
    rows, state = streamed(spark, tmp_path, [
        [(1, 0, SAID[0], "2026-01-01 08:00:00"), (1, 2, SAID[3], "2026-01-01 08:02:00"), (2, 0, SAID[5], "2026-01-01 08:00:00")],
        [(1, 1, SAID[1], "2026-01-01 08:01:00"), (3, 0, SAID[1], "2026-01-01 09:00:00")],  # 08:01 is out of order but within the watermark
        [(2, 1, SAID[3], "2026-01-01 08:05:00"), (3, 1, SAID[3], "2026-01-01 09:01:00")],  # 08:05 is behind the watermark of 08:50
        [(4, 0, SAID[5], "2026-01-01 23:00:00")],
        [(4, 1, SAID[5], "2026-01-01 23:01:00")],
    ], "alerts_late", late="10 minutes", idle_minutes=60)
    of = {c: sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[4] == "idle", r[1])) for c in (1, 2, 3, 4)}
    assert [(r[1], r[2], r[4]) for r in of[1]] == [(10, "watch", "stage"), (16, "warn", "stage"), (16, "quiet", "idle")]
    assert of[2] == [] and of[4] == []
    assert [(r[2], r[4]) for r in of[3]] == [("watch", "stage"), ("quiet", "idle")]
    assert state["numRowsTotal"] <= 2  # only the last conversation is remembered (its state and its timer)


def test_alerts_in_order_against_a_loop(spark):
    rows = [(c, t, "u", SAID[(c * 7 + t * (c % 4 + 1)) % len(SAID)]) for c in range(12) for t in range(9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, sender string, text string")
    tagged = {(r.conv_id, r.turn): r.stages for r in stages.tag(turns).collect()}
    want = []
    for c in range(12):
        firsts, level = [None] * 6, "quiet"
        for t in range(9):
            for i, n in enumerate(stages.NAMES):
                if n in tagged[c, t] and firsts[i] is None:
                    firsts[i] = t
            score = alerts.score_of(firsts)
            now = [n for n, least in alerts.LEVELS if score >= least][-1]
            if now != level:
                want.append((c, t, score, now, level))
            level = now
    assert sorted(map(tuple, alerts.alerts_in_order(turns).collect())) == want and len(want) > 10


def test_the_store_is_asked_for(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="providerClass"):
        alerts.escalation_alerts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "t")))
