"""T2, T5 as alerts: a conversation's escalation kept as keyed state, a row only when its level changes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lureline.functions.rows import settle
from lureline.operators import stages

#: Least escalation score of each level; a conversation starts at the first.
LEVELS: tuple[tuple[str, int], ...] = (("quiet", 0), ("watch", 6), ("warn", 14), ("act", 22))
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALERT = "conv_id long, turn long, escalation_score int, level string, previous string, reason string"


def level_of(score: Column) -> Column:
    out = F.lit(LEVELS[0][0])
    for name, least in LEVELS[1:]:
        out = F.when(score >= least, name).otherwise(out)
    return out


def score_of(firsts: list[int | None]) -> int:
    """I3, I4 from the first turns in canonical order."""
    seen = [f for f in firsts if f is not None]
    return min(30, 4 * len(seen) + 2 * sum(a <= b for a, b in zip(seen, seen[1:], strict=False)))


class Escalation(StatefulProcessor):
    """State of a conversation: six first turns, its level and the end of its idle time. Minima, so turns may come in any order."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("escalation", ", ".join([*(f"f{i} long" for i in range(len(stages.NAMES))), "level int", "until long"]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = tuple(self.state.get()) if self.state.exists() else (*[None] * len(stages.NAMES), 0, 0)
        firsts, level, until = list(held[:-2]), held[-2], held[-1]
        latest = until
        for r in sorted(rows, key=lambda r: (r.at, r.turn)):
            for i, name in enumerate(stages.NAMES):
                if name in r.stages and (firsts[i] is None or r.turn < firsts[i]):
                    firsts[i] = r.turn
            latest = max(latest, int(r.at.timestamp() * 1000) + self.idle_ms)
            score = score_of(firsts)
            now = max(k for k, (_, least) in enumerate(LEVELS) if score >= least)
            if now != level:
                yield Row(conv_id=key[0], turn=r.turn, escalation_score=score, level=LEVELS[now][0], previous=LEVELS[level][0], reason="stage")
                level = now
        if latest != until:
            if until:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
        self.state.update((*firsts, level, latest))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """Nothing was said for the idle time: the state goes; an alert that stood is closed."""
        held = tuple(self.state.get())
        self.state.clear()
        if held[-2]:
            yield Row(conv_id=key[0], turn=None, escalation_score=score_of(list(held[:-2])), level=LEVELS[0][0], previous=LEVELS[held[-2]][0], reason="idle")

    def close(self) -> None:
        pass


def escalation_alerts(turns: DataFrame, time: str = "ts", late: str = "10 minutes", idle_minutes: int = 360) -> DataFrame:
    """A stream of ALERT rows from a stream of turns (conv_id, turn, sender, text, and an event time).

    Turns older than the watermark (``late``) are dropped, others count in any order. A conversation without a turn for ``idle_minutes`` of
    event time is forgotten. Needs the RocksDB state store: set spark.sql.streaming.stateStore.providerClass to ROCKSDB.
    """
    if turns.isStreaming and turns.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    tagged = stages.tag(turns).select("conv_id", F.col("turn").cast("long").alias("turn"), F.col(time).alias("at"), "stages")
    keyed = (tagged.withWatermark("at", late) if turns.isStreaming else tagged).groupBy("conv_id")
    return keyed.transformWithState(Escalation(idle_minutes * 60_000), ALERT, "Append", "EventTime")


def alerts_in_order(turns: DataFrame) -> DataFrame:
    """The batch form: turns taken in the order of their number; running minima, and a row where the level changes."""
    tagged = stages.tag(turns).select("conv_id", "turn", "stages")
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = [F.min(F.when(F.array_contains("stages", n), F.col("turn"))).over(upto).alias(f"_f{i}") for i, n in enumerate(stages.NAMES)]
    out = tagged.select("conv_id", "turn", *firsts)
    out = settle(out, _a=F.array(*[F.col(f"_f{i}") for i in range(len(stages.NAMES))]))
    out = settle(out, escalation_score=stages.escalation(F.col("_a"))["escalation_score"])
    out = out.withColumn("level", level_of(F.col("escalation_score")))
    before = F.coalesce(F.lag("level").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(LEVELS[0][0]))
    return out.withColumn("previous", before).where(F.col("level") != F.col("previous")).select("conv_id", "turn", "escalation_score", "level", "previous")
