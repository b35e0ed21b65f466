"""T: the same questions on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lureline.operators import bayes, links, rules, stages, verdict
from lureline.operators.normalize import normalize


def score_stream(messages: DataFrame) -> DataFrame:
    """Findings, links and signals of each message as it arrives; a pure projection, so it keeps no state."""
    scanned = rules.scan(normalize(messages))
    return links.link_findings(links.entities(scanned))


def verdict_stream(messages: DataFrame, write: Callable[[DataFrame, int], None], model: DataFrame | None = None, fixed: DataFrame | None = None, **options) -> DataStreamWriter:
    """T1 up to the verdict: each micro-batch is scored by the batch job and given to ``write`` with its number, which names it when a batch
    is run again after a failure. The built-in model is literal rows, so no batch trains; ``options`` are those of ``verdict.score``."""
    if model is None or fixed is None:
        model, fixed = bayes.seed_model(messages.sparkSession)
    return messages.writeStream.foreachBatch(lambda rows, number: write(verdict.score(rows, model, fixed, **options), number))


def running_escalation(turns: DataFrame) -> DataFrame:
    """Escalation per conversation in update mode. First turns are minima, so turns may arrive in any order."""
    return stages.conversations(stages.tag(turns))


def band_counts(scores: DataFrame, time: str = "ts", group: str = "risk_band", size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Rows per window and group. On a stream a watermark drops what comes too late."""
    source = scores.withWatermark(time, late) if late else scores
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return source.groupBy(w.alias("w"), F.col(group)).agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").alias("window_start"), group, "rows")


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """T4: bursts of activity parted by a gap."""
    source = events.withWatermark(time, late) if late else events
    g = source.groupBy(F.session_window(time, gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("events"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
