"""Metric events as a stream: validation, append, running summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parchment.operators import metrics
from parchment.streaming.sources import run_available


def ingest(raw: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends accepted and rejected events to two tables under ``out``.

    Each micro-batch owns a folder it overwrites, so a repeated batch does not double events.
    """

    def write(batch: DataFrame, number: int) -> None:
        checked = metrics.checked_events(batch)
        metrics.accepted(checked).write.mode("overwrite").parquet(f"{out}/accepted/batch={number}")
        metrics.rejected(checked).write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")

    return run_available(raw.writeStream.foreachBatch(write), checkpoint)


def running_summary(raw: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps the summary current. Its rows are combinations of enums, so the whole of it is small."""
    totals = metrics.summary(metrics.accepted(metrics.checked_events(raw)))

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return run_available(totals.writeStream.outputMode("complete").foreachBatch(write), checkpoint)


def period_answers(raw: DataFrame, out: str, checkpoint: str, ts: str = "ts", window: str = "1 day") -> StreamingQuery:
    """Answers per intent, status and period of event time, kept current in ``out``; ``read_periods`` reads them.

    No period is ever closed: an event that comes a month late corrects the rows of its period. Spark's state is one
    row per period, intent and status; a batch writes the rows it changed, in a folder of its own
    that a repeated batch overwrites.
    """
    events = metrics.accepted(metrics.checked_events(raw)).where(F.col("kind") == "answer")
    period = F.window(F.col(ts).cast("timestamp"), window).getField("start").alias("period")
    totals = events.groupBy(period, "intent", "status").agg(
        F.count("*").alias("answers"), F.avg("latency_ms").cast("long").alias("avg_latency_ms")
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return run_available(totals.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def read_periods(spark: SparkSession, out: str) -> DataFrame:
    """The present row of each period, intent and status: the one written last."""
    now = F.max_by(F.struct("answers", "avg_latency_ms"), "batch").alias("now")
    return spark.read.parquet(out).groupBy("period", "intent", "status").agg(now).select("period", "intent", "status", "now.*")
