"""Rate limits and quotas as streams, with Spark's own state by key.

The limiter keeps, per key, the times of accepted hits that may still count: at most ``max_hits``, none
further than the window behind the key's newest. The quota keeps one number per user and day, for
every day, so a late message is counted with its own day however late it is; the numbers of one month and one of
``BUCKETS`` buckets of users are one key, so Python is called for buckets, not for users. A key's rows of one trigger
are put in order in its task; ``files_per_batch`` of the source bounds them. State lies in the
checkpoint folder, survives lost executors and restarts, and can be read with ``state``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parchment.operators import quota
from parchment.streaming.sources import run_keyed

# Time of a row for sorting; such a name must not begin with an underscore.
MICROS = "micros_of_row"
# Users share this many keys of the quota's state, a month at a time.
BUCKETS = 1024
BUCKET, MONTH, OWNER = "bucket_of_row", "month_of_row", "owner_of_row"


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + more


def _in_order(rows: Iterator[pd.DataFrame], event: str) -> pd.DataFrame:
    return pd.concat(rows, ignore_index=True).sort_values([MICROS, event], kind="stable")


class _Limiter(StatefulProcessor):
    def __init__(self, max_hits: int, window: int, event: str):
        self.max_hits, self.window, self.event = max_hits, window, event

    def init(self, handle) -> None:
        self.accepted = handle.getListState("accepted", "micros long")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        hits = _in_order(rows, self.event)
        held = deque(r[0] for r in self.accepted.get())
        times = hits[MICROS].to_numpy()
        verdicts = quota.settle(times, np.zeros(len(times), bool), held, self.max_hits, self.window)
        # What the window has passed cannot refuse a later hit.
        self.accepted.put([(int(t),) for t in sorted(held)[-self.max_hits :] if max(held) - t <= self.window])
        yield hits.drop(columns=MICROS).assign(accepted=verdicts)

    def close(self) -> None:
        pass


def _quota(event: str, limit: str, columns: list[str]):
    """Decides the messages of one bucket and month; the state is a count for each user and day of them."""

    def decide(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent = _in_order(rows, event)
        counts = dict(zip(*state.get, strict=True)) if state.exists else {}
        ok, used = [], []
        for owner, most in zip(sent[OWNER].tolist(), sent[limit].tolist(), strict=True):
            count = counts.get(owner, 0)
            ok.append(bool(pd.isna(most)) or count < most)
            used.append(count + ok[-1])
            counts[owner] = used[-1]
        state.update((list(counts), list(counts.values())))
        yield sent[columns].assign(accepted=ok, used=used)

    return decide


def _micros(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(MICROS, F.unix_micros(F.col(ts).cast("timestamp")))


def rate_limited(
    hits: DataFrame,
    max_hits: int,
    window_seconds: int,
    out: str,
    checkpoint: str,
    key: str = "key",
    ts: str = "ts",
    event: str = "event_id",
) -> StreamingQuery:
    """Writes verdicts to ``out/verdicts``. Hits of a key must arrive in order of time, batch by batch."""
    limiter = _Limiter(max_hits, window_seconds * 1_000_000, event)
    verdicts = _micros(hits, ts).groupBy(key).transformWithStateInPandas(limiter, _schema(hits, "accepted boolean"), "Append", "None")
    return run_keyed(verdicts.writeStream.format("parquet").option("path", f"{out}/verdicts"), checkpoint, hits.sparkSession)


def take_messages(
    messages: DataFrame,
    out: str,
    checkpoint: str,
    user: str = "user_id",
    day: str = "day",
    ts: str = "ts",
    event: str = "event_id",
    limit: str = "daily_messages",
) -> StreamingQuery:
    """Writes quota decisions to ``out/decisions``. Each message is held against its own limit, so a plan
    may change during the day."""
    rows = _micros(messages, ts).withColumns(
        {
            BUCKET: F.crc32(F.coalesce(F.col(user).cast("string"), F.lit(""))) % BUCKETS,
            MONTH: F.trunc(F.col(day).cast("date"), "month"),
            OWNER: F.to_json(F.struct(F.col(user).alias("user"), F.col(day).alias("day"))),
        }
    )
    decide = _quota(event, limit, messages.columns)
    decided = rows.groupBy(BUCKET, MONTH).applyInPandasWithState(
        decide,
        _schema(messages, "accepted boolean, used bigint"),
        "owners array<string>, messages array<bigint>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    return run_keyed(decided.writeStream.format("parquet").option("path", f"{out}/decisions"), checkpoint, messages.sparkSession)


def state(spark: SparkSession, checkpoint: str, name: str | None = None) -> DataFrame:
    """The state of a stopped stream, one row per key: ``accepted`` times of the limiter (by that name), counts by
    user and day of the quota's buckets (no name)."""
    stored = spark.read.format("statestore").option("path", checkpoint)
    return (stored.option("stateVarName", name) if name else stored).load()
