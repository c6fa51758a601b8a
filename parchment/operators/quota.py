"""Daily message quotas and sliding-window rate limits in batch."""

from __future__ import annotations

import zoneinfo
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.operators.scan import carry_last, dense_index


# Names the JVM takes only as abbreviations.
SHORT_ZONES = {"EST", "MST", "HST"}


def known_zones(spark: SparkSession) -> list[str]:
    """Every IANA name (about 600), as far as the JVM knows it: Spark throws on a name it does not know."""
    known = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds()) | SHORT_ZONES
    return sorted(zoneinfo.available_timezones() & known)


def local_day(ts: Column, zone: Column, zones: list[str]) -> Column:
    """Calendar date in the user's zone; UTC when the zone is missing or unknown."""
    safe = F.when(zone.isin(zones), zone).otherwise("UTC")
    return F.to_date(F.from_utc_timestamp(ts, safe))


def _instant(ts: str) -> Column:
    return F.col(ts).cast("timestamp")


def daily_usage(messages: DataFrame, user: str = "user_id", day: str = "day") -> DataFrame:
    return messages.groupBy(user, day).agg(F.count("*").alias("messages"))


def limits_in_force(
    messages: DataFrame,
    changes: DataFrame,
    user: str = "user_id",
    ts: str = "ts",
    event: str = "event_id",
    limit: str = "daily_messages",
    seconds_per_block: int = 6 * 3600,
) -> DataFrame:
    """Messages with the ``limit`` of the last of the ``changes`` (user, ts, event, limit) up to their time, and ``since``,
    which names that change. Before the first change a message keeps its own ``limit``.

    An as-of join without a join of pairs: both tables go through one ordered scan in blocks of time.
    """
    change = changes.select(user, ts, event, F.struct(F.col(limit).alias("limit"), ts, event).alias("_change"))
    # A change counts for messages of the same instant.
    both = messages.withColumn("_kind", F.lit(1)).unionByName(change.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    block = F.floor(F.unix_seconds(_instant(ts)) / seconds_per_block)
    seen = carry_last(both, [user], [ts, "_kind", event], F.col("_change"), "_held", block).where("_kind = 1")
    held = F.col("_held").isNotNull()
    name = F.concat_ws("|", F.unix_micros(F.col(f"_held.{ts}").cast("timestamp")), F.col(f"_held.{event}"))
    return seen.withColumns(
        {limit: F.when(held, F.col("_held.limit")).otherwise(F.col(limit)), "since": F.when(held, name).otherwise("")}
    ).drop("_kind", "_change", "_held")


def take_messages(
    messages: DataFrame,
    user: str = "user_id",
    day: str = "day",
    ts: str = "ts",
    event: str = "event_id",
    limit: str = "daily_messages",
    earlier: DataFrame | None = None,
    since: str | None = None,
) -> DataFrame:
    """Adds ``accepted`` and ``used`` (after the message). A null limit accepts everything.

    Refused messages do not count. While one limit holds, a message's number decides; numbers come from
    ten-minute blocks with summed offsets, so one user's day is not one task. Where the limit changes during a
    day, ``since`` names the change (never null) under which a message was sent: ``n`` messages under a limit
    lead from ``c`` accepted ones to ``max(c, min(c + n, limit))``, and these steps, one for each change in a
    user's day, are composed in order. ``earlier`` holds messages accepted before, as (user, day, messages).
    """
    block = F.floor(F.unix_seconds(_instant(ts)) / 600)
    keys = [user, day] + ([since] if since else [])
    numbered = dense_index(messages, keys, [ts, event], "_n", block)
    before = F.lit(0).cast("long")
    if earlier is not None:
        earlier = earlier.select(user, day, F.col("messages").alias("_earlier"))
    if since:
        runs = numbered.groupBy(*keys).agg(F.min(F.struct(ts, event)).alias("at"), F.count("*").alias("n"), F.max(limit).alias("limit"))
        days = runs.groupBy(user, day).agg(F.array_sort(F.collect_list(F.struct("at", since, "n", "limit"))).alias("runs"))
        if earlier is not None:
            days = days.join(earlier, [user, day], "left")
            before = F.coalesce("_earlier", before)
        entry = f"array<struct<{since}:string,_before:bigint>>"

        def step(state: Column, run: Column) -> Column:
            count, top = state["count"], state["count"] + run["n"]
            after = F.when(run["limit"].isNull(), top).otherwise(F.greatest(count, F.least(top, run["limit"].cast("long"))))
            seen = F.array_append(state["seen"], F.struct(run[since].alias(since), count.alias("_before")))
            return F.struct(after.alias("count"), seen.alias("seen"))

        start = F.struct(before.alias("count"), F.array().cast(entry).alias("seen"))
        offsets = days.select(user, day, F.inline(F.aggregate("runs", start, step)["seen"]))
        numbered = numbered.join(offsets, keys)
        before = F.col("_before")
    elif earlier is not None:
        numbered = numbered.join(earlier, [user, day], "left")
        before = F.coalesce("_earlier", before)
    n = F.col("_n") + 1 + before
    reached = F.greatest(before, F.least(n, F.col(limit).cast("long")))
    return (
        numbered.withColumn("accepted", F.col(limit).isNull() | (n <= F.col(limit)))
        .withColumn("used", F.when(F.col(limit).isNull(), n).otherwise(reached))
        .drop("_n", "_before", "_earlier")
    )


def messages_left(used: Column, limit: Column, warn_at: int = 3) -> tuple[Column, Column]:
    """(left, warn): null without a limit."""
    left = F.when(limit.isNotNull(), F.greatest(F.lit(0), limit - used))
    return left, left <= warn_at


def settle(times: np.ndarray, past: np.ndarray, held: deque, max_hits: int, window: float) -> np.ndarray:
    """Verdicts of hits in order of time. ``held`` are the accepted times that may still count, at most
    ``max_hits``, and is kept up to date; hits in ``past`` have been accepted before.

    With the state full, nothing is accepted until its oldest time leaves the window: that hit is
    found by bisection and those before it are refused together, so the steps follow the accepted hits.
    """
    if not held and len(times) <= max_hits:
        held.extend(times)
        return np.ones(len(times), bool)
    ok = np.zeros(len(times), bool)
    forced = np.flatnonzero(past)
    k = 0
    while k < len(times):
        while held and times[k] - held[0] > window:
            held.popleft()
        if past[k] or len(held) < max_hits:
            ok[k] = True
            held.append(times[k])
            k += 1
            continue
        free = int(np.searchsorted(times, held[0] + window, side="right")) if held else len(times)
        known = np.searchsorted(forced, k)
        k = min(max(free, k + 1), int(forced[known]) if known < len(forced) else len(times))
    return ok


def _limiter(max_hits: int, window: float, columns: list[str]):
    """Sorted hits in batches; the state is one run's accepted times."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, deque()
        for batch in batches:
            run, times, past = (batch[c].to_numpy() for c in ("_run", "_micros", "_past"))
            past = past.astype(bool)
            edges = np.r_[0, np.flatnonzero(run[1:] != run[:-1]) + 1, len(run)] if len(run) else [0]
            verdicts = np.zeros(len(run), bool)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if run[a] != current:
                    current, held = run[a], deque()
                verdicts[a:b] = settle(times[a:b], past[a:b], held, max_hits, window)
            out = batch[columns].copy()
            out["accepted"] = verdicts
            yield out[~past]

    return walk


def rate_limited(
    hits: DataFrame,
    max_hits: int,
    window_seconds: int,
    key: str = "key",
    ts: str = "ts",
    event: str = "event_id",
    minutes_per_block: int = 10,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Adds ``accepted``: fewer than ``max_hits`` accepted hits of the key within the window.

    Only accepted hits count, so each verdict depends on the earlier ones. A pause longer than the
    window empties the state: runs between pauses are independent and are spread by run, not by
    key. Within a run the rows pass through in order, in batches, with ``max_hits`` times as state.
    ``earlier`` holds hits accepted before, as (key, ts, event): they fill the state only.
    """
    columns = hits.columns
    hits = hits.withColumn("_past", F.lit(False))
    if earlier is not None:
        hits = hits.unionByName(
            earlier.select(key, ts, event).withColumn("_past", F.lit(True)), allowMissingColumns=True
        )
    previous = dense_previous(hits, key, ts, event, minutes_per_block)
    micros = F.unix_micros(_instant(ts))
    pause = F.col("_previous").isNull() | (micros - F.col("_previous") > window_seconds * 1_000_000)
    marked = previous.withColumn("_micros", micros).withColumn("_start", F.when(pause, micros))
    # The run is named by its first time; carried forward like any other value.
    block = F.floor(F.unix_seconds(_instant(ts)) / (60 * minutes_per_block))
    runs = carry_last(marked, [key], [ts, event], F.col("_start"), "_run_start", block)
    runs = runs.withColumn("_run", F.concat_ws("|", F.col(key).cast("string"), F.col("_run_start").cast("string")))
    ordered = runs.select(*columns, "_past", "_run", "_micros").repartition("_run").sortWithinPartitions("_run", ts, event)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema if f.name in columns) + ", accepted boolean"
    return ordered.mapInPandas(_limiter(max_hits, window_seconds * 1_000_000, columns), schema)


def dense_previous(hits: DataFrame, key: str, ts: str, event: str, minutes_per_block: int) -> DataFrame:
    """Adds ``_previous``: time (microseconds) of the key's previous hit."""
    block = F.floor(F.unix_seconds(_instant(ts)) / (60 * minutes_per_block))
    return carry_last(hits, [key], [ts, event], F.unix_micros(_instant(ts)), "_previous", block, before=True)
