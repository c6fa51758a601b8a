"""Streams with late, repeated and out-of-order events; strict validation; state that is missing."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from parchment.operators import billing, metrics, quota
from parchment.sources import records
from parchment.streaming import limits, webhooks
from parchment.streaming.sources import read_files


def at(day, hour=12):
    return datetime.datetime(2024, 1, day, hour)


def feed(spark, folder, schema, parts, run):
    for rows in parts:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/in")
        run(read_files(spark, f"{folder}/in", spark.createDataFrame([], schema).schema))


def test_a_late_message_counts_with_its_own_day(spark, tmp_path):
    out = str(tmp_path)
    schema = "user_id int, ts timestamp, event_id int, day date, daily_messages int"
    row = lambda day, event: (1, at(day), event, at(day).date(), 1)
    parts = [[row(1, 1)], [row(20, 2)], [row(1, 3), row(2, 4)]]
    feed(spark, out, schema, parts, lambda s: limits.take_messages(s, out, f"{out}/checkpoint"))
    got = {r.event_id: r.accepted for r in spark.read.parquet(f"{out}/decisions").collect()}
    assert got == {1: True, 2: True, 3: False, 4: True}


def test_limiter_state_stays_within_the_window(spark, tmp_path):
    out = str(tmp_path)
    schema = "key int, ts timestamp, event_id int"
    parts = [[(1, at(1), 1), (1, at(1, 13), 2)], [(1, at(3), 3), (2, at(1), 4)]]
    feed(spark, out, schema, parts, lambda s: limits.rate_limited(s, 5, 3600, out, f"{out}/checkpoint"))
    held = limits.state(spark, f"{out}/checkpoint", "accepted").selectExpr("key.key AS key", "list_element.micros AS micros")
    want = [(1, at(3)), (2, at(1))]
    assert sorted(map(tuple, held.collect())) == [(k, int(t.replace(tzinfo=datetime.UTC).timestamp() * 1e6)) for k, t in want]


def test_restarts_go_on_where_the_checkpoint_is(spark, tmp_path):
    """Each part is a stream of its own start; verdicts equal those of one batch over all parts."""
    rng = random.Random(5)
    start, out = at(1, 0), str(tmp_path)
    rows = sorted((start + datetime.timedelta(seconds=rng.randrange(40_000)), rng.choice([1, 1, 1, 2, 3])) for _ in range(240))
    rows = [(k, t, n) for n, (t, k) in enumerate(rows)]
    schema = "key int, ts timestamp, event_id int"
    parts = [rows[i : i + 60] for i in range(0, 240, 60)]
    feed(spark, out, schema, parts, lambda s: limits.rate_limited(s, 4, 900, out, f"{out}/checkpoint"))
    got = {r.event_id: r.accepted for r in spark.read.parquet(f"{out}/verdicts").collect()}
    whole = quota.rate_limited(spark.createDataFrame(rows, schema), 4, 900).collect()
    assert got == {r.event_id: r.accepted for r in whole} and not all(got.values())


def test_an_event_a_month_late_corrects_its_period(spark, tmp_path):
    from parchment.streaming import metrics as stream

    out = str(tmp_path)
    answer = lambda ms: json.dumps({"kind": "answer", "intent": "qa", "status": "grounded", "model": "m", "registry_version": "0" * 12, "latency_ms": ms})
    parts = [[(at(1), answer(10)), (at(1, 20), answer(20)), (at(2), answer(5))], [(at(30), answer(7))], [(at(1), answer(90)), (at(1), "broken")]]
    feed(spark, out, "ts timestamp, payload string", parts, lambda s: stream.period_answers(s, f"{out}/rows", f"{out}/checkpoint"))
    got = {(r.period.day, r.answers, r.avg_latency_ms) for r in stream.read_periods(spark, f"{out}/rows").collect()}
    assert got == {(1, 3, 40), (2, 1, 5), (30, 1, 7)}


def test_a_plan_may_change_between_messages(spark, tmp_path):
    out = str(tmp_path)
    schema = "user_id int, ts timestamp, event_id int, day date, daily_messages int"
    row = lambda hour, event, limit: (1, at(1, hour), event, at(1).date(), limit)
    parts = [[row(9, 2, 1), row(8, 1, 1)], [row(12, 4, 2), row(11, 3, 1)], [row(13, 5, 2), row(14, 6, None)]]
    feed(spark, out, schema, parts, lambda s: limits.take_messages(s, out, f"{out}/checkpoint"))
    got = {r.event_id: (r.accepted, r.used) for r in spark.read.parquet(f"{out}/decisions").collect()}
    assert got == {1: (True, 1), 2: (False, 1), 3: (False, 1), 4: (True, 2), 5: (False, 2), 6: (True, 3)}


def test_users_of_a_bucket_are_one_key_of_the_quota(spark, tmp_path, monkeypatch):
    """Users and days keep their own counts over restarts, messages without a day too; Python is called by bucket."""
    monkeypatch.setattr(limits, "BUCKETS", 2)
    rng, out = random.Random(9), str(tmp_path)
    schema = "user_id int, ts timestamp, event_id int, day date, daily_messages int"
    rows = []
    for n in range(600):
        when = at(rng.randint(1, 31), rng.randint(0, 23)).replace(month=rng.choice([1, 3]))
        user = rng.randint(1, 12)
        rows.append((user, when, n, None if n % 40 == 0 else when.date(), None if user == 1 and when.day % 2 else user % 2))
    rows.sort(key=lambda r: (r[1], r[2]))
    parts = [rows[:150], rows[150:290], rows[290:]]
    feed(spark, out, schema, parts, lambda s: limits.take_messages(s, out, f"{out}/checkpoint"))
    got = {r.event_id: (r.accepted, r.used) for r in spark.read.parquet(f"{out}/decisions").collect()}
    counts, want = {}, {}
    for user, _, event, day, limit in rows:
        c = counts.get((user, day), 0)
        ok = limit is None or c < limit
        counts[user, day] = c + ok
        want[event] = (ok, c + ok)
    assert got == want and not all(a for a, _ in got.values())
    assert limits.state(spark, f"{out}/checkpoint").count() == 6  # two buckets, two months and none


EVENTS = (
    "event_id int, event_type string, ts timestamp, customer_id int, reference_id string, subscription_id string, "
    "status string, lookup_key string, period_end timestamp, cancel_at_period_end boolean"
)


def test_late_and_repeated_webhooks_and_checkouts(spark, tmp_path):
    out = str(tmp_path)
    changed = billing.SUBSCRIPTION_EVENTS[1]
    row = lambda e, kind, day, customer, ref=None, status="active": (e, kind, at(day), customer, ref, f"s{customer}", status, "pro_monthly", at(28), False)
    parts = [
        [row(1, changed, 25, 10), row(2, changed, 3, 30)],  # 30 is known by a later checkout only
        [row(3, changed, 28, 10, status="canceled"), row(4, "invoice.paid", 28, 20)],
        [row(5, changed, 1, 20), row(1, changed, 25, 10), row(6, billing.CHECKOUT_EVENT, 2, 30, "c"), row(7, changed, 5, 99)],
    ]
    feed(spark, out, EVENTS, parts, lambda s: webhooks.process(s, out, f"{out}/checkpoint"))
    users = spark.createDataFrame([("a", 10), ("b", 20), ("c", None)], "user_id string, customer_id int")
    got = {r.user_id: (r.plan, r.status) for r in webhooks.current_state(spark, out, users).collect()}
    assert got == {"a": ("free", "canceled"), "b": ("pro", "active"), "c": ("pro", "active")}


def test_a_read_does_not_grow_with_history(spark, tmp_path, monkeypatch):
    """Ten batches, folded every third: the state of all events, from the last fold and what came since."""
    monkeypatch.setattr(webhooks, "FOLD", 3)
    rng, out = random.Random(3), str(tmp_path)
    kinds = [*billing.SUBSCRIPTION_EVENTS, billing.CHECKOUT_EVENT, "invoice.paid"]
    rows = []
    for n in range(100):
        customer = rng.randint(1, 6)
        kind = rng.choice(kinds)
        ref = str(customer) if kind == billing.CHECKOUT_EVENT else None
        status = rng.choice(["active", "canceled", "past_due"])
        rows.append((n, kind, at(rng.randint(1, 28), rng.randint(0, 23)), customer, ref, f"s{customer}{n % 2}", status, rng.choice(["pro_monthly", "business_yearly", "x"]), at(28), False))
    parts = [rows[i : i + 10] for i in range(0, 100, 10)]
    parts[4] += rows[:5]
    feed(spark, out, EVENTS, parts, lambda s: webhooks.process(s, out, f"{out}/checkpoint"))
    users = spark.createDataFrame([(str(c), c if c % 2 else None) for c in range(1, 7)], "user_id string, customer_id int")
    events = spark.createDataFrame(rows, EVENTS)
    want = billing.subscription_state(billing.matched_events(events, users), customer="user_id")
    assert sorted(map(str, webhooks.current_state(spark, out, users).collect())) == sorted(map(str, want.collect()))
    folders = {"/".join(f.split("/")[-3:-1]) for f in webhooks.parts(spark, out).inputFiles()}
    assert folders == {"folded/batch=8", "parts/batch=9"}


GOOD = {"kind": "answer", "intent": "qa", "model": "m-1", "registry_version": "0" * 12, "latency_ms": 5}


@pytest.mark.parametrize(
    "change, problem",
    [
        ({}, None),
        ({"latency_ms": 5.0, "tokens_per_sec": 3, "rating": None, "status": "none", "issues": [], "reasons": ["wrong"]}, None),
        ({"tokens_per_sec": None}, None),
        ({"issues": "abc"}, "issues"),
        ({"issues": None}, "issues"),
        ({"issues": [None]}, "issues"),
        ({"issues": ["free text"]}, "issues"),
        ({"status": None}, "status"),
        ({"status": 3}, "status"),
        ({"reasons": 7}, "reasons"),
        ({"rating": ["up"]}, "rating"),
        ({"tokens_per_sec": "fast"}, "tokens_per_sec"),
        ({"tokens_per_sec": {"a": 1}}, "tokens_per_sec"),
        ({"latency_ms": 5.5}, "latency_ms"),
        ({"latency_ms": None}, "latency_ms"),
        ({"kind": 1}, "kind"),
        ({"model": None}, "model"),
        ({"question": "x"}, "unknown field"),
    ],
)
def test_a_field_that_is_there_must_have_its_type(spark, change, problem):
    raw = spark.createDataFrame([(json.dumps(GOOD | change),)], "payload string")
    (r,) = metrics.checked_events(raw).collect()
    assert r.problem == problem


def test_plain_rows_pass_and_unopened_rows_are_reported(spark):
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, updated_at int, text string")
    mixed = records.seal(rows, key).unionByName(rows.selectExpr("concat(id, '2') as id", "updated_at", "text"), allowMissingColumns=True)
    texts = lambda df: sorted((r.id, r.text) for r in df.collect())
    assert texts(records.open_sealed(mixed, "text string", key)) == [("a", "x"), ("a2", "x"), ("b", "y"), ("b2", "y")]
    assert texts(records.open_sealed(mixed, "text string", other)) == [("a2", "x"), ("b2", "y")]
    assert [r.id for r in records.unopened(mixed, "text string", other).collect()] == ["a", "b"]
    assert records.unopened(mixed, "text string", key).collect() == []
    assert texts(records.open_sealed(mixed, "text string", None)) == [("a2", "x"), ("b2", "y")]
