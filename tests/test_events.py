import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from parchment.operators import accounts, billing, conversations, feedback, metrics, quota, scan
from parchment.sources import files, records

EVENT = {
    "kind": "answer", "intent": "qa", "status": "warning", "issues": ["no-citation", "off-topic"],
    "model": "Qwen2.5-1.5B-Instruct-q4f16_1-MLC", "registry_version": "73b4e0e4f4f4", "latency_ms": 15200, "tokens_per_sec": 7.4,
}
FEEDBACK = {**EVENT, "kind": "feedback", "issues": [], "rating": "down", "reasons": ["wrong", "citation"]}
BAD = {
    "unknown field": {**EVENT, "question": "What is the liability cap?"},
    "model": {**EVENT, "model": "What is the liability cap in this contract?"},
    "issues": {**EVENT, "issues": ["The cap is £2.5m"]},
    "reasons": {**EVENT, "reasons": ["the answer said 48 hours"]},
    "registry_version": {**EVENT, "registry_version": "not-a-version"},
    "latency_ms": {**EVENT, "latency_ms": -1},
}


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_metric_events(spark):
    rows = [("good", json.dumps(EVENT)), ("feedback", json.dumps(FEEDBACK)), ("not an object", "[1]")]
    rows += [(k, json.dumps(v)) for k, v in BAD.items()]
    checked = metrics.checked_events(spark.createDataFrame(rows, ["name", "payload"]))
    problems = {r["name"]: r.problem for r in checked.collect()}
    assert problems == {"good": None, "feedback": None, "not an object": "not an object", **{k: k for k in BAD}}
    events = metrics.accepted(checked)
    assert [tuple(r) for r in metrics.answers_by_intent(events).collect()] == [("qa", "warning", 1, 15200)]
    assert {tuple(r) for r in metrics.down_reasons(events).collect()} == {("wrong", 1), ("citation", 1)}
    assert {tuple(r) for r in metrics.issue_counts(events).collect()} == {("no-citation", 1), ("off-topic", 1)}
    assert metrics.summary(events).where("section = 'events'").first().n == 2


def test_scans_with_a_hot_key(spark):
    rows = [(0, i, i if i % 7 == 0 else None) for i in range(1, 400)] + [(k, 5, None) for k in range(1, 100)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    block = F.floor(F.col("t") / 16)
    carried = {(r.k, r.t): r.x for r in scan.carry_last(df, ["k"], ["t"], F.col("v"), "x", block).collect()}
    before = {(r.k, r.t): r.x for r in scan.carry_last(df, ["k"], ["t"], F.col("v"), "x", block, before=True).collect()}
    numbers = {(r.k, r.t): r.x for r in scan.dense_index(df, ["k"], ["t"], "x", block).collect()}
    for i in range(1, 400):
        assert carried[(0, i)] == (i // 7 * 7 or None)
        assert before[(0, i)] == ((i - 1) // 7 * 7 or None)
        assert numbers[(0, i)] == i - 1
    assert carried[(5, 5)] is None and numbers[(5, 5)] == 0


def brute_limit(hits, most, window):
    held, out = {}, {}
    for key, t, event in sorted(hits, key=lambda h: (h[1], h[2])):
        h = held.setdefault(key, [])
        while h and t - h[0] > window:
            h.pop(0)
        out[event] = len(h) < most
        if out[event]:
            h.append(t)
    return out


def test_rate_limit_with_a_hot_key(spark):
    rng = random.Random(1)
    hits = [(0, rng.randint(0, 4000), i) for i in range(300)] + [(rng.randint(1, 20), rng.randint(0, 4000), 300 + i) for i in range(300)]
    hits += [(99, 0, 900), (99, 60, 901), (99, 120, 902)]  # exactly the window apart: still held
    df = spark.createDataFrame([(k, at(t), e) for k, t, e in hits], "key int, ts timestamp, event_id int")
    got = {r.event_id: r.accepted for r in quota.rate_limited(df, 2, 120, minutes_per_block=1).collect()}
    assert got == brute_limit(hits, 2, 120)
    assert (got[900], got[901], got[902]) == (True, True, False)


def test_rate_limit_with_a_key_that_never_pauses(spark):
    hits = [(0, t // 3, t) for t in range(6000)]
    df = spark.createDataFrame([(k, at(t), e) for k, t, e in hits], "key int, ts timestamp, event_id int")
    got = {r.event_id: r.accepted for r in quota.rate_limited(df, 3, 50).collect()}
    assert got == brute_limit(hits, 3, 50)


def test_quota(spark):
    rows = [(1, at(i), i, 30) for i in range(31)] + [(2, at(i), 100 + i, None) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, event_id int, daily_messages int")
    got = {r.event_id: r for r in quota.take_messages(df.withColumn("day", F.to_date("ts"))).collect()}
    assert [got[i].accepted for i in (0, 29, 30)] == [True, True, False]
    assert (got[29].used, got[30].used, got[139].used, got[139].accepted) == (30, 30, 40, True)


def test_zones(spark):
    zones = quota.known_zones(spark)
    # Every name offered must be one Spark knows, or a job would stop at the first message.
    spark.createDataFrame([(z,) for z in zones], ["z"]).select(
        quota.local_day(F.lit("2024-01-10 11:30:00").cast("timestamp"), F.col("z"), zones)
    ).collect()
    rows = spark.createDataFrame([("Pacific/Kiritimati",), ("Pacific/Pago_Pago",), ("Mars/Base",), (None,), ("US/Hawaii",)], "z string")
    days = [str(r[0]) for r in rows.select(quota.local_day(F.lit("2024-01-10 10:30:00").cast("timestamp"), F.col("z"), zones)).collect()]
    assert days == ["2024-01-11", "2024-01-09", "2024-01-10", "2024-01-10", "2024-01-10"]
    late = spark.createDataFrame([("Japan",), ("GB",), ("Singapore",), ("Canada/Pacific",)], "z string")
    days = [str(r[0]) for r in late.select(quota.local_day(F.lit("2024-01-10 22:30:00").cast("timestamp"), F.col("z"), zones)).collect()]
    assert days == ["2024-01-11", "2024-01-10", "2024-01-11", "2024-01-10"]


def test_entitlements(spark):
    users = spark.createDataFrame([(1, "free", "sme"), (2, "pro", "sme"), (3, "gold", None), (4, "business", "charity")], "user_id int, plan string, user_type string")
    got = {r.user_id: (r.plan, r.daily_messages, r.workspaces) for r in accounts.entitlements(users).collect()}
    assert got[1] == ("free", 30, ["personal", "sme"])
    assert got[2] == ("pro", 300, ["personal", "founder", "micro_business", "charity", "sme"])
    assert got[3] == ("free", 30, ["personal"])
    assert got[4][1] is None and len(got[4][2]) == 7


SNAP = "event_id int, ts timestamp, customer_id int, subscription_id string, status string, lookup_key string, period_end timestamp, cancel_at_period_end boolean"


def brute_subscription(events):
    prices = {"pro_monthly": ("pro", "month"), "business_yearly": ("business", "year")}
    state = ("free", None, None, None, False)
    for _, _, _, sub, status, key, _, cancel in sorted(events, key=lambda e: (e[1], e[0])):
        plan, interval = prices.get(key, (None, None))
        live = status in ("active", "trialing", "past_due") and plan is not None
        if not live and state[1] and state[1] != sub:
            continue
        state = (plan if live else "free", sub if live else None, status, interval if live else None, cancel if live else False)
    return state


def test_subscriptions_against_the_walk(spark):
    rng = random.Random(9)
    events = [
        (i, at(rng.randint(0, 50)), rng.randint(0, 40), rng.choice("abc"), rng.choice(["active", "past_due", "canceled", "unpaid"]),
         rng.choice(["pro_monthly", "business_yearly", "gone"]), at(i), rng.random() < 0.3)
        for i in range(400)
    ]
    got = {
        r.customer_id: (r.plan, r.subscription_id, r.status, r.interval, r.cancel_at_period_end)
        for r in billing.subscription_state(spark.createDataFrame(events, SNAP)).collect()
    }
    by_customer = {}
    for e in events:
        by_customer.setdefault(e[2], []).append(e)
    assert got == {c: brute_subscription(rows) for c, rows in by_customer.items()}


def test_late_end_of_an_older_subscription(spark):
    events = [
        (1, at(1), 7, "old", "active", "pro_monthly", None, False),
        (2, at(2), 7, "new", "active", "business_yearly", at(99), True),
        (3, at(3), 7, "old", "canceled", "pro_monthly", None, False),
    ]
    r = billing.subscription_state(spark.createDataFrame(events, SNAP)).first()
    assert (r.plan, r.subscription_id, r.cancel_at_period_end, r.renews_at) == ("business", "new", True, at(99))


def test_ratings(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcdef"), i, at(rng.randint(0, 30)), rng.choice(["up", "up", "down"])) for i in range(80)]
    state = {}
    for key, event, ts, rating in sorted(rows, key=lambda r: (r[2], r[1])):
        if rating == "up" and state.get(key, (None, 0))[0] == "up":
            del state[key]
        else:
            state[key] = (rating, event)
    df = spark.createDataFrame(rows, "id string, event_id int, ts timestamp, rating string")
    assert {r.id: (r.rating, r.event_id) for r in feedback.current_state(df).collect()} == state


def test_feedback_records(spark):
    df = spark.createDataFrame(
        [("up", ["wrong"], "x"), ("down", ["wrong", "bogus"], "  £2.5m per year  ")], "rating string, reasons array<string>, correction string"
    )
    assert [tuple(r) for r in feedback.records(df).collect()] == [("up", [], ""), ("down", ["wrong"], "£2.5m per year")]


def turns(spark, *rows):
    return spark.createDataFrame(
        [(1, i, *r) for i, r in enumerate(rows)], "conv_id int, turn int, role string, text string, abstained boolean"
    )


def test_turn_planning(spark):
    history = [("assistant" if i % 2 else "user", "y" * 300, False) for i in range(30)]
    df = turns(spark, *history, ("assistant", "nothing found", True), ("user", "latest question", False))
    plan, kept = conversations.plan_turns(df, 4096, 300)
    last = lambda plan: max(plan.collect(), key=lambda r: r.turn)
    texts = lambda kept, at: {r.text for r in kept.where(F.col("turn") == at).collect()}
    p = last(plan)
    assert plan.count() == 16
    assert (p.question, p.kept_turns, p.dropped_turns, p.too_long) == ("latest question", 2, 28, False)
    assert p.source_budget > 1500 and "nothing found" not in {r.text for r in kept.collect()}
    assert last(conversations.plan_turns(df, 4096, 300, mode="summary")[0]).kept_turns == 0
    assert last(conversations.plan_turns(df, 4096, 300, with_document=False)[0]).kept_turns > 2
    cited = turns(spark, ("user", "q1", False), ("assistant", "Cap is 5 [~S1].", False), ("user", "q2", False))
    plan, kept = conversations.plan_turns(cited, 4096, 300)
    first = min(r.turn for r in plan.collect())
    assert texts(kept, last(plan).turn) == {"q1", "Cap is 5."} and texts(kept, first) == set()
    answered = turns(spark, ("user", "q1", False), ("assistant", "a1", False), ("user", "q2", False), ("assistant", "a2", False))
    plan, kept = conversations.plan_turns(answered, 4096, 300)
    assert (last(plan).question, texts(kept, last(plan).turn)) == ("q2", {"q1", "a1"})
    long = turns(spark, ("user", "z" * 20000, False))
    assert conversations.plan_turns(long, 4096, 300, with_document=False)[0].first().too_long


def test_every_question_of_a_hot_conversation(spark, monkeypatch):
    """Half of all turns in one conversation, blocks shorter than it, against a walk over lists."""
    import random

    monkeypatch.setattr(conversations, "TURNS_PER_BLOCK", 16)
    rng = random.Random(2)
    rows = []
    for conv in range(12):
        for turn in range(400 if conv == 3 else rng.randint(0, 50)):
            role = rng.choice(["user", "assistant", "system"])
            rows.append((conv, turn * 3 + rng.randint(0, 2), role, "w" * rng.choice([0, 1, 40, 700, 5000])))
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(4)
    for window, with_document in ((2048, False), (1500, True)):
        plan, kept = conversations.plan_turns(df, window, 300, with_document)
        expected, back = [], []
        for conv in range(12):
            mine = sorted((t, role, text) for c, t, role, text in rows if c == conv and text)
            for at, (t, role, text) in enumerate(mine):
                if role != "user":
                    continue
                budget = window - 768 - 96 - 300 - -(-len(text) // 3)
                room, used, n = (budget // 4 if with_document else budget), 0, 0
                for _, _, earlier in reversed(mine[:at]):
                    cost = -(-len(earlier) // 3) + 4
                    if used + cost > room or (with_document and n == 2):
                        break
                    used, n = used + cost, n + 1
                expected.append((conv, t, len(text), budget, n, at - n, max(0, budget - used - 40), budget < 0))
                back += [(conv, t, k + 1, mine[at - k - 1][1], len(mine[at - k - 1][2])) for k in range(n)]
        got = [(r.conv_id, r.turn, len(r.question), r.budget, r.kept_turns, r.dropped_turns, r.source_budget, r.too_long) for r in plan.collect()]
        assert sorted(got) == sorted(expected)
        assert sorted((r.conv_id, r.turn, r.age, r.role, len(r.text)) for r in kept.collect()) == sorted(back)


def test_prompt_rows(spark):
    df = turns(spark, ("user", "q1", False), ("assistant", "a1", False), ("user", "q2", False))
    plan, kept = conversations.plan_turns(df, 4096, 300)
    at = max(r.turn for r in plan.collect())
    source = spark.createDataFrame([(1, at, 1, "S1", "4", "12. Liability", "cap")], "conv_id int, turn int, source_order int, s string, p string, sec string, t string").select(
        "conv_id", "turn", "source_order",
        conversations.source_block(F.col("s"), F.lit(None).cast("string"), F.col("p"), F.col("sec"), F.col("t")).alias("block"),
    )
    rows = {r.turn: r.messages for r in conversations.prompt_table(plan, kept, source, "SYSTEM").collect()}
    m = rows[at]
    assert [x.role for x in m] == ["system", "user", "assistant", "user"]
    assert "[S1] (p. 4 · 12. Liability)\ncap" in m[0].content and m[-1].content == "q2"
    assert [x.content for x in rows[min(rows)]] == ["SYSTEM", "q1"]


def test_records(spark):
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "id string, updated_at int, body string")
    change = spark.createDataFrame([("a", 1, "new"), ("b", 4, "old"), ("c", 2, "z")], "id string, updated_at int, body string")
    merged = records.upsert(stored, change)
    assert {r.id: r.body for r in merged.collect()} == {"a": "new", "b": "y", "c": "z"}
    assert [r.id for r in records.newest_first(records.delete(merged, spark.createDataFrame([("c",)], ["id"]))).collect()] == ["b", "a"]
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    sealed = records.seal(merged, key)
    assert {r.id: r.body for r in records.open_sealed(sealed, "body string", key).collect()} == {"a": "new", "b": "y", "c": "z"}
    assert records.open_sealed(sealed, "body string", other).count() == 0
    assert records.open_sealed(sealed, "body string", None).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  hello  ")
    (tmp_path / "B.MD").write_bytes(b"bad \xff byte")
    (tmp_path / "c.exe").write_text("x")
    (tmp_path / "d.json").write_text("   ")
    docs, rejects = files.read_documents(spark, str(tmp_path))
    assert {r.filename: r.text for r in docs.collect()} == {"a.txt": "hello", "B.MD": "bad � byte"}
    assert {r.filename: r.reason for r in rejects.collect()} == {"c.exe": "unsupported file type", "d.json": "no extractable text"}


@pytest.mark.parametrize("files_per_batch", [1])
def test_streams_equal_batch_over_several_batches(spark, tmp_path, files_per_batch):
    from parchment.streaming import limits
    from parchment.streaming import metrics as stream
    from parchment.streaming.sources import read_files

    rng = random.Random(2)
    hits = sorted((rng.randint(0, 5), rng.randint(0, 4000), i) for i in range(200))
    hits.sort(key=lambda h: (h[1], h[2]))
    source = tmp_path / "in"
    for i in range(4):  # four files in order of time
        part = [(k, at(t), e, json.dumps(EVENT if e % 3 else FEEDBACK)) for k, t, e in hits[i * 50 : i * 50 + 50]]
        spark.createDataFrame(part, "key int, ts timestamp, event_id int, payload string").coalesce(1).write.mode("append").parquet(str(source))
    df = spark.read.parquet(str(source))
    read = lambda: read_files(spark, str(source), df.schema, files_per_batch=files_per_batch)

    out = str(tmp_path / "limit")
    limits.rate_limited(read().drop("payload"), 2, 300, out, f"{out}/checkpoint")
    got = {r.event_id: r.accepted for r in spark.read.parquet(f"{out}/verdicts").collect()}
    assert got == brute_limit(hits, 2, 300)
    batches = [f.name for f in (tmp_path / "limit" / "checkpoint" / "commits").iterdir() if f.name.isdigit()]
    assert len(batches) >= 4 // files_per_batch

    out = str(tmp_path / "quota")
    limited = read().select(F.col("key").alias("user_id"), "ts", "event_id", F.to_date("ts").alias("day"), F.lit(5).alias("daily_messages"))
    limits.take_messages(limited, out, f"{out}/checkpoint")
    accepted = spark.read.parquet(f"{out}/decisions").where("accepted").groupBy("user_id").count().collect()
    assert {r["count"] for r in accepted} == {5}

    out = str(tmp_path / "summary")
    stream.running_summary(read(), f"{out}/t", f"{out}/checkpoint")
    batch = metrics.summary(metrics.accepted(metrics.checked_events(df)))
    assert sorted(map(str, spark.read.parquet(f"{out}/t").collect())) == sorted(map(str, batch.collect()))

    table = str(tmp_path / "periods")
    stream.period_answers(read(), f"{table}/rows", f"{table}/checkpoint", window="1 hour")
    first_hour = sum(1 for _, t, e in hits if t < 3600 and e % 3)
    rows = stream.read_periods(spark, f"{table}/rows").collect()
    assert sum(r.answers for r in rows if r.period == at(0)) == first_hour
    assert sum(r.answers for r in rows) == sum(1 for _, _, e in hits if e % 3)
