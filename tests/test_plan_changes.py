"""Quotas under plans that change during the day, against a walk over lists."""

import random

from pyspark.sql import functions as F

from parchment import dims
from parchment.operators import billing, quota


def test_refusals_do_not_count_after_an_upgrade(spark):
    rows = [(1, 1, "2024-01-01 10:00:00"), (2, 1, "2024-01-01 10:01:00"), (3, 1, "2024-01-01 10:02:00"), (4, 1, "2024-01-01 12:00:00"), (5, 1, "2024-01-01 12:00:01"), (6, 1, "2024-01-01 12:00:02")]
    sent = spark.createDataFrame(rows, "event_id int, user_id int, ts string").withColumn("day", F.to_date("ts")).withColumn("daily_messages", F.lit(1))
    changes = spark.createDataFrame([(9, 1, "2024-01-01 12:00:00", 3)], "event_id int, user_id int, ts string, daily_messages int")
    got = {r.event_id: (r.accepted, r.used) for r in quota.take_messages(quota.limits_in_force(sent, changes), since="since").collect()}
    assert got == {1: (True, 1), 2: (False, 1), 3: (False, 1), 4: (True, 2), 5: (True, 3), 6: (False, 3)}


def test_a_hot_user_and_many_changes(spark):
    rng = random.Random(4)
    times = sorted(rng.sample(range(3 * 86_400), 900))
    sent = [(k, 1 if k % 2 else rng.randint(2, 6), t) for k, t in enumerate(times)]
    changes = [(10_000 + k, rng.randint(1, 6), rng.randrange(3 * 86_400), rng.choice([0, 2, 5, 40, None])) for k in range(60)]
    changes += [(20_000, 1, times[11], 7), (20_001, 1, times[11], 3)]
    stamp = F.timestamp_seconds(F.col("at") + 1_704_067_200)
    s = spark.createDataFrame(sent, "event_id int, user_id int, at long").withColumn("ts", stamp).withColumn("day", F.to_date("ts")).withColumn("daily_messages", F.lit(4))
    c = spark.createDataFrame(changes, "event_id int, user_id int, at long, daily_messages int").withColumn("ts", stamp)
    earlier = [(1, 0, 2), (3, 1, 1)]
    e = spark.createDataFrame(earlier, "user_id int, d int, messages long").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    got = quota.take_messages(quota.limits_in_force(s, c).drop("at"), earlier=e, since="since").collect()
    used = {(u, d): n for u, d, n in earlier}
    expected = {}
    for event, user, at in sent:
        limit = 4
        for _, u, t, n in sorted(changes, key=lambda r: (r[2], r[0])):
            if u == user and t <= at:
                limit = n
        key = (user, at // 86_400)
        ok = limit is None or used.get(key, 0) < limit
        used[key] = used.get(key, 0) + ok
        expected[event] = (limit, ok, used[key])
    assert {r.event_id: (r.daily_messages, r.accepted, r.used) for r in got} == expected


def test_changes_end_where_the_state_does(spark):
    rng = random.Random(7)
    keys = [f"{p}_{i}ly" for p, i, _ in dims.PRICES] + ["unlisted"]
    rows = [(k, f"2024-01-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:00:00", rng.randint(1, 20), f"s{rng.randint(0, 2)}", rng.choice([*dims.LIVE_STATUSES, "canceled", "unpaid"]), rng.choice(keys)) for k in range(400)]
    s = spark.createDataFrame(rows, "event_id int, ts string, customer_id int, subscription_id string, status string, lookup_key string")
    s = s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("period_end", F.col("ts")).withColumn("cancel_at_period_end", F.lit(False))
    last = billing.plan_changes(s).groupBy("customer_id").agg(F.max_by("plan", F.struct("ts", "event_id")).alias("plan"))
    ended = {r.customer_id: r.plan for r in last.collect()}
    state = {r.customer_id: r.plan for r in billing.subscription_state(s).collect()}
    assert state == {c: ended.get(c, "free") for c in state}
