"""Subscription snapshots to the plan each customer has now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment import dims
from parchment.operators.scan import carry_last

SECONDS_PER_BLOCK = 6 * 3600

SUBSCRIPTION_EVENTS = [
    "customer.subscription.created",
    "customer.subscription.updated",
    "customer.subscription.deleted",
]
CHECKOUT_EVENT = "checkout.session.completed"


def has_live_subscription(subscription: Column, status: Column) -> Column:
    return subscription.isNotNull() & (subscription != "") & F.coalesce(status.isin(dims.LIVE_STATUSES), F.lit(False))


def matched_events(events: DataFrame, users: DataFrame) -> DataFrame:
    """Webhook events with their user: repeats dropped, unknown types ignored.

    Checkout events name the user, subscription events the customer. A user without a customer gets
    the one of the first checkout that names both.
    """
    once = events.dropDuplicates(["event_id"])
    checkout = once.where(F.col("event_type") == CHECKOUT_EVENT).join(
        users.select("user_id"), F.col("reference_id") == F.col("user_id")
    )
    named = checkout.where(F.col("customer_id").isNotNull()).groupBy("user_id")
    first = named.agg(F.min_by("customer_id", F.struct("ts", "event_id")).alias("_first"))
    customers = users.select("user_id", "customer_id").join(first, "user_id", "left")
    customers = customers.select("user_id", F.coalesce("customer_id", "_first").alias("customer_id"))
    changes = once.where(F.col("event_type").isin(SUBSCRIPTION_EVENTS)).join(customers, "customer_id")
    return checkout.unionByName(changes.select(checkout.columns))


def subscription_state(snapshots: DataFrame, prefix: str = "", customer: str = "customer_id") -> DataFrame:
    """State per customer after all snapshots in order of (ts, event_id).

    The rules: a live snapshot sets the state; one that is not live ends the subscription it names
    and is ignored while another one is in force. So the last live snapshot decides, unless its own
    subscription ended later; then, with nothing in force, the customer's last snapshot gives the
    status. That is two levels of maxima, which combine before the shuffle however many snapshots a
    customer has, and arrival order does not matter.
    """
    return state_of(subscription_parts(snapshots, [customer], prefix), customer)


def subscription_parts(snapshots: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """What ``state_of`` needs to know of each subscription: (keys, subscription_id, last_live, last_ended, last).
    Three maxima, so parts of any split of the snapshots can be merged, and repeats don't matter."""
    priced = snapshots.join(F.broadcast(dims.prices(snapshots.sparkSession, prefix)), "lookup_key", "left")
    live = F.coalesce(F.col("status").isin(dims.LIVE_STATUSES), F.lit(False)) & F.col("plan").isNotNull()
    at = F.struct("ts", "event_id")
    body = F.struct(
        at.alias("at"),
        "subscription_id",
        "plan",
        "status",
        "interval",
        "period_end",
        F.coalesce("cancel_at_period_end", F.lit(False)).alias("cancels"),
    )
    return priced.groupBy(*keys, "subscription_id").agg(
        F.max(F.when(live, body)).alias("last_live"),
        F.max(F.when(~live, at)).alias("last_ended"),
        F.max(F.struct(at.alias("at"), "status")).alias("last"),
    )


def merge_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys, "subscription_id").agg(*[F.max(c).alias(c) for c in ("last_live", "last_ended", "last")])


def state_of(per_subscription: DataFrame, customer: str = "customer_id") -> DataFrame:
    """State per customer from one row per customer and subscription."""
    per_customer = per_subscription.groupBy(customer).agg(
        F.max(F.when(F.col("last_live").isNotNull(), F.struct("last_live", "last_ended"))).alias("top"),
        F.max("last").alias("last"),
    )
    current = F.col("top.last_live")
    in_force = current.isNotNull() & (
        F.col("top.last_ended").isNull() | (F.col("top.last_ended") < current["at"])
    )
    pick = lambda field: F.when(in_force, current[field])
    return per_customer.select(
        customer,
        F.when(in_force, current["plan"]).otherwise("free").alias("plan"),
        pick("subscription_id").alias("subscription_id"),
        F.when(in_force, current["status"]).otherwise(F.col("last.status")).alias("status"),
        pick("interval").alias("interval"),
        pick("period_end").alias("renews_at"),
        F.when(in_force, current["cancels"]).otherwise(False).alias("cancel_at_period_end"),
    )


def plan_changes(snapshots: DataFrame, prefix: str = "", customer: str = "customer_id") -> DataFrame:
    """(customer, ts, event_id, plan) of every snapshot after which another plan may hold: each live one sets
    its plan, and one that is not live ends the subscription that was set last, unless it names another.

    The last row of a customer has the plan of ``subscription_state``; customers without a row are on "free".
    """
    priced = snapshots.join(F.broadcast(dims.prices(snapshots.sparkSession, prefix)), "lookup_key", "left")
    live = F.coalesce(F.col("status").isin(dims.LIVE_STATUSES), F.lit(False)) & F.col("plan").isNotNull()
    narrow = priced.select(customer, "ts", "event_id", "subscription_id", F.when(live, F.col("plan")).alias("plan"))
    block = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / SECONDS_PER_BLOCK)
    held = F.when(F.col("plan").isNotNull(), F.struct("subscription_id"))
    seen = carry_last(narrow, [customer], ["ts", "event_id"], held, "held", block, before=True)
    ends = F.col("held").isNotNull() & F.col("subscription_id").eqNullSafe(F.col("held.subscription_id"))
    changes = seen.where(F.col("plan").isNotNull() | ends)
    return changes.select(customer, "ts", "event_id", F.coalesce("plan", F.lit("free")).alias("plan"))
