"""Billing webhooks as a stream, kept as mergeable parts of the state.

A batch stores three maxima per subscription and, per checkout reference, the first customer it names. Parts merge
in any order, so late and repeated events need no care, and an event that comes before the checkout which names
its customer is matched once that has come. Every ``FOLD`` batches all parts are folded into one; a read takes
the last fold and what came later, however long the history is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parchment.operators import billing
from parchment.streaming.sources import run_available

FOLD = 16
# Whose key a part has: a checkout names the user, a subscription event the customer.
USER, CUSTOMER = "user", "customer"
_KEYS = ["kind", "key"]


def _parts(events: DataFrame, prefix: str) -> DataFrame:
    checkout = F.col("event_type") == billing.CHECKOUT_EVENT
    known = events.where(checkout | F.col("event_type").isin(billing.SUBSCRIPTION_EVENTS))
    named = known.select(
        "*",
        F.when(checkout, USER).otherwise(CUSTOMER).alias("kind"),
        F.when(checkout, F.col("reference_id").cast("string")).otherwise(F.col("customer_id").cast("string")).alias("key"),
    ).where("key is not null")
    first = F.struct("ts", "event_id", F.col("customer_id").cast("string").alias("customer_id"))
    names = named.where((F.col("kind") == USER) & F.col("customer_id").isNotNull()).groupBy(*_KEYS)
    parts = billing.subscription_parts(named, _KEYS, prefix)
    return parts.unionByName(names.agg(F.min(first).alias("first")), allowMissingColumns=True)


def _merged(parts: DataFrame) -> DataFrame:
    """One row per subscription, and one per user that a checkout names a customer for."""
    names = parts.where("first is not null").groupBy(*_KEYS).agg(F.min("first").alias("first"))
    rest = billing.merge_parts(parts.where("first is null"), _KEYS)
    return rest.unionByName(names, allowMissingColumns=True)


def _stored(spark: SparkSession, out: str, last: int) -> DataFrame:
    """The parts of all batches up to ``last``: the last fold before that batch, and the batches since."""
    folded = last // FOLD * FOLD - 1
    paths = [f"{out}/parts/batch={n}" for n in range(folded + 1, last + 1)]
    return spark.read.parquet(*paths, *([f"{out}/folded/batch={folded}"] if folded >= 0 else []))


def process(events: DataFrame, out: str, checkpoint: str, prefix: str = "") -> StreamingQuery:
    """Keeps checkout and subscription events in ``out`` as parts of the state; ``current_state`` reads it."""
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        _parts(batch, prefix).write.mode("overwrite").parquet(f"{out}/parts/batch={number}")
        if (number + 1) % FOLD == 0:
            _merged(_stored(spark, out, number)).write.mode("overwrite").parquet(f"{out}/folded/batch={number}")

    return run_available(events.writeStream.foreachBatch(write), checkpoint)


def parts(spark: SparkSession, out: str) -> DataFrame:
    """The stored parts that a read needs."""
    last = spark.read.parquet(f"{out}/parts").agg(F.max("batch")).first()[0]
    return _stored(spark, out, last)


def current_state(spark: SparkSession, out: str, users: DataFrame) -> DataFrame:
    """State per user (user_id, customer_id); a user without a customer has that of their first checkout."""
    merged = _merged(parts(spark, out))
    own = users.select("user_id", F.col("user_id").cast("string").alias("user"), F.col("customer_id").cast("string").alias("customer"))
    first = merged.where("first is not null").select(F.col("key").alias("user"), F.col("first.customer_id").alias("named"))
    own = own.join(first, "user", "left").withColumn("customer", F.coalesce("customer", "named"))
    keys = own.select("user_id", F.lit(USER).alias("kind"), F.col("user").alias("key")).unionByName(
        own.where("customer is not null").select("user_id", F.lit(CUSTOMER).alias("kind"), F.col("customer").alias("key"))
    )
    matched = merged.where("first is null").join(keys, _KEYS)
    return billing.state_of(billing.merge_parts(matched, ["user_id"]), "user_id")
