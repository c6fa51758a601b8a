"""Inputs of the driver queries: the given tables, and texts or events that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment import dims
from parchment.operators.scan import dense_index
from parchment.session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for text work. Where files make fewer splits than there are cores, or splits of too many
    rows (a split of narrow rows holds millions), the rows are dealt out once; otherwise nothing is moved."""
    return _dealt(table(spark, sf_dir, name))


ROWS_PER_TASK = 100_000


def _dealt(df: DataFrame) -> DataFrame:
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def contract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts from orders: one document per customer, one page per order, some with a heading."""
    orders = texts(spark, sf_dir, "orders")
    head = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "1. Urgent Orders\n")
        .when(F.col("o_orderpriority") == "2-HIGH", "Section 2 High Orders\n")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM ORDERS\n")
        .otherwise("")
    )
    body = F.concat(
        F.lit("The Customer shall pay £"),
        F.format_number("o_totalprice", 2),
        F.lit(" within thirty (30) days of "),
        F.date_format("o_orderdate", "d MMMM yyyy"),
        F.lit(". Late sums bear interest at "),
        (F.col("o_custkey") % 7 + 1).cast("string"),
        F.lit(".5% per year after "),
        (F.col("o_orderkey") % 24 + 1).cast("string"),
        F.lit(" months."),
    )
    return orders.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.concat(head, body).alias("text")
    )


def contract_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per order about its own page: some with a wrong sum, label or no label at all."""
    orders = texts(spark, sf_dir, "orders")
    wrong = F.col("o_orderkey") % 5 == 0
    price = F.when(wrong, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    label = F.when(F.col("o_orderkey") % 7 == 0, " [S9]").when(F.col("o_orderkey") % 3 == 0, "").otherwise(" [S1]")
    answer = F.when(
        F.col("o_orderkey") % 11 == 0, F.lit("The document does not mention the amount.")
    ).otherwise(
        F.concat(
            F.lit("The Customer shall pay £"),
            F.format_number(price, 2),
            F.lit(" within thirty (30) days"),
            label,
            F.lit(". Late sums bear interest."),
        )
    )
    return orders.select(
        F.col("o_orderkey").alias("answer_id"),
        answer.alias("answer"),
        F.lit("How much must the Customer pay?").alias("question"),
    )


def contract_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page each answer was given, as its source S1."""
    return contract_pages(spark, sf_dir).select(
        F.col("page").alias("answer_id"), F.lit(1).alias("source_order"), F.lit("S1").alias("source_id"), "text"
    )


def pooled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a nation's customers as the numbered sources of one answer."""
    home = texts(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").cast("long").alias("answer_id"))
    pages = contract_pages(spark, sf_dir).join(home, "doc_id")
    numbered = dense_index(pages, ["answer_id"], ["page"], "place", F.floor(F.col("page") / 100_000))
    order = F.col("place") + 1
    numbered = numbered.select("answer_id", order.alias("source_order"), F.concat(F.lit("S"), order).alias("source_id"), "text")
    return _dealt(stored(numbered, "pooled-sources"))


def pooled_answers(sources: DataFrame) -> DataFrame:
    """One answer per nation: a quote that runs from its first page into the second, the sum of its last
    page (every fifth nation: another one), a quote and a sentence that no page has."""
    facts = sources.groupBy("answer_id").agg(
        F.min_by("text", "source_order").alias("first"),
        F.max(F.when(F.col("source_order") == 2, F.col("text"))).alias("second"),
        F.max_by("text", "source_order").alias("last"),
    )
    months = F.regexp_extract("first", r"after ([0-9]+) months", 1)
    head = F.substring(F.translate(F.coalesce("second", F.lit("")), "\n", " "), 1, 22)
    price = F.when(F.col("answer_id") % 5 == 0, F.lit("9,000,000.00")).otherwise(F.regexp_extract("last", "£([0-9,.]+[0-9])", 1))
    answer = F.concat(
        F.lit('The pages say "per year after '), months, F.lit(" months. "), head, F.lit('" [S1]. The Customer shall pay £'), price,
        F.lit(' in the end. It says "the customer never pays anything at all". Ships sail across seven oceans.'),
    )
    return facts.select("answer_id", answer.alias("answer"), F.lit("How much must the Customer pay?").alias("question"))


def metric_payloads(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as JSON metric events; several kinds of faults by event number."""
    events = texts(spark, sf_dir, "events") if events is None else events
    n = F.col("event_id")

    def one_of(values: list[str], by) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))

    feedback = F.col("event_type") == "click"
    payload = F.struct(
        F.when(feedback, "feedback").otherwise("answer").alias("kind"),
        F.when(n % 11 == 0, "other").otherwise(one_of(dims.INTENTS, n)).alias("intent"),
        one_of(dims.STATUSES, F.col("user_id")).alias("status"),
        F.array(one_of(dims.ISSUE_KINDS, n), one_of(dims.ISSUE_KINDS, F.col("user_id"))).alias("issues"),
        F.when(feedback, one_of(dims.RATINGS, n)).alias("rating"),
        F.when(feedback, F.array(one_of(dims.REASONS, n))).alias("reasons"),
        F.when(n % 13 == 0, "free text here").otherwise(F.concat(F.lit("model-"), F.col("user_id") % 4)).alias("model"),
        F.lit("73b4e0e4f4f4").alias("registry_version"),
        F.floor(F.col("value") * 100).cast("long").alias("latency_ms"),
        F.when(n % 17 == 0, F.lit("text")).alias("question"),
    )
    # Wrong types, an explicit null and a whole number written as a float: only the last is right.
    text = F.to_json(payload)
    for every, pattern, to in (
        (23, r'"status":"[a-z]+"', '"status":null'),
        (19, r'"issues":\[[^\]]*\]', '"issues":"abc"'),
        (29, r"^\{", '{"tokens_per_sec":"fast",'),
        (31, r'"latency_ms":(-?\d+)', '"latency_ms":$1.0'),
    ):
        text = F.when(n % every == 0, F.regexp_replace(text, pattern, to)).otherwise(text)
    return events.select("event_id", "ts", text.alias("payload"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts: plan and user type by market segment and nation."""
    customer = table(spark, sf_dir, "customer")
    plan = F.element_at(
        F.array(*[F.lit(p) for p in ("free", "pro", "business", "enterprise", "trial")]),
        (F.col("c_nationkey") % 5 + 1).cast("int"),
    )
    kind = (
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "personal")
        .when(F.col("c_mktsegment") == "BUILDING", "sme")
        .when(F.col("c_mktsegment") == "MACHINERY", "enterprise")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "founder")
        .otherwise("unknown")
    )
    return customer.select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("display_name"), plan.alias("plan"), kind.alias("user_type")
    )


ZONES = ["Europe/London", "Pacific/Kiritimati", "Pacific/Pago_Pago", "Not/AZone"]


def messages(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as messages of users in four zones, one of them unknown."""
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("user_id") % 4 + 1).cast("int"))
    events = table(spark, sf_dir, "events") if events is None else events
    return events.select("event_id", "ts", "user_id", zone.alias("zone"))


def snapshots(spark: SparkSession, sf_dir: str, prefix: str = "", events: DataFrame | None = None) -> DataFrame:
    """Events as subscription snapshots of their user."""
    n = F.col("event_id")
    status = (
        F.when(F.col("event_type") == "signup", "trialing")
        .when(F.col("event_type") == "purchase", "active")
        .when(F.col("event_type") == "view", "past_due")
        .when(F.col("event_type") == "click", "canceled")
        .otherwise("unpaid")
    )
    keys = [f"{prefix}{p}_{i}ly" for p, i, _ in dims.PRICES] + ["unlisted"]
    key = F.element_at(F.array(*[F.lit(k) for k in keys]), (n % len(keys) + 1).cast("int"))
    events = table(spark, sf_dir, "events") if events is None else events
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("customer_id"),
        F.concat(F.lit("sub_"), F.col("user_id"), F.lit("_"), n % 3).alias("subscription_id"),
        status.alias("status"),
        key.alias("lookup_key"),
        (F.col("ts") + F.expr("interval 30 days")).alias("period_end"),
        (n % 4 == 0).alias("cancel_at_period_end"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and errors as 👍 and 👎 on a user's answers."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error"))
    return rows.select(
        F.concat_ws(":", "user_id", (n % 4).cast("string")).alias("id"),
        "event_id",
        "ts",
        F.when(F.col("event_type") == "click", "up").otherwise("down").alias("rating"),
        F.array(
            F.element_at(F.array(*[F.lit(r) for r in [*dims.REASONS, "bogus"]]), (n % 7 + 1).cast("int"))
        ).alias("reasons"),
        F.when(n % 2 == 0, F.concat(F.lit("  corrected by "), F.col("user_id"), F.lit(" "))).alias("correction"),
        F.when(n % 5 == 0, "extract").otherwise("qa").alias("intent"),
        F.concat(F.lit("question "), n % 4).alias("question"),
        F.concat(F.lit("answer "), F.col("event_id"), F.lit(" [S1].")).alias("answer"),
        F.concat(F.lit("doc"), F.col("user_id") % 3).alias("doc"),
    )


def questions_with_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with the user turn just before them and the labelled quality as rating."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("q_turn"), F.col("text").alias("question"))
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("q_turn"), F.col("text").alias("answer")
    )
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality").distinct()
    return (
        asked.join(answered, ["conv_id", "q_turn"])
        .join(labels, "conv_id", "left")
        .select(
            (F.col("conv_id") * 1000 + F.col("q_turn")).alias("id"),
            "question",
            "answer",
            F.when(F.coalesce("quality", F.lit(1)) == 1, "up").otherwise("down").alias("rating"),
            F.when(F.col("conv_id") % 2 == 0, F.lit("Corrected answer.")).alias("correction"),
            F.lit("qa").alias("intent"),
        )
    )
