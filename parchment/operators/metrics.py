"""Anonymous usage events: building, validation, summaries. Batch and stream share these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment import dims

EVENT_SCHEMA = (
    "kind string, intent string, status string, issues array<string>, rating string, reasons array<string>, "
    "model string, registry_version string, latency_ms bigint, tokens_per_sec double"
)
EVENT_FIELDS = [f.split()[0] for f in EVENT_SCHEMA.split(", ")]
MAX_LATENCY = 3_600_000
MAX_SPEED = 10_000.0
MAX_ISSUES = 8
MAX_REASONS = 6
MODEL_ID = r"^[A-Za-z0-9._-]{1,64}\z"
VERSION_ID = r"^[0-9a-f]{12}\z"


def build_events(messages: DataFrame, registry_version: str) -> DataFrame:
    """Events from message metadata: unknown enums to defaults, lists cut, numbers clamped.

    Needs kind, intent, has_document, status, issues, model, latency, speed, rating, reasons.
    """
    intent = F.coalesce("intent", F.when(F.col("has_document"), "qa").otherwise("chat"))
    status = F.coalesce("status", F.lit("none"))
    model = F.substring(F.regexp_replace(F.coalesce("model", F.lit("unknown")), "[^A-Za-z0-9._-]", ""), 1, 64)
    feedback = F.col("kind") == "feedback"
    return messages.withColumns(
        {
            "intent": F.when(intent.isin(dims.INTENTS), intent).otherwise("chat"),
            "status": F.when(status.isin(dims.STATUSES), status).otherwise("none"),
            "issues": F.slice(F.array_distinct(F.coalesce("issues", F.array().cast("array<string>"))), 1, MAX_ISSUES),
            "model": F.when(model == "", "unknown").otherwise(model),
            "registry_version": F.lit(registry_version),
            "latency_ms": F.greatest(
                F.lit(0), F.least(F.lit(MAX_LATENCY), F.floor(F.col("latency") + 0.5))
            ).cast("long"),
            "tokens_per_sec": F.when(
                F.col("speed").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(MAX_SPEED), F.col("speed")))
            ),
            "rating": F.when(feedback, F.col("rating")),
            "reasons": F.when(feedback, F.slice(F.coalesce("reasons", F.array().cast("array<string>")), 1, MAX_REASONS)).otherwise(F.array().cast("array<string>")),
        }
    ).drop("has_document", "latency", "speed")


def _fields(payload: str) -> Column:
    """A JSON object as its fields by name, each a variant; null for anything else."""
    return F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")


def _typed(fields: Column) -> Column:
    """The event's fields, null where the value has not the field's type, and the JSON type of each
    (null: absent, VOID: an explicit null)."""
    values, kinds = [], []
    for field in EVENT_SCHEMA.split(", "):
        name, want = field.split(" ")
        v = fields[name]
        kind = F.schema_of_variant(v)
        if want == "string":
            value = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        elif want.startswith("array"):
            value = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", want))
        else:
            number = F.when(~kind.rlike("^(ARRAY|OBJECT|VOID)"), F.try_variant_get(v, "$", "double"))
            # Whole numbers may be written as 5.0.
            value = number if want == "double" else F.when(number == F.floor(number), number.cast("bigint"))
        values.append(value.alias(name))
        kinds.append(kind.alias(name))
    return F.struct(F.struct(*values).alias("event"), F.struct(*kinds).alias("kinds"), F.map_keys(fields).alias("keys"))


def _problem(event: Column, kinds: Column, keys: Column) -> Column:
    """First rule an event breaks, or null. Fields with a default may be absent, but what is there must
    have its type; null is a value of ``rating`` and ``tokens_per_sec`` only."""
    absent = lambda f: kinds[f].isNull()
    open_ = lambda f: absent(f) | (kinds[f] == "VOID")
    holds = lambda ok: F.coalesce(ok, F.lit(False))
    in_list = lambda c, allowed: F.forall(c, lambda v: holds(v.isin(allowed)))
    unknown = F.size(F.array_except(keys, F.array(*[F.lit(f) for f in EVENT_FIELDS]))) > 0
    required = event["kind"].isin(dims.KINDS)
    rules = [
        (keys.isNull(), "not an object"),
        (unknown, "unknown field"),
        (~F.coalesce(required, F.lit(False)), "kind"),
        (~F.coalesce(event["intent"].isin(dims.INTENTS), F.lit(False)), "intent"),
        (~(absent("status") | holds(event["status"].isin(dims.STATUSES))), "status"),
        (~(absent("issues") | holds((F.size(event["issues"]) <= MAX_ISSUES) & in_list(event["issues"], dims.ISSUE_KINDS))), "issues"),
        (~(open_("rating") | holds(event["rating"].isin(dims.RATINGS))), "rating"),
        (~(absent("reasons") | holds((F.size(event["reasons"]) <= MAX_REASONS) & in_list(event["reasons"], dims.REASONS))), "reasons"),
        (~F.coalesce(event["model"].rlike(MODEL_ID), F.lit(False)), "model"),
        (~F.coalesce(event["registry_version"].rlike(VERSION_ID), F.lit(False)), "registry_version"),
        (~F.coalesce(event["latency_ms"].between(0, MAX_LATENCY), F.lit(False)), "latency_ms"),
        (~(open_("tokens_per_sec") | holds(event["tokens_per_sec"].between(0, MAX_SPEED))), "tokens_per_sec"),
    ]
    out = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return out


def checked_events(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Parsed events with ``problem`` (null when accepted). Narrow, so it serves streams as well."""
    # Generated, not projected: the optimiser would otherwise repeat the parsing for every field, and the
    # fields for every rule that refers to them.
    others = [c for c in raw.columns if c != payload]
    read = raw.select(*others, F.explode_outer(F.array(_fields(payload))).alias("_fields"))
    parsed = read.select(*others, F.explode_outer(F.array(_typed(F.col("_fields")))).alias("_parsed"))
    return (
        parsed.withColumn("event", F.col("_parsed.event"))
        .withColumn("problem", _problem(F.col("_parsed.event"), F.col("_parsed.kinds"), F.col("_parsed.keys")))
        .drop("_parsed")
    )


def accepted(checked: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return (
        checked.where(F.col("problem").isNull())
        .select(*[c for c in checked.columns if c not in ("event", "problem")], "event.*")
        .withColumns(
            {
                "status": F.coalesce("status", F.lit("none")),
                "issues": F.coalesce("issues", empty),
                "reasons": F.coalesce("reasons", empty),
            }
        )
    )


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("problem").isNotNull()).drop("event")


def answers_by_intent(events: DataFrame) -> DataFrame:
    return (
        events.where(F.col("kind") == "answer")
        .groupBy("intent", "status")
        .agg(F.count("*").alias("answers"), F.avg("latency_ms").cast("long").alias("avg_latency_ms"))
    )


def ratings_by_intent(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind") == "feedback").groupBy("intent", "rating").agg(F.count("*").alias("ratings"))


def down_reasons(events: DataFrame) -> DataFrame:
    rows = events.where((F.col("kind") == "feedback") & (F.col("rating") == "down"))
    return rows.select(F.explode("reasons").alias("reason")).where("reason != ''").groupBy("reason").agg(F.count("*").alias("n"))


def issue_counts(events: DataFrame) -> DataFrame:
    rows = events.where(F.col("kind") == "answer").select(F.explode("issues").alias("issue"))
    return rows.where("issue != ''").groupBy("issue").agg(F.count("*").alias("n"))


def summary(events: DataFrame) -> DataFrame:
    """Every figure of the summary in one pass: (section, intent, item, n, avg_latency_ms).

    Each event is spread over the figures it counts for, at most 16 small rows that combine before
    the shuffle, so the event table is read once.
    """
    null = F.lit(None).cast("string")
    line = lambda section, intent, item: F.struct(
        F.lit(section).alias("section"), intent.alias("intent"), item.alias("item")
    )
    answer = F.col("kind") == "answer"
    down = (F.col("kind") == "feedback") & (F.col("rating") == "down")
    none = F.array().cast("array<struct<section:string,intent:string,item:string>>")
    lines = F.concat(
        F.array(line("events", null, null)),
        F.when(answer, F.array(line("answers", F.col("intent"), F.col("status")))).otherwise(none),
        F.when(F.col("kind") == "feedback", F.array(line("feedback", F.col("intent"), F.col("rating")))).otherwise(none),
        F.when(down, F.transform("reasons", lambda r: line("down_reasons", null, r))).otherwise(none),
        F.when(answer, F.transform("issues", lambda i: line("issues", null, i))).otherwise(none),
    )
    return (
        events.select("latency_ms", F.explode(lines).alias("l"))
        .groupBy("l.section", "l.intent", "l.item")
        .agg(F.count("*").alias("n"), F.avg("latency_ms").cast("long").alias("avg"))
        .select(
            "section", "intent", "item", "n", F.when(F.col("section") == "answers", F.col("avg")).alias("avg_latency_ms")
        )
    )
