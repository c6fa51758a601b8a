"""Plans, entitlements, sessions, one-time links, registration checks, erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment import dims

USER_TYPES = dims.USER_TYPES
PASSWORD_LENGTH = (10, 128)
MAX_NAME = 80
EMAIL_FORMAT = r"^[^@\s]+@[^@\s]+\.[^@\s.]+\z"


def entitlements(users: DataFrame, workspaces: dict[str, str] | None = None) -> DataFrame:
    """Users with their plan's limits. Unknown plans count as free; a null user type as personal.

    ``users`` needs ``plan`` and ``user_type``. ``workspaces`` names each user type's workspace
    (default: the type itself). The plan table has five rows.
    """
    names = workspaces or {t: t for t in USER_TYPES}
    mapping = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    default = names[dims.DEFAULT_USER_TYPE]
    chosen = F.coalesce(F.try_element_at(mapping, F.coalesce("user_type", F.lit(""))), F.lit(default))
    known = F.when(F.col("plan").isin("free", "pro", "business", "enterprise"), F.col("plan")).otherwise("free")
    lists = {
        "free": [default],
        "pro": [names[t] for t in dims.BROWSER_TYPES],
        "business": list(names.values()),
        "enterprise": list(names.values()),
    }
    base = F.array(*[F.lit(v) for v in lists["free"]])
    for plan, values in lists.items():
        base = F.when(F.col("plan") == plan, F.array(*[F.lit(v) for v in values])).otherwise(base)
    dimension = dims.plans(users.sparkSession)
    return (
        users.withColumn("plan", known)
        .join(F.broadcast(dimension), "plan", "left")
        .withColumn("workspaces", F.array_distinct(F.array_append(base, chosen)))
    )


def guest_entitlements(users: DataFrame) -> DataFrame:
    return users.withColumn("plan", F.lit("guest")).join(F.broadcast(dims.plans(users.sparkSession)), "plan")


def document_gates(documents: DataFrame, entitled: DataFrame, user: str = "user_id", order: str = "doc_id") -> DataFrame:
    """Adds ``reason`` (null when the document may be attached) to each user's documents.

    Only the number within the first ``max_documents`` matters (20 at most); counting past it needs
    no order, so ranks are cut at that limit before the shuffle.
    """
    most = max(p[3] for p in dims.PLANS if p[3] is not None)
    in_order = Window.partitionBy(user).orderBy(order)
    first = (
        documents.select(user, order)
        .withColumn("number", F.row_number().over(in_order))
        .where(F.col("number") <= most)
    )
    limits = entitled.select(user, "documents", "max_documents", "max_document_pages")
    joined = documents.join(first, [user, order], "left").join(limits, user)
    reason = (
        F.when(~F.col("documents"), "documents need an account")
        .when(
            F.col("max_documents").isNotNull()
            & (F.col("number").isNull() | (F.col("number") > F.col("max_documents"))),
            "too many documents",
        )
        .when(F.col("page_count") > F.col("max_document_pages"), "too many pages")
    )
    return joined.withColumn("reason", reason).drop("number", "documents", "max_documents", "max_document_pages")


def may_use(entitled: DataFrame, workspace: str, large_model: Column, compliance: Column) -> DataFrame:
    """Per user: workspace, model and checklist gates."""
    return entitled.select(
        "*",
        F.array_contains("workspaces", F.lit(workspace)).alias("workspace_allowed"),
        (~large_model | F.col("large_models")).alias("model_allowed"),
        (~compliance | F.col("checklists")).alias("checklist_allowed"),
    )


def valid_sessions(sessions: DataFrame, presented: DataFrame, as_of: Column) -> DataFrame:
    """Presented tokens that match a stored hash and have not expired."""
    hashed = presented.withColumn("token_hash", F.sha2(F.col("token").cast("binary"), 256)).drop("token")
    return hashed.join(sessions.where(F.col("expires_at") > as_of), "token_hash")


def live_links(tokens: DataFrame, as_of: Column, user: str = "user_id") -> DataFrame:
    """The newest token per user and purpose, if unused and unexpired. A maximum, not a sort."""
    newest = tokens.groupBy(user, "purpose").agg(F.max(F.struct("created_at", "token_id")).alias("newest"))
    latest = newest.select(user, "purpose", "newest.token_id")
    live = tokens.where(F.col("used_at").isNull() & (F.col("expires_at") > as_of))
    return live.join(latest, [user, "purpose", "token_id"], "left_semi")


def registration_checks(accounts: DataFrame) -> DataFrame:
    """Adds lower-cased ``email`` and ``problem`` (null when the input is fine)."""
    checked = accounts.withColumn("email", F.lower(F.trim("email")))
    problem = (
        F.when(~F.coalesce(F.col("email").rlike(EMAIL_FORMAT), F.lit(False)), "email")
        .when(~F.coalesce(F.length("password").between(*PASSWORD_LENGTH), F.lit(False)), "password")
        .when(F.length(F.trim("display_name")) > MAX_NAME, "display_name")
        .when(F.col("user_type").isNotNull() & ~F.col("user_type").isin(USER_TYPES), "user_type")
    )
    return checked.withColumn("problem", problem)


def duplicate_emails(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy(F.lower("email").alias("email")).agg(F.count("*").alias("accounts")).where("accounts > 1")


def first_accounts(accounts: DataFrame, order: str = "user_id") -> DataFrame:
    """One account per lower-cased email, the earliest. A minimum per email, then a semi join."""
    first = accounts.groupBy(F.lower("email").alias("_email")).agg(F.min(order).alias(order))
    return accounts.join(first.select(order), order, "left_semi")


def erase_users(removed: DataFrame, tables: dict[str, DataFrame], user: str = "user_id") -> dict[str, DataFrame]:
    """Every dependent table without the removed users' rows."""
    gone = removed.select(user).distinct()
    return {name: table.join(gone, user, "left_anti") for name, table in tables.items()}


def account_summary(entitled: DataFrame, usage_today: DataFrame, user: str = "user_id") -> DataFrame:
    """Profile, plan limits and messages used and left today."""
    used = F.coalesce("messages", F.lit(0))
    return (
        entitled.join(usage_today.select(user, "messages"), user, "left")
        .withColumn("used_today", used)
        .withColumn("left_today", F.when(F.col("daily_messages").isNotNull(), F.greatest(F.lit(0), F.col("daily_messages") - used)))
        .drop("messages")
    )
