"""Conversation histories: previous question, turn planning, prompt rows, threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.citations import strip_citations
from parchment.functions.text import thread_title, token_estimate
from parchment.operators.scan import carry_last, dense_index

ANSWER_RESERVE = 768
SAFETY_MARGIN = 96
HISTORY_SHARE = 0.25
FURTHER_RESERVE = 40
HISTORY_TURNS = {"search": 2, "summary": 0}
TURNS_PER_BLOCK = 1024


def previous_question(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Adds ``previous_question``: the latest user text before this turn.

    For an answer that is the question it answers. Windows run inside blocks of turns, so one
    endless conversation does not end up in one task.
    """
    asked = F.when(F.col(role) == "user", F.col(text))
    return carry_last(
        turns, [conversation], [turn], asked, "previous_question", F.floor(F.col(turn) / TURNS_PER_BLOCK), before=True
    )


def plan_turns(
    turns: DataFrame,
    context_window: int,
    system_tokens: int,
    with_document: bool = True,
    mode: str = "search",
    conversation: str = "conv_id",
    turn: str = "turn",
) -> tuple[DataFrame, DataFrame]:
    """(plan per user turn, kept turns of each plan): every question with the turns before it, newest first,
    as far as its budget goes. The plan's ``turn`` is the question's, and so is that of a kept turn.

    Turns need ``role``, ``text`` and may have ``error`` and ``abstained``; turns without text or number are
    passed over. A kept turn costs at least five tokens, so a question looks back on no more than
    ``context_window / 5`` of them. Places along a conversation are dense numbers; questions meet the costs before
    them in blocks of those, into which the last turns of the block before are copied, so a conversation with
    most of all turns is spread. Texts of kept turns are looked up by their place.
    """
    usable = (F.coalesce(F.col("text"), F.lit("")) != "") & F.col(turn).isNotNull()
    for flag in ("error", "abstained"):
        if flag in turns.columns:
            usable = usable & ~F.coalesce(F.col(flag), F.lit(False))
    cleaned = turns.where(usable).select(
        conversation,
        turn,
        "role",
        F.when(F.col("role") == "assistant", strip_citations(F.col("text"))).otherwise(F.col("text")).alias("text"),
    )
    placed = dense_index(cleaned, [conversation], [turn, "role", "text"], "at", F.floor(F.col(turn) / TURNS_PER_BLOCK))
    most = HISTORY_TURNS.get(mode, 2) if with_document else context_window // 5
    size = max(TURNS_PER_BLOCK, most)
    tokens = token_estimate(F.col("text"))
    question = F.when(F.col("role") == "user", F.col("text"))
    rows = placed.select(conversation, turn, "at", F.floor(F.col("at") / size).alias("block"), tokens.alias("tokens"), question.alias("question"))
    if most:
        borders = rows.where(F.col("at") % size >= size - most).withColumn("block", F.col("block") + 1)
        rows = rows.unionByName(borders.withColumn("question", F.lit(None).cast("string")))
        before = Window.partitionBy(conversation, "block").orderBy("at").rowsBetween(-most, -1)
        costs = F.reverse(F.collect_list(F.col("tokens") + 4).over(before))
    else:
        costs = F.array().cast("array<int>")
    budget = F.lit(context_window - ANSWER_RESERVE - SAFETY_MARGIN - system_tokens) - F.col("tokens")
    history_budget = F.floor(budget * HISTORY_SHARE) if with_document else budget

    def step(state: Column, cost: Column) -> Column:
        # Costs are positive: at the first misfit the sum stays beyond the budget.
        spent = state["spent"] + cost
        fits = spent <= history_budget
        return F.struct(
            spent.alias("spent"),
            (state["n"] + fits.cast("int")).alias("n"),
            F.when(fits, spent).otherwise(state["used"]).alias("used"),
        )

    start = F.struct(F.lit(0).alias("spent"), F.lit(0).alias("n"), F.lit(0).alias("used"))
    planned = (
        rows.withColumn("costs", costs)
        .where(F.col("question").isNotNull())
        .withColumn("held", F.aggregate("costs", start, step))
        .withColumn("budget", budget)
    )
    left = F.col("budget") - F.col("held.used") - FURTHER_RESERVE
    plan = planned.select(
        conversation,
        turn,
        "at",
        "question",
        "budget",
        F.col("held.n").alias("kept_turns"),
        (F.col("at") - F.col("held.n")).alias("dropped_turns"),
        F.greatest(F.lit(0), left).alias("source_budget"),
        (F.col("budget") < 0).alias("too_long"),
    )
    wanted = plan.where("kept_turns > 0").select(conversation, turn, "at", F.explode(F.sequence(F.lit(1), "kept_turns")).alias("age"))
    wanted = wanted.withColumn("at", F.col("at") - F.col("age"))
    kept = wanted.join(placed.select(conversation, "at", "role", "text"), [conversation, "at"]).drop("at")
    return plan.drop("at"), kept


def source_block(source_id: Column, file: Column, page: Column, section: Column, text: Column) -> Column:
    where = F.concat_ws(" · ", file, F.concat(F.lit("p. "), page), section)
    return F.concat(F.lit("["), source_id, F.lit("] ("), where, F.lit(")\n"), text)


def examples_block(examples: Column, heading: Column) -> Column:
    """Text of approved answers (array of question/answer); empty without any."""
    shown = F.array_join(
        F.transform(examples, lambda e: F.concat(F.lit("Q: "), e["question"], F.lit("\nA: "), e["answer"])), "\n\n"
    )
    return F.when(
        F.size(examples) > 0, F.concat(F.lit("\n\n"), heading, F.lit("\n\n"), shown, F.lit("\n\nEND OF EXAMPLES"))
    ).otherwise("")


def prompt_table(
    plan: DataFrame,
    kept: DataFrame,
    sources: DataFrame | None,
    system: str,
    conversation: str = "conv_id",
    examples: Column | None = None,
    turn: str = "turn",
) -> DataFrame:
    """One row per planned question: system text with sources, kept turns oldest first, question.

    ``sources`` (conversation, turn, source_order, block) were picked under the plan's ``source_budget``. Gathers
    at most the kept turns and the picked sources of a question, both budgeted.
    """
    keys = [conversation, turn]
    history = kept.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("at"), "role", "text"))),
            lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")),
        ).alias("history")
    )
    rows = plan.where(~F.col("too_long")).join(history, keys, "left")
    system_text = F.lit(system)
    if examples is not None:
        system_text = F.concat(system_text, examples)
    if sources is not None:
        blocks = sources.groupBy(*keys).agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("source_order", "block"))), lambda b: b["block"]), "\n\n"
            ).alias("blocks")
        )
        rows = rows.join(blocks, keys, "left")
        system_text = F.concat(
            system_text,
            F.when(
                F.col("blocks").isNotNull(),
                F.concat(F.lit("\n\nSOURCES:\n\n"), F.col("blocks"), F.lit("\n\nEND OF SOURCES")),
            ).otherwise(""),
        )
    message = "array<struct<role:string,content:string>>"
    return rows.select(
        *keys,
        F.concat(
            F.array(F.struct(F.lit("system").alias("role"), system_text.alias("content"))),
            F.coalesce("history", F.array().cast(message)),
            F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))),
        ).alias("messages"),
        "source_budget",
    )


def latest_threads(threads: DataFrame, default_workspace: str, owner: list[str] | None = None) -> DataFrame:
    """Newest thread per workspace. Needs ``id``, ``workspace``, ``updated_at`` and ``first_message``."""
    keys = [*(owner or []), "workspace"]
    named = threads.withColumn("workspace", F.coalesce("workspace", F.lit(default_workspace)))
    newest = Window.partitionBy(*keys).orderBy(F.desc("updated_at"), F.desc("id"))
    return (
        named.withColumn("n", F.row_number().over(newest))
        .where("n = 1")
        .withColumn("title", thread_title(F.col("first_message")))
        .drop("n")
    )


def delete_threads(turns: DataFrame, removed: DataFrame, key: str = "conv_id") -> DataFrame:
    return turns.join(removed.select(key).distinct(), key, "left_anti")
