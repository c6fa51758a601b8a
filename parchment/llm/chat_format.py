"""Chat formatting by perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and
all others as named users; the mask covers what the assistant says. A dialogue is rendered in parts
of ``PART`` turns, so no row gathers a whole conversation however long it is; the parts of a perspective,
joined in order, are the whole text, and ``offset`` says where a part begins in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.operators.scan import dense_index

PART = 64
# The marks around a message.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """The text with its own marks broken up, so that no message can open or close another."""
    broken = F.replace(text, F.lit(OPEN), F.lit("<| im_start|>"))
    return F.replace(broken, F.lit(CLOSE), F.lit("<| im_end|>"))


def perspectives(turns: DataFrame, part: int = PART) -> DataFrame:
    """One row per conversation, participant and part of ``turns`` (conv_id, turn, role, text).

    Columns: conv_id, perspective (the participant), part (from 0), n_turns, offset (characters of the same
    rendering in earlier parts), text (the rendered part), mask (start and end, in characters of ``text``,
    of every stretch to be learned: what the assistant says and the mark that ends it). The speaker is ``role``;
    a null or empty role is the participant "unknown". A message reads OPEN role, for users a blank
    and "name=" with the speaker's name, line end, text, CLOSE, line end. Messages stand in the order of
    turn (null first), ties by speaker and text; a null text is empty; repeated rows are repeated messages; a null
    conv_id is a conversation of its own. Other columns are not read; an empty table gives an empty result.
    """
    speaker = F.when(F.coalesce("role", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("role"))
    rows = turns.select(
        # Joins pass over null keys, so the key is a text that is never null.
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        "conv_id",
        "turn",
        _plain(F.regexp_replace(speaker, r"[\r\n]", " ")).alias("who"),
        _plain(F.coalesce("text", F.lit(""))).alias("text"),
    )
    # Blocks of turns are numbered first, so that a long conversation is not sorted in one task.
    block = F.coalesce(F.floor(F.col("turn") / part).cast("long"), F.lit(-(1 << 62)))
    placed = dense_index(rows, ["key"], ["turn", "who", "text"], "at", block)
    parts = (
        placed.withColumn("part", F.floor(F.col("at") / part).cast("long"))
        .groupBy("key", "part")
        .agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("at", "who", "text"))).alias("said"))
    )
    people = rows.select("key", F.col("who").alias("perspective")).distinct()
    each = parts.join(people, "key")

    def own(m: Column) -> Column:
        return m["who"] == F.col("perspective")

    def head(m: Column) -> Column:
        user = F.concat(F.lit(f"{OPEN}user name="), m["who"], F.lit("\n"))
        return F.when(own(m), F.lit(f"{OPEN}assistant\n")).otherwise(user)

    message = F.transform("said", lambda m: F.concat(head(m), m["text"], F.lit(f"{CLOSE}\n")))
    # Ends of the messages, then start and end of what the assistant says.
    sizes = F.transform("messages", lambda m: F.char_length(m))
    ends = F.aggregate(
        "sizes",
        F.expr("cast(array(0) as array<int>)"),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )
    spans = F.expr(
        "transform(filter(sequence(0, size(said) - 1), i -> said[i].who = perspective), "
        f"i -> named_struct('start', ends[i] + {len(OPEN) + len('assistant') + 1}, 'end', ends[i + 1] - 1))"
    )
    made = each.withColumn("messages", message).withColumn("sizes", sizes).withColumn("ends", ends)
    made = made.select(
        "conv_id",
        "key",
        "perspective",
        "part",
        F.size("said").cast("long").alias("n_turns"),
        F.element_at("ends", -1).cast("long").alias("size"),
        F.array_join("messages", "").alias("text"),
        spans.alias("mask"),
    )
    # Sizes of parts only, not their texts, are summed along the conversation.
    narrow = made.select("key", "perspective", "part", "size")
    before = Window.partitionBy("key", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = narrow.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long")).drop("size")
    out = made.join(offsets, ["key", "perspective", "part"])
    return out.select("conv_id", "perspective", "part", "n_turns", "offset", "text", "mask")


def with_digest(parts: DataFrame) -> DataFrame:
    """``perspectives`` with text and mask as one text each, for comparison."""
    mask = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return parts.withColumn("mask", mask)
