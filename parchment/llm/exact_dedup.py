"""Exact deduplication by skew-safe combining, with DataFrame functions only.

1. Local: the map side of the first aggregate merges equal texts inside a task.
2. Salted: the first shuffle deals a text's local winners over 64 salts by their doc_id.
3. Global: the second shuffle brings the at most 64 salt winners of a text together.

The full normalised text is a grouping key beside its digest in all three, so texts that share a
digest stay apart. A count of sizes and hashes comes first: where the ones that occur more than once are
few enough to be sent to every executor, other texts, which can have no equal, don't enter the shuffles.
The verdict goes back to the rows over (digest, salt): a text with a third of all rows is spread
over 64 keys there too, and no text travels a third time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.common import BROADCAST_KEYS, ascii_lower, checkpoint, drop_rows, salt_of, salt_set, salts_in, text_key

SPREAD = 4096


def _signed(docs: DataFrame, digest) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", text_key(F.coalesce(F.col("text"), F.lit(""))).alias("raw"), norm.alias("norm"))
    return rows.select(
        "doc_id",
        "raw",
        "norm",
        digest(F.col("norm")).alias("digest"),
        # Together with the digest these tell texts apart on the way back, where no text is carried.
        F.octet_length("norm").alias("size"),
        F.xxhash64("norm").alias("mark"),
        salt_of(F.col("doc_id")).alias("salt"),
    )


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def combine(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per distinct text and salt: digest, size, mark, salt, keep_id, group_size. Texts that
    occur once may be absent.

    Raises at run time if two different texts share digest, size and mark.
    """
    sign = ["digest", "size", "mark"]
    rows = _signed(docs, digest)
    twice = checkpoint(rows.groupBy("size", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size", "mark"))
    if twice.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(twice), ["size", "mark"], "left_semi")
    salted = rows.groupBy(*sign, "salt", "norm").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy(*sign, "norm").agg(
        F.max("winner").alias("keep_id"), F.sum("n").alias("group_size"), salt_set("salt").alias("salts")
    )
    # The exchange above is by sign and text; texts that share a sign meet here to be told apart.
    out = merged.select(*sign, "keep_id", "group_size", salts_in("salts").alias("salt"))
    return out.groupBy(*sign, "salt").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")
    ).withColumn(
        "keep_id",
        F.when(F.col("texts") == 1, F.col("keep_id")).otherwise(
            F.raise_error(F.lit("two texts share digest, size and mark")).cast("bigint")
        ),
    ).drop("texts")


def groups(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text): its group of equal texts.

    Columns: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text). Texts are equal
    when identical after lower-casing A-Z. A null text counts as empty; empty texts form one group.
    Of a group the row with the largest doc_id stays; a null doc_id stays only where the group has no
    other. Of rows that repeat doc_id and text alike, one is kept; they are counted per task that reads them,
    so that a third of all rows may be one text without ids. Other columns are not read. An
    empty table gives an empty result.
    """
    return _verdicts(docs, digest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _verdicts(docs: DataFrame, digest) -> DataFrame:
    sign = ["digest", "size", "mark", "salt"]
    rows = _signed(docs, digest)
    if digest is not sha256:
        rows = rows.withColumn("text_sha256", sha256(F.col("norm")))
    own = [*sign, "doc_id", "raw"] + [c for c in rows.columns if c == "text_sha256"]
    # Rows that agree in id and text need no identity, only a number: counted by the task that reads them, the
    # copies of one row are at most SPREAD rows from here on.
    task = F.pmod(F.shiftright(F.monotonically_increasing_id(), 33), F.lit(SPREAD))
    counted = rows.withColumn("task", task).groupBy(*own, "task").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(combine(docs, digest), sign, "left")
    alone = F.col("group_size").isNull()
    joined = joined.withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")))
    joined = joined.withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    first = F.row_number().over(Window.partitionBy(*sign, "doc_id").orderBy("raw", "task")) == 1
    judged = joined.withColumn("first", stays & first).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    sha = F.col("digest") if digest is sha256 else F.col("text_sha256")
    return judged.withColumn("kept", F.col("first") & (F.col("copy") == 1)).withColumn("text_sha256", sha)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    What goes is found on narrow rows; texts move only where more rows go than can be sent to every
    executor.
    """
    rows = _verdicts(docs, sha256).groupBy(F.col("doc_id").alias("key_id"), F.col("raw").alias("key_text"))
    found = checkpoint(rows.agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    return drop_rows(docs, found.where("kept = 0"), found.where("kept > 0 and n > 1"))
