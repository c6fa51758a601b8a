"""Ordered scans that survive a hot key.

A plain window puts one key's rows in one task. Here the rows are windowed inside blocks of the
order column, each block is summarised to one row, the summaries are windowed per key, and the
result is joined back. A key with a third of all rows is then spread over its blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.session import broadcast_if_small, stored

# Rows of a key that one task may read in order.
KEY_ROWS = 100_000
# Rows that a task is dealt by key, at most on average.
DEALT_ROWS = 25_000


@dataclass
class ByKey:
    whole: DataFrame  # rows of keys with up to ``KEY_ROWS`` rows, each key in one task
    large: DataFrame | None  # rows of the other keys, where there are any


def by_key(df: DataFrame, keys: list[str]) -> ByKey:
    """Deals rows out by their keys alone, so that every later step by key finds them in place. Keys of many rows
    are told by a count first and left where they are."""
    if not keys:
        return ByKey(df, None)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    found = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("_rows"), F.lit(0)).alias("most")).first()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts * DEALT_ROWS < found["rows"]:
        parts *= 2
    if found["most"] <= KEY_ROWS:
        return ByKey(df.repartition(parts, *keys), None)
    many = stored(sizes.where(F.col("_rows") > KEY_ROWS).select(*[F.col(k).alias(f"_{k}") for k in keys]), "large-keys")
    many = broadcast_if_small(many)
    same = F.lit(True)
    for k in keys:
        same &= df[k].eqNullSafe(many[f"_{k}"])
    return ByKey(df.join(many, same, "left_anti").repartition(parts, *keys), df.join(many, same, "left_semi"))


def carry_last(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    block: Column,
    before: bool = False,
) -> DataFrame:
    """Adds ``out``: the last non-null ``value`` up to this row, or strictly before it.

    ``block`` must not decrease along ``order`` within a key.
    """
    tagged = df.withColumn("_block", block).withColumn("_value", value)
    blocks = (
        tagged.where(F.col("_value").isNotNull())
        .groupBy(*keys, "_block")
        .agg(F.max_by("_value", F.struct(*order)).alias("_end"))
    )
    # A block's incoming value is the ending value of the nearest earlier block that has one.
    all_blocks = tagged.groupBy(*keys, "_block").agg(F.lit(1).alias("_one"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    incoming = (
        all_blocks.join(blocks, [*keys, "_block"], "left")
        .withColumn("_incoming", F.last("_end", ignorenulls=True).over(earlier))
        .select(*keys, "_block", "_incoming")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = tagged.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    return (
        local.join(incoming, [*keys, "_block"])
        .withColumn(out, F.coalesce("_local", "_incoming"))
        .drop("_block", "_value", "_local", "_incoming")
    )


def carry_last_by_key(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    block: Column,
    before: bool = False,
) -> DataFrame:
    """``carry_last`` for wide rows: they are moved once, by their keys alone; only those of large keys are scanned
    in blocks."""
    dealt = by_key(df.withColumn("_carried", value), keys)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    named = dealt.whole.where(block.isNotNull())
    for k in keys:
        named = named.where(F.col(k).isNotNull())
    carried = named.withColumn(out, F.last("_carried", ignorenulls=True).over(inside)).drop("_carried")
    if dealt.large is None:
        return carried
    in_blocks = carry_last(dealt.large, keys, order, F.col("_carried"), out, block, before).drop("_carried")
    return carried.unionByName(in_blocks)


def dense_index(df: DataFrame, keys: list[str], order: list[str], out: str, block: Column) -> DataFrame:
    """Adds ``out``: 0-based position of the row within ``keys`` along ``order``."""
    tagged = df.withColumn("_block", block)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        tagged.withColumn("_pos", F.row_number().over(inside))
        .join(starts, [*keys, "_block"])
        .withColumn(out, (F.col("_start") + F.col("_pos") - 1).cast("long"))
        .drop("_block", "_pos", "_start")
    )
