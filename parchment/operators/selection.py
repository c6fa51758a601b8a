"""Which passages reach the prompt: budget picks, even samples, extraction batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import bound, passage_cost
from parchment.operators.chunking import document_chunks

MAX_SOURCES = 6
MAX_SUMMARY_SOURCES = 8
POOL = 12
PER_BATCH = 6
BATCH_TOKENS = 2000


def budget_fold(costs: Column, budget: Column, most: int) -> Column:
    """Positions (0-based) taken in order while they fit; what does not fit is skipped, not final."""
    start = F.struct(
        F.array().cast("array<int>").alias("taken"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("at")
    )

    def step(state: Column, cost: Column) -> Column:
        fits = (F.size(state["taken"]) < most) & (state["used"] + cost <= budget)
        return F.struct(
            F.when(fits, F.array_append(state["taken"], state["at"])).otherwise(state["taken"]).alias("taken"),
            F.when(fits, state["used"] + cost).otherwise(state["used"]).cast("long").alias("used"),
            (state["at"] + 1).alias("at"),
        )

    return F.aggregate(costs, start, step, lambda state: state["taken"])


def pick(
    ranked: DataFrame, rank: str, budget: Column, query_id: str = "query_id", most: int = MAX_SOURCES, text: str = "text"
) -> DataFrame:
    """Passages per query in rank order under a token budget: adds ``source_id`` S1, S2, …

    ``ranked`` holds a ranker's candidates (40 per query at most after fusion), so the gathered list
    per query is short. It holds everything but the texts, whose lengths are all the walk needs;
    join them to the result by passage.
    """
    others = [c for c in ranked.columns if c not in (query_id, rank, text)]
    item = F.struct(F.col(rank).alias("rank"), passage_cost(F.col(text)).alias("cost"), F.struct(*others).alias("row"))
    lists = ranked.groupBy(query_id).agg(
        F.array_sort(
            F.collect_list(item),
            lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0),
        ).alias("items"),
        F.first(budget).alias("budget"),
    )
    taken = budget_fold(F.transform("items", lambda i: i["cost"]), F.col("budget"), most)
    return (
        lists.select(query_id, "items", F.posexplode_outer(taken).alias("n", "at"))
        .where(F.col("at").isNotNull())
        .select(query_id, F.get("items", F.col("at")).alias("item"), F.concat(F.lit("S"), F.col("n") + 1).alias("source_id"))
        .select(query_id, F.col("item.rank").alias(rank), "item.row.*", "source_id")
    )


def spread_positions(chunks: DataFrame, scope: list[str], budget: Column, text: str = "text") -> DataFrame:
    """Evenly spaced chunk numbers per scope for a summary: (scope, chunk_idx, position)."""
    return spaced(chunk_sizes(chunks, scope, text), scope, budget)


def chunk_sizes(chunks: DataFrame, scope: list[str], text: str = "text") -> DataFrame:
    """(scope, n, cost): passages and what they cost together."""
    return chunks.groupBy(*scope).agg(F.count("*").alias("n"), F.sum(passage_cost(F.col(text)).cast("long")).alias("cost"))


def spaced(sizes: DataFrame, keys: list[str], budget: Column) -> DataFrame:
    """(keys, chunk_idx) of the evenly spaced passages that about fill ``budget``, from rows with ``n`` and ``cost``."""
    wanted = F.floor(budget / (F.col("cost") / F.col("n")))
    k = F.greatest(F.lit(1), F.least(F.col("n"), F.lit(MAX_SUMMARY_SOURCES), wanted)).cast("int")
    at = F.floor(F.col("i") * (F.col("n") - 1) / F.greatest(F.col("k") - 1, F.lit(1)) + 0.5)
    return (
        sizes.withColumn("k", k)
        .select(*keys, "n", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
        .select(*keys, F.when(F.col("k") == 1, 0).otherwise(at).cast("int").alias("chunk_idx"))
        .distinct()
    )


def select_spread(chunks: DataFrame, scope: list[str], budget: Column, text: str = "text") -> DataFrame:
    """Evenly spread sources per scope in document order, under the budget, labelled S1, S2, …

    At most MAX_SUMMARY_SOURCES passages per scope are gathered, with their texts.
    """
    sample = chunks.join(spread_positions(chunks, scope, budget, text), [*scope, "chunk_idx"])
    others = [c for c in sample.columns if c not in (*scope, "chunk_idx")]
    item = F.struct(
        F.col("chunk_idx").alias("chunk_idx"), passage_cost(F.col(text)).alias("cost"), F.struct(*others).alias("row")
    )
    lists = sample.groupBy(*scope).agg(
        F.array_sort(
            F.collect_list(item),
            lambda a, b: F.when(a["chunk_idx"] < b["chunk_idx"], -1).when(a["chunk_idx"] > b["chunk_idx"], 1).otherwise(0),
        ).alias("items")
    )
    taken = budget_fold(F.transform("items", lambda i: i["cost"]), budget, MAX_SUMMARY_SOURCES)
    return (
        lists.select(*scope, "items", F.posexplode_outer(taken).alias("n", "at"))
        .where(F.col("at").isNotNull())
        .select(*scope, F.get("items", F.col("at")).alias("item"), F.concat(F.lit("S"), F.col("n") + 1).alias("source_id"))
        .select(*scope, "item.chunk_idx", "item.row.*", "source_id")
    )


def spread_documents(documents: DataFrame, budget: Column, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """``select_spread`` for documents in one row per ``key``, each under its own ``budget``: positions are chosen on the array of passages
    before any is made a row, so nothing is shuffled."""

    def positions(chunks: Column) -> Column:
        n = F.size(chunks)
        cost = F.aggregate(chunks, F.lit(0).cast("long"), lambda s, c: s + passage_cost(c["text"]).cast("long"))
        wanted = F.floor(budget / (cost / n))
        k = F.greatest(F.lit(1), F.least(n, F.lit(MAX_SUMMARY_SOURCES), wanted)).cast("int")

        def at(k: Column) -> Column:
            spaced = F.transform(
                F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * (n - 1) / F.greatest(k - 1, F.lit(1)) + 0.5).cast("int")
            )
            return F.when(k == 1, F.array(F.lit(0))).otherwise(F.array_distinct(spaced))

        return bound(k, at)

    def chosen(chunks: Column) -> Column:
        def taken(at: Column) -> Column:
            costs = F.transform(at, lambda p: passage_cost(F.get(chunks, p)["text"]))
            return F.transform(
                budget_fold(costs, budget, MAX_SUMMARY_SOURCES),
                lambda i, n: F.struct(
                    F.get(at, i).alias("chunk_idx"),
                    F.get(chunks, F.get(at, i)).alias("row"),
                    F.concat(F.lit("S"), (n + 1).cast("string")).alias("source_id"),
                ),
            )

        return F.when(F.size(chunks) > 0, bound(positions(chunks), taken))

    keys = [key] if isinstance(key, str) else key
    picked = documents.select(*keys, F.explode_outer(bound(document_chunks(F.col(text)), chosen)).alias("c"))
    return picked.where(F.col("c").isNotNull()).select(*keys, "c.chunk_idx", "c.row.*", "c.source_id")


def rank_for_extraction(
    chunks: DataFrame, ranks: DataFrame, scope: list[str], density: Column, pool: int = POOL
) -> DataFrame:
    """First ``pool`` passages per scope: those with figures first, then by rank, then the rest.

    The pool is a feature: later passages are never read. Each task keeps ``pool`` rows per scope
    before the shuffle.
    """
    ordered = Window.partitionBy(*scope).orderBy(
        F.desc("has_figures"), F.asc_nulls_last("final_rank"), F.asc("chunk_idx")
    )
    return (
        chunks.join(ranks, [*scope, "chunk_idx"], "left")
        .withColumn("has_figures", density > 0)
        .withColumn("position", F.row_number().over(ordered))
        .where(F.col("position") <= pool)
        .drop("has_figures")
    )


def extraction_batches(pooled: DataFrame, scope: list[str], text: str = "text") -> DataFrame:
    """Adds ``source_id`` and a 1-based ``batch`` of at most 6 passages or 2,000 tokens.

    Gathers a scope's pool (12 passages), texts left out.
    """
    others = [c for c in pooled.columns if c not in (*scope, "position", text)]
    start = F.struct(
        F.lit(1).alias("batch"), F.lit(0).alias("held"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out")
    )

    def step(state: Column, cost: Column) -> Column:
        full = (state["held"] >= PER_BATCH) | ((state["held"] > 0) & (state["used"] + cost > BATCH_TOKENS))
        batch = F.when(full, state["batch"] + 1).otherwise(state["batch"])
        return F.struct(
            batch.alias("batch"),
            (F.when(full, 0).otherwise(state["held"]) + 1).alias("held"),
            (F.when(full, 0).otherwise(state["used"]) + cost).alias("used"),
            F.array_append(state["out"], batch).alias("out"),
        )

    item = F.struct("position", passage_cost(F.col(text)).alias("cost"), F.struct(*others).alias("row"))
    lists = pooled.groupBy(*scope).agg(
        F.array_sort(
            F.collect_list(item),
            lambda a, b: F.when(a["position"] < b["position"], -1).when(a["position"] > b["position"], 1).otherwise(0),
        ).alias("items")
    )
    batches = F.aggregate(F.transform("items", lambda i: i["cost"]), start, step, lambda state: state["out"])
    numbered = lists.select(*scope, F.explode(F.zip_with("items", batches, lambda i, b: F.struct(i.alias("i"), b.alias("b")))).alias("x"))
    return numbered.select(
        *scope,
        "x.i.position",
        "x.i.row.*",
        F.col("x.b").alias("batch"),
        F.concat(F.lit("S"), F.col("x.i.position")).alias("source_id"),
    )
