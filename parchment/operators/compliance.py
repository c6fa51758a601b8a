"""Checklists against documents: evidence search per requirement, verdicts, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment import dims
from parchment.functions import citations as C
from parchment.functions.text import keyword_text, trimmed
from parchment.operators import search, selection

SOURCES_PER_ITEM = 3
ITEM_TOKENS = 1200


def pick_checklist(question: Column) -> Column:
    """The checklist with most keyword hits in the question, else the default."""
    q = F.lower(F.coalesce(question, F.lit("")))
    hits = [
        F.struct(
            sum((F.contains(q, F.lit(word)).cast("int") for word in words), F.lit(0)).alias("hits"),
            F.lit(-at).alias("order"),
            F.lit(key).alias("key"),
        )
        for at, (key, words) in enumerate(dims.CHECKLIST_WORDS.items())
    ]
    best = F.greatest(*hits)
    return F.when(best["hits"] > 0, best["key"]).otherwise(dims.DEFAULT_CHECKLIST)


def checklist_evidence(chunks: DataFrame, checklist: str, document: str = "doc_id") -> DataFrame:
    """Sources per document and requirement: at most 3 passages and 1,200 tokens each.

    Labels are shared over a document's run, numbered in the order passages were first used.
    Every document is its own index; the requirements are the same small set for all.
    """
    spark = chunks.sparkSession
    items = dims.checklist_items(spark).where(F.col("checklist") == checklist)
    keys = [document, "chunk_idx"]
    indexed = chunks.withColumn("indexed", keyword_text(F.col("section"), F.col("text")))
    found = search.match_queries(
        indexed, items, keys, "item_id", "query", "indexed", scope=(document,), shared=True
    )
    ranked = (
        search.bm25(found)
        .join(F.broadcast(items.select("item_id", "position")), "item_id")
        .join(chunks.select(*keys, "text"), keys)
        .withColumn("search", F.concat_ws("/", F.col(document).cast("string"), "item_id"))
    )
    picked = selection.pick(ranked, "lexical_rank", F.lit(ITEM_TOKENS), "search", SOURCES_PER_ITEM)
    # A document uses at most 24 passages (8 requirements of 3): one exchange serves both windows.
    used = picked.drop("search", "source_id").repartition(document)
    first = F.min(F.struct("position", "lexical_rank")).over(Window.partitionBy(*keys))
    order = Window.partitionBy(document).orderBy("first", "chunk_idx")
    labelled = used.withColumn("first", first).withColumn("source_order", F.dense_rank().over(order)).drop("first")
    return labelled.withColumn("source_id", F.concat(F.lit("S"), F.col("source_order"))).join(
        chunks.select(*keys, "text"), keys
    )


def verify_findings(findings: DataFrame, sources: DataFrame, scope: list[str]) -> DataFrame:
    """Adds ``verdict``, ``problem`` and the re-derived ``source`` to findings.

    A positive status counts only if its quote is in a source and mentions a key term of the
    requirement (``must_mention``). ``sources`` are at most three per finding's scope.
    """
    pools = (
        sources.select(
            *scope,
            F.struct(
                F.col("source_order").alias("order"),
                F.col("source_id").alias("id"),
                C.support_form(F.col("text")).alias("form"),
            ).alias("source"),
        )
        .groupBy(*scope)
        .agg(
            F.array_sort(
                F.collect_list("source"),
                lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0),
            ).alias("pool")
        )
    )
    quote = trimmed(F.coalesce("quote", F.lit("")))
    held = (
        findings.join(pools, scope, "left")
        .withColumn("_quote", quote)
        .withColumn(
            "_holder",
            F.try_element_at(F.filter("pool", lambda s: C.supports(s["form"], F.col("_quote"))), F.lit(1))["id"],
        )
    )
    terms = F.coalesce("must_mention", F.array().cast("array<string>"))
    mentions = (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(F.lower("_quote"), t))
    wording = F.concat(
        F.lit("evidence does not mention "),
        F.array_join(F.transform(terms, lambda t: F.concat(F.lit("“"), t, F.lit("”"))), " or "),
    )
    not_found = F.col("status") == "not_found"
    failed = F.col("status") == "error"
    problem = (
        F.when(not_found | failed, F.lit(None).cast("string"))
        .when(F.col("_quote") == "", "no evidence quoted")
        .when(F.col("_holder").isNull(), "quoted evidence not found in the sources")
        .when(~mentions, wording)
    )
    return (
        held.withColumn("problem", problem)
        .withColumn("verdict", F.when(F.col("problem").isNotNull(), "unverified").otherwise(F.col("status")))
        .withColumn(
            "source",
            F.when(not_found, "none")
            .when((F.col("_quote") != "") & F.col("_holder").isNotNull() & ~failed, F.col("_holder"))
            .otherwise(F.col("source")),
        )
        .drop("pool", "_quote", "_holder")
    )


def summary(verdicts: DataFrame, checklist: str, document: str = "doc_id") -> DataFrame:
    """Per document: count per verdict, requirements not run, cited sources and status."""
    items = len([i for i in dims.CHECKLIST_ITEMS if i[0] == checklist])
    backed = F.col("verdict").isin("addressed", "partial")
    counted = verdicts.groupBy(document).agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("addressed", "partial", "not_found", "unverified", "error")],
        F.count("*").alias("checked"),
        # At most one source per requirement.
        F.array_join(F.array_sort(F.collect_set(F.when(backed, F.col("source")))), ",").alias("cited"),
    )
    return counted.withColumn("not_run", F.lit(items) - F.col("checked")).withColumn(
        "status", F.when(F.col("unverified") + F.col("error") > 0, "warning").otherwise("grounded")
    )
