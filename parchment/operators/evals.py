"""Evaluation jobs: retrieval recall, routing, extraction, answers, compliance, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_recall(gold: DataFrame, sources: DataFrame, query_id: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(totals, misses): does any selected source hold the question's ``gold`` passage?"""
    hits = (
        gold.select(query_id, "gold")
        .join(sources.select(query_id, "text"), query_id)
        .groupBy(query_id)
        .agg(F.max(F.contains("text", F.col("gold"))).alias("hit"))
    )
    judged = gold.join(hits, query_id, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    totals = judged.agg(
        F.count("*").alias("questions"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("recall")
    )
    return totals, judged.where(~F.col("hit")).select(query_id)


def routing(routed: DataFrame, expected: str = "expected") -> tuple[DataFrame, DataFrame]:
    """(totals, document questions routed ``general``); the second must be empty."""
    totals = routed.agg(
        F.count("*").alias("questions"), F.count_if(F.col("intent") == F.col(expected)).alias("correct")
    )
    return totals, routed.where((F.col("intent") == "general") & (F.col(expected) != "general"))


def extraction_recall(expected: DataFrame, found: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(found, missing) expected values per question; ``expected`` holds ``expect_values`` arrays."""
    wanted = expected.select(*scope, F.explode("expect_values").alias("value")).distinct()
    values = found.select(*scope, "value").distinct()
    on = [*scope, "value"]
    return wanted.join(values, on, "left_semi"), wanted.join(values, on, "left_anti")


def score_answers(answers: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """Adds ``correct`` (an expected text, not abstained), ``grounded`` and ``leaked`` markers."""
    said = F.lower("answer")
    known = F.exists("expect", lambda e: F.contains(said, F.lower(e)))
    marks = F.array(*[F.lit(m) for m in markers]) if markers else F.array().cast("array<string>")
    return answers.withColumns(
        {
            "correct": known & (F.col("status") != "abstained"),
            "grounded": F.col("status") == "grounded",
            "leaked": F.filter(marks, lambda m: F.contains("answer", m)),
        }
    )


def answer_totals(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("answers"),
        F.count_if("correct").alias("correct"),
        F.count_if("grounded").alias("grounded"),
        F.count_if(F.size("leaked") > 0).alias("leaked"),
    )


def unrelated_handled(answers: DataFrame) -> DataFrame:
    """Unrelated questions count as handled when routed ``general`` or not presented as grounded."""
    return answers.withColumn("ok", (F.col("intent") == "general") | ~F.col("status").eqNullSafe(F.lit("grounded")))


def compliance_scores(key: DataFrame, verdicts: DataFrame, scope: list[str]) -> DataFrame:
    """Adds ``ok`` and ``false_positive`` to an answer key (scope, item_id, truth).

    A failed or missing check is never correct.
    """
    joined = key.join(verdicts.select(*scope, "item_id", "verdict"), [*scope, "item_id"], "left")
    positive = F.coalesce(F.col("verdict").isin("addressed", "partial"), F.lit(False))
    negative = F.coalesce(F.col("verdict").isin("not_found", "unverified"), F.lit(False))
    present = F.col("truth") == "present"
    return joined.withColumn("ok", F.when(present, positive).otherwise(negative)).withColumn(
        "false_positive", ~present & positive
    )


def regressions(scores: DataFrame, baseline: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Metrics under their recorded baseline; empty when the gate passes."""
    recorded = baseline.select(metric, F.col(value).alias("recorded"))
    return scores.join(recorded, metric).where(F.col(value) < F.col("recorded"))
