"""From questions to the sources of their prompts: search, fusion, abstention, fallback sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import is_summary_request, keyword_text, search_text
from parchment.operators import search, selection
from parchment.session import stored


def answer_plan(
    chunks: DataFrame, questions: DataFrame, budget: Column, document: str = "doc_id", query_id: str = "query_id"
) -> tuple[DataFrame, DataFrame]:
    """(mode per question, sources per question) for questions put to one document each.

    A summary request gets an even sample; a question of which no term occurs in a long document
    gets nothing; one without usable passages falls back to the sample. ``budget`` may be a column of
    ``questions``, such as a plan's ``source_budget``. With a column ``previous_question`` a follow-up is
    searched together with it. Passages are read several times: hand in a stored table of them.
    """
    keys = [document, "chunk_idx"]
    previous = F.col("previous_question") if "previous_question" in questions.columns else F.lit(None).cast("string")
    asked = questions.select(
        query_id, document, is_summary_request(F.col("text")).alias("summary"), search_text(F.col("text"), previous).alias("text"), budget.alias("budget")
    )
    indexed = chunks.withColumn("indexed", keyword_text(F.col("section"), F.col("text")))
    queries = asked.select(query_id, document, "text")
    found = search.match_queries(indexed, queries, keys, query_id, text="indexed", scope=(document,))
    sizes = selection.chunk_sizes(chunks, [document])
    cover = search.coverage(found, queries).drop("chunk_count")
    judged = asked.drop("text").join(cover, query_id).join(sizes, document)
    abstain = search.should_abstain(F.lit(False), F.col("query_terms"), F.col("matched_terms"), F.col("n"))
    modes = judged.select(
        query_id,
        document,
        F.when(F.col("summary"), "summary").when(abstain, "abstain").otherwise("search").alias("mode"),
        "budget",
        "n",
        "cost",
    )
    # Some rows per question, from scans of all passages that would else run once per use.
    modes = stored(modes, "question-modes")
    searched = modes.where("mode = 'search'").select(query_id, "budget")
    texts = chunks.select(*keys, "text")
    ranked = search.bm25(found).join(texts, keys).join(searched, query_id)
    picked = selection.pick(ranked, "lexical_rank", F.col("budget"), query_id)
    picked = stored(picked.select(query_id, *keys, "source_id"), "question-passages")
    # Questions that got nothing from the search take an even sample of the document, under their own budget.
    without = modes.where("mode != 'abstain'").join(picked.select(query_id).distinct(), query_id, "left_anti")
    even = selection.spaced(without, [query_id, document, "budget"], F.col("budget")).join(texts, keys)
    sample = selection.pick(even, "chunk_idx", F.col("budget"), query_id, selection.MAX_SUMMARY_SOURCES)
    sample = sample.select(query_id, *keys, "source_id")
    final = modes.join(without.select(query_id, F.lit(True).alias("sampled")), query_id, "left").select(
        query_id,
        document,
        F.when((F.col("mode") == "search") & F.col("sampled"), "sample").otherwise(F.col("mode")).alias("mode"),
    )
    return final, picked.unionByName(sample)
