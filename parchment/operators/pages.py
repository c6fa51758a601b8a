"""Documents to pages, page clean-up, totals, merged sets and replacement by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import trimmed

PAGE_CHARS = 3000


def page_texts(text: Column, size: int = PAGE_CHARS) -> Column:
    """Fixed-width pages of a plain text as an array; empty for an empty text."""
    count = F.ceil(F.length(text) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(1), count), lambda n: F.substring(text, (n - 1) * size + 1, F.lit(size)))
    return F.when(count > 0, cut).otherwise(F.array().cast("array<string>"))


def paginate(documents: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per page, numbered from 1. Narrow: a document's pages come from its own row."""
    pages = documents.select(key, *carry, F.posexplode(page_texts(trimmed(F.col(text)))).alias("pos", "page_text"))
    return pages.select(key, *carry, (F.col("pos") + 1).alias("page"), F.col("page_text").alias("text"))


def clean_page(text: Column) -> Column:
    no_trailing = F.regexp_replace(text, r"[ \t]+\n", "\n")
    return trimmed(F.regexp_replace(no_trailing, r"\n{3,}", "\n\n"))


def document_totals(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages and characters per document; documents without any text are left out."""
    return (
        pages.groupBy(key)
        .agg(F.count("*").alias("page_count"), F.sum(F.length("text")).alias("char_count"))
        .where("char_count > 0")
    )


def rejected_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    empty = F.length(trimmed(F.coalesce(F.col(text), F.lit("")))) == 0
    return documents.where(empty).select(key, F.lit("no extractable text").alias("reason"))


def combine_documents(pages: DataFrame, set_key: str, file: str) -> tuple[DataFrame, DataFrame]:
    """Merges each set's documents: pages keep their own number and gain ``file``.

    A set of one document keeps ``file`` null, so its labels stay short. Returns (pages, sets).
    """
    sets = pages.groupBy(set_key).agg(
        F.count_distinct(file).alias("files"),
        F.count("*").alias("page_count"),
        F.sum(F.length("text")).alias("char_count"),
        F.min(file).alias("only_file"),
    )
    named = sets.withColumn(
        "filename",
        F.when(F.col("files") == 1, F.col("only_file").cast("string")).otherwise(
            F.concat(F.col("files").cast("string"), F.lit(" documents"))
        ),
    ).drop("only_file")
    merged = pages.join(named.select(set_key, "files"), set_key).withColumn(
        "file", F.when(F.col("files") > 1, F.col(file).cast("string"))
    )
    return merged.drop("files"), named


def replace_by_name(kept: DataFrame, added: DataFrame, name: str = "filename") -> DataFrame:
    """Kept documents whose name was not added again, plus the added ones."""
    return kept.join(added.select(name).distinct(), name, "left_anti").unionByName(added)
