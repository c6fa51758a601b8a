"""Text files in, redacted copies and feedback exports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions.text import trimmed
from parchment.operators.pages import page_texts
from parchment.operators.pii import redact

# Fixed values ---------------------------------------------------------------------------------
MAX_BYTES = 25 * 1024 * 1024
TEXT_EXTENSIONS = ["txt", "md", "csv", "json"]
# ----------------------------------------------------------------------------------------------


def _listed(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", "length", extension.alias("extension"), "content").withColumn(
        "reason",
        F.when(~F.col("extension").isin(TEXT_EXTENSIONS), "unsupported file type").when(
            F.col("length") > MAX_BYTES, "file is too large"
        ),
    )


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of a folder: filename and text, or filename and the reason.

    File names and sizes decide first: the content of a rejected file is never read.
    """
    listed = _listed(spark, path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    text = trimmed(F.make_valid_utf8(F.col("content").cast("string")))
    read = listed.where(F.col("reason").isNull()).select(F.col("path"), name.alias("filename"), text.alias("text"))
    documents = read.where(F.length("text") > 0)
    empty = read.where(F.length("text") == 0).select("filename", F.lit("no extractable text").alias("reason"))
    refused = listed.where(F.col("reason").isNotNull()).select(name.alias("filename"), "reason")
    return documents, refused.unionByName(empty)


def redacted_copies(pages: DataFrame, document: str = "doc_id", file: str | None = None) -> DataFrame:
    """One redacted text per document, pages under ``--- Page n ---`` headers.

    The gathered pages are one document's own text, which its copy has to hold anyway.
    """
    name = F.concat(F.col(file), F.lit(", page")) if file else F.lit("Page")
    block = F.concat(F.lit("--- "), name, F.lit(" "), F.col("page"), F.lit(" ---\n"), redact(F.col("text")))
    parts = pages.select(document, "page", block.alias("block"))
    return parts.groupBy(document).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("page", "block"))), lambda p: p["block"]), "\n\n"
        ).alias("text")
    )


def redacted_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``redacted_copies`` of documents in one row each: pages are cut, redacted and joined in the row."""
    pages = F.transform(
        page_texts(trimmed(F.col(text))),
        lambda page, at: F.concat(F.lit("--- Page "), (at + 1).cast("string"), F.lit(" ---\n"), redact(page)),
    )
    copies = documents.select(key, pages.alias("pages")).where(F.size("pages") > 0)
    return copies.select(key, F.array_join("pages", "\n\n").alias("text"))


def write_redacted_pages(pages: DataFrame, path: str, document: str = "doc_id") -> None:
    """Redacted pages as a table, for documents too large to be one text value."""
    pages.withColumn("text", redact(F.col("text"))).write.mode("overwrite").parquet(path)


def feedback_export(state: DataFrame) -> DataFrame:
    """Records with question, answer and correction redacted, ready for ``write.json``."""
    return state.withColumns({c: redact(F.coalesce(c, F.lit(""))) for c in ("question", "answer", "correction")})
