"""Pages to passages: blocks between headings, sentences, greedy packing, section tracking.

A whole document in one row is cut without any shuffle. A page table needs one ordered scan over its
pages: their texts are exchanged once, by key and block of pages, never by key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import WS, bound, heading_of_trimmed, sentences_of, trimmed
from parchment.operators.pages import page_texts
from parchment.operators.scan import carry_last_by_key, dense_index

TARGET_CHARS = 900
MAX_CHARS = 1200
OVERLAP_CHARS = 250

_UNIT = "array<struct<text:string,heading:string>>"
_NO_TEXTS = "array<string>"


def _line_starts(paragraph: Column) -> Column:
    """Lines of a paragraph; ``opens`` marks the first line and every heading."""
    lines = F.filter(F.transform(F.split(paragraph, "\n"), trimmed), lambda line: line != "")

    def mark(line: Column, at: Column) -> Column:
        return bound(
            heading_of_trimmed(line),
            lambda found: F.struct(
                line.alias("line"), found.alias("heading"), ((at == 0) | found.isNotNull()).alias("opens")
            ),
        )

    return F.transform(lines, mark)


def _joined_blocks(lines: Column) -> Column:
    # Lines hold no newline any more, so it is free to serve as the block separator.
    joined = F.array_join(
        F.transform(lines, lambda x: F.concat(F.when(x["opens"], F.lit("\n")).otherwise(F.lit(" ")), x["line"])), ""
    )
    texts = F.slice(F.split(joined, "\n"), 2, F.greatest(F.size(lines), F.lit(1)))
    heads = F.filter(lines, lambda x: x["opens"])
    return F.zip_with(texts, heads, lambda t, h: F.struct(t.alias("text"), h["heading"].alias("heading")))


def page_blocks(text: Column) -> Column:
    """Blocks of joined lines, each with the heading it starts with (or null)."""
    lines = F.flatten(F.transform(F.split(text, rf"\n{WS}*\n"), _line_starts))
    return bound(lines, _joined_blocks)


def block_units(blocks: Column) -> Column:
    """Blocks cut to at most MAX_CHARS: whole, by sentence, or hard-wrapped."""

    def cut(block: Column) -> Column:
        pieces = F.when(F.length(block["text"]) > MAX_CHARS, sentences_of(block["text"])).otherwise(
            F.array(block["text"])
        )
        wrapped = F.flatten(
            F.transform(
                pieces,
                lambda piece: F.transform(
                    F.sequence(F.lit(0), F.floor((F.length(piece) - 1) / MAX_CHARS).cast("int")),
                    lambda n: F.substring(piece, n * MAX_CHARS + 1, F.lit(MAX_CHARS)),
                ),
            )
        )
        return F.transform(wrapped, lambda t: F.struct(t.alias("text"), block["heading"].alias("heading")))

    return F.flatten(F.transform(blocks, cut))


def last_heading(blocks: Column) -> Column:
    return F.try_element_at(F.filter(blocks, lambda b: b["heading"].isNotNull()), F.lit(-1))["heading"]


def pack_units(units: Column, section_in: Column) -> Column:
    """Greedy packing of one page's units into passages of one section each."""
    no_texts = F.array().cast(_NO_TEXTS)
    start = F.struct(
        F.array().cast("array<struct<section:string,text:string>>").alias("done"),
        no_texts.alias("open"),
        F.lit(0).alias("size"),
        section_in.cast("string").alias("section"),
        section_in.cast("string").alias("current"),
    )

    def closed(state: Column) -> Column:
        packed = F.struct(state["section"].alias("section"), F.array_join(state["open"], " ").alias("text"))
        return F.array_append(state["done"], packed)

    def step(state: Column, unit: Column) -> Column:
        current = F.coalesce(unit["heading"], state["current"])
        room = F.length(unit["text"])
        has_open = state["size"] > 0
        turned = has_open & ~current.eqNullSafe(state["section"])
        flush = has_open & (turned | (state["size"] + room > TARGET_CHARS))
        tail = F.try_element_at(state["open"], F.lit(-1))
        repeat = ~turned & (F.length(tail) <= OVERLAP_CHARS)
        kept = F.when(~flush, state["open"]).when(repeat, F.array(tail)).otherwise(no_texts)
        size = F.when(~flush, state["size"]).when(repeat, F.length(tail)).otherwise(F.lit(0))
        return F.struct(
            F.when(flush, closed(state)).otherwise(state["done"]).alias("done"),
            F.array_append(kept, unit["text"]).alias("open"),
            (size + room + 1).alias("size"),
            F.when(flush | (F.size(state["open"]) == 0), current).otherwise(state["section"]).alias("section"),
            current.alias("current"),
        )

    return F.aggregate(
        units, start, step, lambda state: F.when(F.size(state["open"]) > 0, closed(state)).otherwise(state["done"])
    )


def document_chunks(text: Column) -> Column:
    """All passages of a plain text in order: array of (page, section, text).

    Sections carry over the text's pages.
    """
    layouts = F.transform(page_texts(trimmed(text)), lambda page: block_units(page_blocks(page)))

    def sections(pages: Column) -> Column:
        """Section in force at the start of each page (one entry more than there are pages)."""
        return F.aggregate(
            pages,
            F.array(F.lit(None).cast("string")),
            lambda seen, page: F.array_append(seen, F.coalesce(last_heading(page), F.element_at(seen, -1))),
        )

    def packed(pages: Column, incoming: Column) -> Column:
        return F.flatten(
            F.transform(
                pages,
                lambda page, at: F.transform(
                    pack_units(page, F.get(incoming, at)),
                    lambda c: F.struct((at + 1).alias("page"), c["section"].alias("section"), c["text"].alias("text")),
                ),
            )
        )

    return bound(layouts, lambda pages: bound(sections(pages), lambda incoming: packed(pages, incoming)))


def chunk_documents(
    documents: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Passages of plain-text documents: (key, chunk_idx, page, section, text). No shuffle."""
    # The outer form keeps the optimiser from testing the array first, which would cut twice.
    chunks = document_chunks(F.col(text))
    cut = documents.select(key, *carry, F.posexplode_outer(chunks).alias("chunk_idx", "chunk"))
    return cut.where(F.col("chunk").isNotNull()).select(
        key, *carry, "chunk_idx", "chunk.page", "chunk.section", "chunk.text"
    )


def page_sections(pages: DataFrame, keys: list[str], page: str = "page", pages_per_block: int = 512) -> DataFrame:
    """Adds ``section_in``, the section in force where each page starts, from earlier pages."""
    return carry_last_by_key(
        pages.withColumn("units", block_units(page_blocks(F.col("text")))),
        keys,
        [page],
        last_heading(F.col("units")),
        "section_in",
        F.floor(F.col(page) / pages_per_block),
        before=True,
    )


def chunk_pages(pages: DataFrame, keys: list[str], page: str = "page", pages_per_block: int = 512) -> DataFrame:
    """Passages of a page table, whatever number of pages a key has; headings reset per key.

    ``keys`` identify one file. Chunk numbers run over the pages of the key.
    """
    packed = page_sections(pages, keys, page, pages_per_block).select(
        *keys, page, F.posexplode_outer(pack_units(F.col("units"), F.col("section_in"))).alias("pos", "chunk")
    )
    flat = packed.where(F.col("chunk").isNotNull()).select(*keys, page, "pos", "chunk.section", "chunk.text")
    numbered = dense_index(flat, keys, [page, "pos"], "chunk_idx", F.floor(F.col(page) / pages_per_block))
    return numbered.drop("pos")
