"""One driver query per operator group. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from parchment import dims
from parchment.functions import citations as C
from parchment.functions import text as T
from parchment.operators import (
    accounts,
    billing,
    chunking,
    compliance,
    conversations,
    evals,
    feedback,
    figures,
    keyword_index,
    metrics,
    pages,
    pii,
    quota,
    quotes,
    router,
    router_pipeline,
    search,
    selection,
    vector_index,
    vectors,
    verify,
)
from parchment.session import broadcast_if_small, stored, work_dir
from parchment.sources import files, records

CHUNK_KEYS = ["doc_id", "chunk_idx"]
BUDGET = 1500
AS_OF = "2024-01-20 00:00:00"
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


# --- pages and documents -------------------------------------------------------------------


@query
def paginate(spark, sf):
    p = pages.paginate(I.texts(spark, sf, "documents"))
    return p.select("doc_id", "page", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query
def document_totals(spark, sf):
    return pages.document_totals(pages.paginate(I.texts(spark, sf, "documents")))


@query
def combine_documents(spark, sf):
    _, sets = pages.combine_documents(pages.paginate(I.texts(spark, sf, "documents"), carry=("source",)), "source", "doc_id")
    return sets


@query
def merged_pages(spark, sf):
    """The pages of each set of documents under one name, each with the file it comes from."""
    merged, _ = pages.combine_documents(pages.paginate(I.texts(spark, sf, "documents"), carry=("source",)), "source", "doc_id")
    return merged.select("source", "doc_id", "page", "file", F.md5("text").alias("digest"))


@query
def page_cleanup(spark, sf):
    docs = I.texts(spark, sf, "documents")
    loose = F.regexp_replace("text", "\n", " \t\n\n\n\n")
    cleaned = docs.select("doc_id", pages.clean_page(loose).alias("t"))
    return cleaned.select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query
def latest_copy(spark, sf):
    name = F.concat_ws("/", "source", "lang", (F.col("n_chars") % 10).cast("string"))
    docs = I.table(spark, sf, "documents").select(name.alias("filename"), "doc_id", "n_chars")
    kept = docs.where(F.col("doc_id") % 2 == 0)
    added = docs.where(F.col("doc_id") % 2 == 1)
    return pages.replace_by_name(kept, added)


@query
def upsert_delete(spark, sf):
    docs = I.table(spark, sf, "documents").select(
        F.concat_ws("/", "source", "lang").alias("id"), F.col("doc_id").alias("updated_at"), "n_chars"
    )
    merged = records.upsert(docs.where(F.col("updated_at") % 2 == 0), docs.where(F.col("updated_at") % 2 == 1))
    gone = I.table(spark, sf, "documents").where(F.col("lang") == "es").select(F.concat_ws("/", "source", "lang").alias("id"))
    return records.delete(merged, gone)


@query
def sealed_records(spark, sf):
    docs = I.table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("turn").alias("updated_at"), "role", "text"
    )
    secret = F.lit("0123456789abcdef")
    plain = F.col("updated_at") % 3 == 0
    mixed = records.seal(docs.where(~plain), secret).unionByName(docs.where(plain), allowMissingColumns=True)
    opened = records.open_sealed(mixed, "role string, text string", secret)
    return opened.select("id", "updated_at", "role", F.md5("text").alias("digest"))


# --- words, headings, passages -------------------------------------------------------------


@query
def tokens(spark, sf):
    words = I.texts(spark, sf, "documents").select("doc_id", F.explode(T.term_words(F.col("text"))).alias("w"))
    return words.select("doc_id", T.stem(F.col("w")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query
def term_stats(spark, sf):
    posted = search.postings(I.texts(spark, sf, "documents"), ["doc_id"])
    return search.term_stats(posted).select("term", "df", "chunks", F.round("avg_len", 6).alias("avg_len"), F.round("idf", 6).alias("idf"))


@query
def normalized_text(spark, sf):
    n = I.texts(spark, sf, "documents").select("doc_id", T.match_form(F.col("text")).alias("t"))
    return n.select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query
def fingerprint(spark, sf):
    # A document's pages come from its own row: the joined text needs no gathering.
    texts = pages.page_texts(T.trimmed(F.col("text")))
    return I.texts(spark, sf, "documents").select(
        "doc_id", F.substring(F.sha2(F.array_join(texts, "\n"), 256), 1, 16).alias("fingerprint")
    )


@query
def headings(spark, sf):
    lines = I.contract_pages(spark, sf).select("doc_id", "page", F.explode(F.split("text", "\n")).alias("line"))
    found = lines.select("doc_id", "page", T.heading(F.col("line")).alias("heading"))
    return found.where(F.col("heading").isNotNull())


@query
def section_carry(spark, sf):
    p = chunking.page_sections(I.contract_pages(spark, sf), ["doc_id"], pages_per_block=1000)
    return p.select("doc_id", "page", "section_in")


@query
def chunks(spark, sf):
    c = chunking.chunk_documents(I.texts(spark, sf, "documents"))
    return c.select("doc_id", "chunk_idx", "page", "section", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query
def contract_chunks(spark, sf):
    c = chunking.chunk_pages(I.contract_pages(spark, sf), ["doc_id"], pages_per_block=1000)
    return c.select("doc_id", "chunk_idx", "page", "section", F.md5("text").alias("digest"))


# --- search ----------------------------------------------------------------------------------


def _benchmark_queries(spark, sf):
    return I.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _corpus_chunks(spark, sf):
    return chunking.chunk_documents(I.texts(spark, sf, "documents"))


def _corpus_matches(spark, sf):
    return search.match_queries(_corpus_chunks(spark, sf), _benchmark_queries(spark, sf), CHUNK_KEYS)


@query
def bm25_topk(spark, sf):
    hits = search.bm25(_corpus_matches(spark, sf))
    return hits.select("query_id", *CHUNK_KEYS, F.round("score", 5).alias("score"), "lexical_rank")


@query
def indexed_search(spark, sf):
    """The same search on a stored index that was built over the even documents, every fourth of them in an
    old version, and then given the others and the present versions."""
    docs = I.texts(spark, sf, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 4 = 0").withColumn("text", F.concat(F.lit("Superseded draft. "), F.reverse("text"), "text"))
    index = keyword_index.KeywordIndex(spark, work_dir(spark, "keyword-index"))
    index.build(chunking.chunk_documents(docs.where("doc_id % 4 = 2").unionByName(old)))
    index.add(chunking.chunk_documents(docs.where("doc_id % 4 <> 2")))
    hits = index.find(_benchmark_queries(spark, sf)).hits
    return hits.select("query_id", *CHUNK_KEYS, F.round("score", 5).alias("score"), "lexical_rank")


WORDINGS = ["urgent interest", "sums of high orders", "medium orders per year", "pay urgent sums late"]


@query
def heading_weighted_search(spark, sf):
    """Contract passages indexed with their section three times over, found by words of headings and text."""
    asked = F.element_at(F.array(*[F.lit(w) for w in WORDINGS]), (F.col("item_id") % len(WORDINGS) + 1).cast("int"))
    questions = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), asked.alias("text"))
    chunks = chunking.chunk_pages(I.contract_pages(spark, sf), ["doc_id"], pages_per_block=1000)
    indexed = chunks.select(*CHUNK_KEYS, T.keyword_text(F.col("section"), F.col("text")).alias("indexed"))
    hits = search.bm25(search.match_queries(indexed, questions, CHUNK_KEYS, text="indexed"))
    return hits.select("query_id", *CHUNK_KEYS, F.round("score", 5).alias("score"), "lexical_rank")


@query
def query_coverage(spark, sf):
    c = search.coverage(_corpus_matches(spark, sf), _benchmark_queries(spark, sf))
    return c.withColumn("weighted_coverage", F.round("weighted_coverage", 6))


def _vector_queries(spark, sf):
    e = I.table(spark, sf, "embeddings")
    q = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    return q.join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


def _vector_search(spark, sf):
    passages = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return vectors.vector_search(passages, _vector_queries(spark, sf), ["doc_id"])


@query
def vector_topk(spark, sf):
    top, _ = _vector_search(spark, sf)
    return top.select("query_id", "doc_id", F.round("similarity", 5).alias("similarity"), "semantic_rank")


@query
def vector_zscore(spark, sf):
    _, stats = _vector_search(spark, sf)
    return stats.select("query_id", "n", *[F.round(c, 5).alias(c) for c in ("best", "mean", "std", "z")])


def _indexed_vectors(spark, sf):
    index = vector_index.VectorIndex(spark, work_dir(spark, "vector-index"), ["doc_id"])
    index.build(I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")))
    return index.find(_vector_queries(spark, sf))


@query
def indexed_vector_topk(spark, sf):
    """The same search over stored clusters, of which a query opens only those that can hold a best row."""
    top = _indexed_vectors(spark, sf)[0]
    return top.select("query_id", "doc_id", F.round("similarity", 5).alias("similarity"), "semantic_rank")


@query
def indexed_vector_zscore(spark, sf):
    """The same statistics from the corpus' moments, without scoring a pair for them."""
    stats = _indexed_vectors(spark, sf)[1]
    return stats.select("query_id", "n", *[F.round(c, 5).alias(c) for c in ("best", "mean", "std", "z")])


def _fused(spark, sf):
    docs = I.texts(spark, sf, "documents")
    lexical = search.bm25(search.match_queries(docs, _benchmark_queries(spark, sf), ["doc_id"]))
    semantic, _ = _vector_search(spark, sf)
    return search.fuse(lexical, semantic, ["doc_id"])


@query
def hybrid_rrf(spark, sf):
    return _fused(spark, sf).select("query_id", "doc_id", F.round("rrf", 9).alias("rrf"), "rrf_rank")


@query
def guaranteed_order(spark, sf):
    return _fused(spark, sf).select("query_id", "doc_id", "final_rank")


@query
def budget_pick(spark, sf):
    docs = I.texts(spark, sf, "documents").select("doc_id", "text")
    picked = selection.pick(_fused(spark, sf).join(docs, "doc_id"), "final_rank", F.lit(BUDGET))
    return picked.select("query_id", "doc_id", "final_rank", "source_id")


@query
def spread_sample(spark, sf):
    s = selection.spread_documents(I.texts(spark, sf, "documents"), F.lit(BUDGET))
    return s.select("doc_id", "chunk_idx", "source_id")


@query
def abstain_or_sample(spark, sf):
    """What each user turn gets from its own document: search results, a sample, or nothing."""
    asked = I.table(spark, sf, "conversations").where(F.col("role") == "user").select(
        F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("conv_id").alias("doc_id"), "text"
    )
    # Only documents somebody asks about are cut.
    about = broadcast_if_small(asked.select("doc_id").distinct())
    own = I.texts(spark, sf, "documents").join(about, "doc_id", "left_semi")
    chunked = chunking.chunk_documents(own)
    asked = asked.join(I.table(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi")
    found = search.match_queries(chunked, asked, CHUNK_KEYS, scope=("doc_id",))
    counts = chunked.groupBy("doc_id").agg(F.count("*").alias("n"))
    cover = (
        search.coverage(found, asked)
        .drop("chunk_count")
        .join(asked.select("query_id", "doc_id", T.is_summary_request(F.col("text")).alias("summary")), "query_id")
        .join(counts, "doc_id")
    )
    mode = (
        F.when(F.col("summary"), "summary")
        .when(search.should_abstain(F.lit(False), F.col("query_terms"), F.col("matched_terms"), F.col("n")), "abstain")
        .when(F.col("matched_terms") > 0, "search")
        .otherwise("sample")
    )
    return cover.select("query_id", "doc_id", "matched_terms", "query_terms", F.col("n").alias("chunk_count"), mode.alias("mode"))


@query
def question_sources(spark, sf):
    """The whole way from a user turn to the passages of its prompt: mode, and sources under what the turn's
    plan leaves, from the search (follow-ups with the question before), from an even sample, or none."""
    from parchment.plans.answers import answer_plan

    turns = I.table(spark, sf, "conversations")
    plan, _ = conversations.plan_turns(turns, 4096, 300)
    before = conversations.previous_question(turns).where("role = 'user'").select("conv_id", "turn", "previous_question")
    asked = plan.where("not too_long").join(before, ["conv_id", "turn"]).select(
        F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("conv_id").alias("doc_id"), F.col("question").alias("text"),
        "previous_question", "source_budget",
    )
    asked = stored(asked, "planned-questions")
    about = broadcast_if_small(asked.select("doc_id").distinct())
    chunks = stored(chunking.chunk_documents(I.texts(spark, sf, "documents").join(about, "doc_id", "left_semi")), "planned-passages")
    modes, sources = answer_plan(chunks, asked, F.col("source_budget"))
    return modes.join(sources, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "mode", "chunk_idx", "source_id")


@query
def similar_examples(spark, sf):
    questions = I.table(spark, sf, "conversations").where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text"
    )
    chosen = feedback.select_examples(questions, I.questions_with_answers(spark, sf))
    return chosen.select("question_id", "id", "place", F.round("similarity", 6).alias("similarity"), "cost")


# --- personal data -----------------------------------------------------------------------------


def _document_pages(spark, sf):
    return pages.paginate(I.texts(spark, sf, "documents"))


@query
def pii_hits(spark, sf):
    return pii.scan(_document_pages(spark, sf), ["doc_id", "page"]).withColumnRenamed("end", "end_at").withColumnRenamed("start", "start_at")


@query
def pii_counts(spark, sf):
    return pii.counts(pii.scan(_document_pages(spark, sf), ["doc_id", "page"]), "doc_id")


@query
def pii_report(spark, sf):
    found = pii.scan(_document_pages(spark, sf), ["doc_id", "page"])
    return pii.report(found, "doc_id", documents=I.table(spark, sf, "documents"))


@query
def pii_redacted(spark, sf):
    r = pii.redact_pages(_document_pages(spark, sf))
    return r.select("doc_id", "page", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query
def redacted_copies(spark, sf):
    r = files.redacted_documents(I.texts(spark, sf, "documents"))
    return r.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


# --- figures -----------------------------------------------------------------------------------


def _page_sources(spark, sf):
    """Each page as one source of its document."""
    page = F.col("page")
    return I.contract_pages(spark, sf).select(
        "doc_id", page.alias("source_order"), F.concat(F.lit("S"), page).alias("source_id"), F.lit(None).cast("string").alias("section"), "text"
    )


def _figure_sources(spark, sf):
    """The same with the section in force."""
    p = chunking.page_sections(I.contract_pages(spark, sf), ["doc_id"], pages_per_block=1000)
    own = F.try_element_at(F.filter(F.transform(F.split("text", "\n"), T.heading), lambda h: h.isNotNull()), F.lit(1))
    return p.select(
        "doc_id",
        F.col("page").alias("source_order"),
        F.concat(F.lit("S"), F.col("page")).alias("source_id"),
        F.coalesce(own, "section_in").alias("section"),
        "text",
    )


@query
def figure_candidates(spark, sf):
    found = figures.candidates(_page_sources(spark, sf), ["doc_id"])
    return found.select("doc_id", "candidate_id", "kind", "value", "source_id", "context")


@query
def figure_rows(spark, sf):
    rows = figures.figure_rows(_figure_sources(spark, sf), ["doc_id"])
    return rows.select("doc_id", "n", "category", "label", "value", "source", "context")


@query
def extraction_plan(spark, sf):
    """What each user turn would ask an extraction for, by one of six wordings."""
    wordings = ["Extract all amounts and dates", "List the parties", "Who pays which fees?", "Tell me more", "All notice periods", "Interest and rights"]
    turns = I.table(spark, sf, "conversations").where(F.col("role") == "user")
    asked = F.element_at(F.array(*[F.lit(w) for w in wordings]), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    plan = figures.extraction_plan(asked)
    return turns.select("conv_id", "turn", plan["figures"].alias("figures"), plan["facts"].alias("facts"), F.array_join(plan["kinds"], ",").alias("kinds"))


@query
def without_reasoning(spark, sf):
    """Answers with a closed, an unclosed or no block of reasoning in front."""
    n = F.col("conv_id") + F.col("turn")
    said = (
        F.when(n % 3 == 0, F.concat(F.lit(" <think>"), "text", F.lit("</think>\n"), "text"))
        .when(n % 3 == 1, F.concat(F.lit("<think>"), "text"))
        .otherwise(F.concat("text", F.lit(" <think>x</think>")))
    )
    turns = I.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", F.md5(T.without_reasoning(said)).alias("digest"))


@query
def extraction_batches(spark, sf):
    chunked = _corpus_chunks(spark, sf)
    hits = search.bm25(_corpus_matches(spark, sf))
    ranks = hits.groupBy(*CHUNK_KEYS).agg(F.min("lexical_rank").alias("final_rank"))
    pooled = selection.rank_for_extraction(chunked, ranks, ["doc_id"], figures.figure_density(F.col("text")))
    return selection.extraction_batches(pooled, ["doc_id"]).select("doc_id", "chunk_idx", "position", "batch", "source_id")


def _items(spark, sf):
    """One item per order: the sum, altered in every fifth row, citing its own page or another."""
    orders = I.table(spark, sf, "orders")
    price = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return orders.select(
        F.col("o_custkey").alias("doc_id"),
        F.col("o_orderkey").alias("item_no"),
        F.lit("amount").alias("category"),
        F.concat(F.lit("Sum "), F.col("o_orderkey") % 2).alias("label"),
        F.concat(F.lit("£"), F.format_number(price, 2)).alias("value"),
        F.concat(F.lit("s"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey"))).alias("source"),
    )


def _verified(spark, sf):
    sources = _page_sources(spark, sf).select("doc_id", "source_order", "source_id", "text")
    return verify.verify_items(_items(spark, sf), sources, ["doc_id"])


@query
def verified_items(spark, sf):
    return _verified(spark, sf).select("doc_id", "item_no", "label", "value", "source", "verified", "problem")


@query
def extraction_status(spark, sf):
    questions = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    status = verify.extraction_status(_verified(spark, sf), questions, ["doc_id"])
    return status.select("doc_id", "rows", "unverified", F.array_join("cited", ",").alias("cited"), "status")


@query
def allowed_labels(spark, sf):
    sources = _page_sources(spark, sf).select("doc_id", "source_id")
    items = _items(spark, sf).withColumn("source", F.upper("source"))
    good, bad = verify.allowed_labels(items, sources, ["doc_id"])
    keep = lambda df, ok: df.select("doc_id", "item_no", F.lit(ok).alias("allowed"))
    return keep(good, True).unionByName(keep(bad, False))


# --- answers -----------------------------------------------------------------------------------


@query
def citation_check(spark, sf):
    v = verify.verify_answers(I.contract_answers(spark, sf), I.contract_sources(spark, sf))
    return v.select("answer_id", "status", F.array_join("cited", ",").alias("cited"), _issue_text())


def _issue_text():
    shown = F.transform("issues", lambda i: F.concat_ws(":", i["kind"], i["detail"]))
    return F.array_join(shown, ";").alias("issues")


@query
def grounded_answers(spark, sf):
    g = verify.ground_answers(I.contract_answers(spark, sf), I.contract_sources(spark, sf))
    return g.select(
        "answer_id",
        "status",
        F.array_join("cited", ",").alias("cited"),
        F.array_join("auto_cited", ",").alias("auto_cited"),
        _issue_text(),
        F.array_join("unsupported", "|").alias("unsupported"),
        "content",
    )


@query
def pooled_answers(spark, sf):
    """One answer per nation against all pages of its customers, thousands of sources each."""
    sources = I.pooled_sources(spark, sf)
    g = verify.ground_answers(I.pooled_answers(sources), sources)
    return g.select(
        "answer_id",
        "status",
        F.array_join("cited", ",").alias("cited"),
        F.array_join("auto_cited", ",").alias("auto_cited"),
        _issue_text(),
        F.array_join("unsupported", "|").alias("unsupported"),
        "content",
    )


@query
def off_topic_answers(spark, sf):
    """Verified answers with the issue of an answer that is less like its question than the best passage."""
    verified = verify.ground_answers(I.contract_answers(spark, sf), I.contract_sources(spark, sf))
    judged = relevance(spark, sf).select(F.col("vec_id").alias("answer_id"), "off_topic")
    flagged = verify.add_relevance(verified.join(judged, "answer_id", "left"), F.col("off_topic"))
    return flagged.select("answer_id", "status", _issue_text())


@query
def conversation_grounding(spark, sf):
    """Assistant turns against the user turns before them as sources, on free text."""
    qa = I.questions_with_answers(spark, sf)
    answers = qa.select(F.col("id").alias("answer_id"), "answer", "question")
    sources = qa.select(
        F.col("id").alias("answer_id"), F.lit(1).alias("source_order"), F.lit("S1").alias("source_id"), F.col("question").alias("text")
    )
    g = verify.ground_answers(answers, sources)
    return g.select("answer_id", "status", F.array_join("cited", ",").alias("cited"), F.length("content").alias("chars"))


@query
def quote_support(spark, sf):
    """Benchmark items as quotes in all documents: whole, with one word changed, cut at both ends, and
    their first one to three words."""
    items = I.table(spark, sf, "benchmark").select("item_id", "text", F.split("text", r"\s+").alias("w"))
    joined = lambda words: F.array_join(words, " ")
    variants = F.create_map(
        F.lit("whole"), F.col("text"),
        F.lit("altered"), joined(F.transform("w", lambda x, i: F.when(i == 5, F.lit("changed")).otherwise(x))),
        F.lit("cut"), joined(F.slice("w", 4, F.greatest(F.size("w") - 6, F.lit(0)))),
        F.lit("short"), joined(F.slice("w", F.lit(1), (F.col("item_id") % 3 + 1).cast("int"))),
    )
    asked = items.select("item_id", F.explode(variants).alias("variant", "text"))
    return quotes.quoted_in(I.texts(spark, sf, "documents"), asked, ["doc_id"], ["item_id", "variant"])


@query
def relevance(spark, sf):
    """An answer against its question (the next vector): off-topic when less like it than the best passage
    is. Every third answer is a vector of its own, the others repeat the question."""
    e = I.table(spark, sf, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(
        e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("q")), "vec_id"
    )
    best = _vector_search(spark, sf)[1].select(F.col("query_id").alias("vec_id"), "best")
    answer = F.when(F.col("vec_id") % 3 == 0, F.col("a")).otherwise(F.col("q"))
    scored = pairs.join(best, "vec_id").select("vec_id", vectors.cosine(answer, F.col("q")).alias("similarity"), "best")
    issue = vectors.relevance_issue(F.col("similarity"), F.col("best"))
    return scored.select("vec_id", F.round("similarity", 5).alias("similarity"), issue.alias("off_topic"))


# --- checklists --------------------------------------------------------------------------------


@query
def checklist_choice(spark, sf):
    """The checklist each nation's and event type's words ask for."""
    docs = I.table(spark, sf, "documents").select(
        "doc_id", F.concat_ws(" ", F.lit("check"), F.when(F.col("doc_id") % 3 == 0, "the BAA").when(F.col("doc_id") % 3 == 1, "GDPR"), "lang").alias("question")
    )
    return docs.select("doc_id", compliance.pick_checklist(F.col("question")).alias("checklist"))


def _agreements(spark, sf):
    """Orders as clauses that speak of some of the requirements; one document per customer."""
    orders = I.texts(spark, sf, "orders")
    clause = F.element_at(
        F.array(
            F.lit("The processor acts on documented instructions of the controller"),
            F.lit("Personal data breaches are notified without undue delay within 24 hours"),
            F.lit("Personnel authorised to process are bound by confidentiality"),
            F.lit("Data is deleted or returned at the end of services"),
            F.lit("The weather is fine and lunch is served"),
        ),
        (F.col("o_orderkey") % 5 + 1).cast("int"),
    )
    return orders.select(
        F.col("o_custkey").alias("doc_id"),
        F.col("o_orderkey").alias("page"),
        F.concat(clause, F.lit(" under order "), F.col("o_orderkey"), F.lit(".")).alias("text"),
    )


def _evidence(spark, sf):
    c = _agreements(spark, sf).select("doc_id", F.col("page").alias("chunk_idx"), F.lit(None).cast("string").alias("section"), "text")
    return compliance.checklist_evidence(c, "gdpr_art28")


@query
def checklist_evidence(spark, sf):
    return _evidence(spark, sf).select("doc_id", "item_id", "chunk_idx", "source_id", "lexical_rank", F.round("score", 5).alias("score"))


def _verdicts(spark, sf):
    """Findings that quote the best passage of each requirement, with faults by document."""
    evidence = _evidence(spark, sf)
    items = dims.checklist_items(spark).select("item_id", "must_mention")
    best = evidence.where("lexical_rank = 1")
    quote = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 5 == 0, F.concat(F.col("text"), F.lit(" and 99 more"))).otherwise(F.col("text"))
    findings = best.select(
        "doc_id",
        "item_id",
        quote.alias("quote"),
        F.lit("none").alias("source"),
        F.when(F.col("doc_id") % 11 == 0, "not_found").when(F.col("doc_id") % 13 == 0, "partial").otherwise("addressed").alias("status"),
    ).join(F.broadcast(items), "item_id")
    sources = evidence.select("doc_id", "item_id", "source_order", "source_id", "text")
    return compliance.verify_findings(findings, sources, ["doc_id", "item_id"])


@query
def finding_verdicts(spark, sf):
    return _verdicts(spark, sf).select("doc_id", "item_id", "verdict", "source", "problem")


@query
def compliance_summary(spark, sf):
    return compliance.summary(_verdicts(spark, sf), "gdpr_art28")


# --- conversations -----------------------------------------------------------------------------


@query
def previous_question(spark, sf):
    p = conversations.previous_question(I.table(spark, sf, "conversations"))
    asked = T.search_text(F.col("text"), F.col("previous_question"))
    return p.select("conv_id", "turn", F.md5(F.coalesce("previous_question", F.lit(""))).alias("previous"), (F.length(asked) > F.length("text")).alias("extended"))


@query
def history_plan(spark, sf):
    plan, _ = conversations.plan_turns(I.table(spark, sf, "conversations"), 4096, 300)
    return plan.drop("question")


@query
def history_plan_free(spark, sf):
    plan, _ = conversations.plan_turns(I.table(spark, sf, "conversations"), 2048, 300, with_document=False)
    return plan.drop("question")


@query
def prompt_table(spark, sf):
    """The prompt of every user turn: the conversation's document sampled under what its history leaves."""
    plan, kept = conversations.plan_turns(I.table(spark, sf, "conversations"), 4096, 300)
    docs = I.texts(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), "text")
    asked = plan.where("not too_long").select("conv_id", "turn", "source_budget")
    spread = selection.spread_documents(docs.join(asked, "conv_id"), F.col("source_budget"), ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        F.col("chunk_idx").alias("source_order"),
        conversations.source_block(
            F.col("source_id"), F.lit(None).cast("string"), F.col("page").cast("string"), F.col("section"), F.col("text")
        ).alias("block"),
    )
    table = conversations.prompt_table(plan, kept, spread, "Answer from the sources.")
    shown = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n---\n")
    return table.select("conv_id", "turn", F.size("messages").alias("messages"), F.md5(shown).alias("digest"))


@query
def prompts_with_examples(spark, sf):
    """The prompt of every user turn without a document: its history and up to two approved answers."""
    plan, kept = conversations.plan_turns(I.table(spark, sf, "conversations"), 2048, 300, with_document=False)
    rated = I.questions_with_answers(spark, sf)
    approved = F.when(F.col("rating") == "down", F.col("correction")).otherwise(C.strip_citations(F.col("answer")))
    chosen = similar_examples(spark, sf).join(rated.select("id", "question", approved.alias("answer")), "id")
    lists = chosen.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "question", "answer"))).alias("examples"))
    asked = plan.withColumn("question_id", F.col("conv_id") * 1000 + F.col("turn")).join(lists, "question_id", "left")
    block = conversations.examples_block(F.col("examples"), F.lit("EXAMPLES"))
    table = conversations.prompt_table(asked, kept, None, "Answer briefly.", examples=block)
    shown = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n---\n")
    return table.select("conv_id", "turn", F.size("messages").alias("messages"), F.md5(shown).alias("digest"))


@query
def latest_threads(spark, sf):
    turns = I.table(spark, sf, "conversations")
    threads = turns.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("first_message"), F.max("turn").alias("updated_at")
    ).select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("w"), F.col("conv_id") % 3)).alias("workspace"), "first_message", "updated_at")
    return conversations.latest_threads(threads, "default").select("workspace", "id", "title", "updated_at")


@query
def deleted_threads(spark, sf):
    turns = I.table(spark, sf, "conversations")
    removed = turns.where(F.col("role") == "system").select("conv_id")
    return conversations.delete_threads(turns, removed).select("conv_id", "turn", "role")


# --- feedback ----------------------------------------------------------------------------------


def _feedback(spark, sf):
    return feedback.current_state(feedback.records(I.ratings(spark, sf)))


@query
def feedback_state(spark, sf):
    return _feedback(spark, sf).select("id", "event_id", "rating", F.array_join("reasons", ",").alias("reasons"), "correction")


@query
def feedback_totals(spark, sf):
    return feedback.totals(_feedback(spark, sf))


@query
def eval_candidates(spark, sf):
    e = feedback.eval_candidates(_feedback(spark, sf))
    return e.select("doc", "q", F.get("expect", F.lit(0)).alias("expect"), F.array_join("reasons", ",").alias("reasons"), "rejected_answer")


@query
def feedback_export(spark, sf):
    noted = _feedback(spark, sf).withColumn("correction", F.concat("correction", F.lit(" mail a"), F.col("event_id").cast("string"), F.lit("@b.org")))
    return files.feedback_export(noted).select("id", "correction")


# --- metrics and quotas ------------------------------------------------------------------------


@query
def metric_accept_reject(spark, sf):
    return metrics.checked_events(I.metric_payloads(spark, sf)).select("event_id", "problem")


def _metric_events(spark, sf):
    return metrics.accepted(metrics.checked_events(I.metric_payloads(spark, sf)))


@query
def metric_summary(spark, sf):
    return metrics.summary(_metric_events(spark, sf))


@query
def metric_answers(spark, sf):
    return metrics.answers_by_intent(_metric_events(spark, sf))


@query
def metric_ratings(spark, sf):
    return metrics.ratings_by_intent(_metric_events(spark, sf))


@query
def metric_histograms(spark, sf):
    events = _metric_events(spark, sf)
    kinds = F.create_map(F.lit("down_reasons"), F.lit("reason"), F.lit("issues"), F.lit("issue"))
    counts = metrics.summary(events).withColumn("kind", kinds[F.col("section")])
    return counts.where("kind is not null and item != ''").select("kind", "item", "n")


@query
def built_events(spark, sf):
    e = I.table(spark, sf, "events")
    made = e.select(
        "event_id",
        F.when(F.col("event_type") == "click", "feedback").otherwise("answer").alias("kind"),
        F.when(F.col("event_id") % 3 == 0, "bogus").when(F.col("event_id") % 3 == 1, "qa").alias("intent"),
        (F.col("user_id") % 2 == 0).alias("has_document"),
        F.when(F.col("event_id") % 5 == 0, "odd").otherwise("warning").alias("status"),
        F.array(F.lit("off-topic"), F.lit("no-citation"), F.lit("off-topic")).alias("issues"),
        F.concat(F.lit("Model v1 / "), F.col("user_id") % 3).alias("model"),
        ((F.col("value") - 10) * 100000).alias("latency"),
        (F.col("value") * 1000).alias("speed"),
        F.lit("up").alias("rating"),
        F.array(F.lit("wrong")).alias("reasons"),
    )
    b = metrics.build_events(made, "73b4e0e4f4f4")
    return b.select("event_id", "kind", "intent", "status", F.array_join("issues", ",").alias("issues"), "model", "latency_ms", F.round("tokens_per_sec", 3).alias("tokens_per_sec"), "rating", F.array_join("reasons", ",").alias("reasons"))


def _dated(spark, sf, events=None):
    m = I.messages(spark, sf, events)
    return m.withColumn("day", quota.local_day(F.col("ts"), F.col("zone"), quota.known_zones(spark)))


@query
def daily_usage(spark, sf):
    return quota.daily_usage(_dated(spark, sf)).select("user_id", F.col("day").cast("string").alias("day"), "messages")


def _with_limit(dated):
    # Small limits, so that the test tables reach them; one user in four has none.
    return dated.withColumn("daily_messages", F.when(F.col("user_id") % 4 != 3, F.col("user_id") % 4 + 1).cast("int"))


def _limited(spark, sf):
    return quota.take_messages(_with_limit(_dated(spark, sf)))


@query
def quota_decisions(spark, sf):
    d = _limited(spark, sf)
    left, warn = quota.messages_left(F.col("used"), F.col("daily_messages"))
    return d.select("event_id", "accepted", "used", left.alias("left_today"), warn.alias("warn"))


PLAN_LIMITS = {"free": 1, "pro": 3, "business": None}


@query
def quota_plan_changes(spark, sf):
    """Messages under the plan their user has at that moment, which changes several times a day."""
    changes = billing.plan_changes(I.snapshots(spark, sf))
    limits = F.create_map(*[F.lit(x).cast(t) for p, n in PLAN_LIMITS.items() for x, t in ((p, "string"), (n, "int"))])
    changes = changes.select(F.col("customer_id").alias("user_id"), "ts", "event_id", limits[F.col("plan")].alias("daily_messages"))
    sent = _dated(spark, sf).withColumn("daily_messages", F.lit(PLAN_LIMITS["free"]))
    d = quota.take_messages(quota.limits_in_force(sent, changes), since="since")
    return d.select("event_id", F.col("daily_messages").alias("limit"), "accepted", "used")


@query
def rate_limited(spark, sf):
    hits = I.table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", "event_id")
    return quota.rate_limited(hits, 3, 6 * 3600).select("event_id", "accepted")


# --- accounts ----------------------------------------------------------------------------------


def _entitled(spark, sf):
    return accounts.entitlements(I.accounts(spark, sf))


@query
def entitlements(spark, sf):
    e = _entitled(spark, sf)
    return e.select("user_id", "plan", "daily_messages", "max_documents", "max_document_pages", "large_models", "checklists", F.array_join("workspaces", ",").alias("workspaces"))


@query
def entitlement_gates(spark, sf):
    totals = pages.document_totals(pages.paginate(I.texts(spark, sf, "documents")))
    owned = totals.select((F.col("doc_id") % 150).alias("user_id"), "doc_id", "page_count")
    return accounts.document_gates(owned, _entitled(spark, sf)).select("user_id", "doc_id", "reason")


@query
def feature_gates(spark, sf):
    e = accounts.may_use(_entitled(spark, sf), "sme", F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0)
    return e.select("user_id", "workspace_allowed", "model_allowed", "checklist_allowed")


@query
def account_summary(spark, sf):
    usage = quota.daily_usage(_dated(spark, sf)).where(F.col("day") == F.lit("2024-01-10").cast("date"))
    s = accounts.account_summary(_entitled(spark, sf), usage)
    return s.select("user_id", "display_name", "plan", "used_today", "left_today")


@query
def subscription_state(spark, sf):
    return billing.subscription_state(I.snapshots(spark, sf))


@query
def live_subscriptions(spark, sf):
    """Which snapshots stand for a live subscription; every ninth names none."""
    named = F.when(F.col("event_id") % 9 != 0, F.col("subscription_id")).when(F.col("event_id") % 2 == 0, F.lit(""))
    live = billing.has_live_subscription(named, F.col("status"))
    return I.snapshots(spark, sf).select("event_id", live.alias("live"))


@query
def valid_sessions(spark, sf):
    orders = I.table(spark, sf, "orders")
    token = F.concat(F.lit("token-"), F.col("o_orderkey"))
    sessions = orders.select(
        F.col("o_custkey").alias("user_id"),
        F.sha2(token.cast("binary"), 256).alias("token_hash"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 days")).alias("expires_at"),
    )
    presented = orders.select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 4 == 0, "forged").otherwise(token).alias("token"))
    as_of = F.lit("1998-01-01 00:00:00").cast("timestamp")
    return accounts.valid_sessions(sessions, presented, as_of).select("request_id", "user_id")


@query
def live_links(spark, sf):
    e = I.table(spark, sf, "events")
    tokens_ = e.select(
        "user_id",
        F.when(F.col("event_type").isin("click", "view"), "verify").otherwise("reset").alias("purpose"),
        F.col("event_id").alias("token_id"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("used_at"),
        (F.col("ts") + F.expr("interval 12 days")).alias("expires_at"),
    )
    return accounts.live_links(tokens_, F.lit(AS_OF).cast("timestamp")).select("user_id", "purpose", "token_id")


@query
def erasure(spark, sf):
    removed = _entitled(spark, sf).where(F.col("plan") == "free")
    usage = quota.daily_usage(_dated(spark, sf))
    left = accounts.erase_users(removed, {"usage": usage})["usage"]
    return left.select("user_id", F.col("day").cast("string").alias("day"), "messages")


@query
def account_checks(spark, sf):
    c = I.table(spark, sf, "customer")
    made = c.select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.when(F.col("c_custkey") % 2 == 0, "User").otherwise("user"), F.floor(F.col("c_custkey") / 2).cast("string"), F.when(F.col("c_custkey") % 9 == 0, " at x.org").otherwise("@x.org")).alias("email"),
        F.repeat(F.lit("p"), (F.col("c_custkey") % 20).cast("int")).alias("password"),
        F.col("c_name").alias("display_name"),
        F.when(F.col("c_nationkey") == 3, "alien").otherwise("sme").alias("user_type"),
    )
    return accounts.registration_checks(made).select("user_id", "email", "problem")


@query
def account_uniqueness(spark, sf):
    c = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.when(F.col("c_custkey") % 2 == 0, "User").otherwise("user"), F.floor(F.col("c_custkey") / 3).cast("string"), F.lit("@x.org")).alias("email"),
    )
    twins = accounts.duplicate_emails(c)
    kept = accounts.first_accounts(c).select("user_id", F.lower("email").alias("email"))
    return twins.join(kept, "email")


# --- intents -----------------------------------------------------------------------------------


def _intent_texts(spark, sf):
    return I.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.col("role").alias("label"), "text"
    )


@query
def intent_features(spark, sf):
    t = _intent_texts(spark, sf)
    counts = router.gram_counts(t, "key")
    idf = router.fit_idf(counts, t.agg(F.count("*").alias("n")))
    return router.features(counts, idf, "key").select("key", "term", F.round("weight", 6).alias("weight"))


@query
def intent_scores(spark, sf):
    """Scoring with a weights table derived from the texts: mean weight per class and term. Counts and weights
    are stored, as most of the steps read them."""
    t = _intent_texts(spark, sf)
    counts = stored(router.gram_counts(t, "key"), "gram-counts")
    idf = router.fit_idf(counts, t.agg(F.count("*").alias("n")))
    classes = ["assistant", "system", "user"]
    weighted = router.features(counts, idf, "key").join(t.select("key", "label"), "key")
    sums = weighted.groupBy("term").agg(*[F.sum(F.when(F.col("label") == c, F.col("weight")).otherwise(0.0)).alias(c) for c in classes])
    model = stored(sums.join(idf, "term").select("term", "idf", F.array(*classes).alias("coef")), "intent-weights")
    scored = router.score(counts, model, {c: 0.1 * i for i, c in enumerate(classes)}, "key")
    return scored.select("key", *[F.round(c, 5).alias(c) for c in classes])


@query
def intent_eval(spark, sf):
    """Trains on the texts and reports the confusion table on them (no SQL counterpart)."""
    t = _intent_texts(spark, sf)
    fitted = router.train(t, "key", "label", iterations=20)
    scored = router.predicted(fitted.predict(t, "key"), list(fitted.intercepts))
    return router.confusion(scored.join(t.select("key", "label"), "key"))


@query
def router_held_out(spark, sf):
    """The router pipeline on the texts' languages: fitted on three of four documents, judged on the others.
    The languages' texts in the fold, and whether at least 95 % of them were told."""
    docs = I.texts(spark, sf, "documents").where("lang is not null").select(F.col("doc_id").alias("key"), F.col("lang").alias("label"), "text")
    model = router_pipeline.fit(docs.where("key % 4 <> 0"))
    held = docs.where("key % 4 = 0")
    told = router.predicted(router_pipeline.scores(model, held.select("key", "text"), "key"), router_pipeline.classes(model))
    found = router.accuracy(told.join(held.select("key", "label"), "key"))
    return found.select("texts", (F.col("accuracy") >= 0.95).alias("accurate"))


@query
def routed_messages(spark, sf):
    """Routing rules over class probabilities made from the turn's own numbers."""
    t = I.table(spark, sf, "conversations").where(F.col("role") == "user")
    n = F.col("conv_id") + F.col("turn")
    p = lambda k: (((n * k) % 10) + 1).cast("double")
    total = p(3) + p(7) + p(9) + p(1) + p(11) * 2
    scored = t.select(
        "conv_id", "turn", F.concat(F.when(n % 4 == 0, "give me an overview ").otherwise(""), F.col("text")).alias("text"),
        (p(3) / total).alias("compliance"), (p(7) / total).alias("extract"), (p(11) * 2 / total).alias("general"),
        (p(9) / total).alias("qa"), (p(1) / total).alias("summary"),
        (F.col("conv_id") % 6 != 0).alias("has_document"), ((n % 5) / 10.0).alias("overlap"),
    )
    r = router.route(scored, ["compliance", "extract", "general", "qa", "summary"])
    return r.select("conv_id", "turn", "intent", F.round("confidence", 6).alias("confidence"), "reason")


# --- evaluation --------------------------------------------------------------------------------


def _recall(spark, sf):
    """The six best passages of every item, judged on their own text, line ends and blanks alike."""
    squeezed = lambda c: F.regexp_replace(c, r"\s+", " ")
    gold = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), squeezed("text").alias("gold"))
    hits = stored(search.bm25(_corpus_matches(spark, sf), limit=6).select("query_id", *CHUNK_KEYS), "hits")
    # Only documents with a hit are cut once more, for the texts.
    docs = I.table(spark, sf, "documents").join(broadcast_if_small(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    found = chunking.chunk_documents(docs.repartition("doc_id")).select(*CHUNK_KEYS, "text").join(broadcast_if_small(hits), CHUNK_KEYS)
    return evals.retrieval_recall(gold, found.select("query_id", squeezed("text").alias("text")))


@query
def eval_recall(spark, sf):
    """Pages, passages, keyword search, and whether a selected passage holds the item."""
    return _recall(spark, sf)[0].withColumn("recall", F.round("recall", 6))


@query
def eval_misses(spark, sf):
    return _recall(spark, sf)[1]


@query
def eval_routing(spark, sf):
    routed = routed_messages(spark, sf).withColumn("expected", F.when(F.col("conv_id") % 2 == 0, "qa").otherwise("general"))
    totals, leaks = evals.routing(routed)
    return totals.join(F.broadcast(leaks.agg(F.count("*").alias("leaks"))))


@query
def eval_extraction(spark, sf):
    expected = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("question"),
        F.array(F.concat(F.lit("£"), F.format_number("o_totalprice", 2)), F.concat(F.lit("£"), F.format_number(F.col("o_totalprice") + 1, 2))).alias("expect_values"),
    )
    spans_ = I.contract_pages(spark, sf).select(F.col("page").alias("question"), F.explode_outer(figures.figure_spans(F.col("text"))).alias("s"))
    found = spans_.select("question", F.col("s.value").alias("value"))
    got, missing = evals.extraction_recall(expected, found, ["question"])
    keep = lambda df, ok: df.select("question", "value", F.lit(ok).alias("found"))
    return keep(got, True).unionByName(keep(missing, False))


@query
def eval_answers(spark, sf):
    v = verify.verify_answers(I.contract_answers(spark, sf), I.contract_sources(spark, sf))
    prices = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("answer_id"), F.array(F.format_number("o_totalprice", 2)).alias("expect"))
    scored = evals.score_answers(v.join(prices, "answer_id"), ["£1", "interest"])
    return evals.answer_totals(scored)


@query
def eval_unrelated(spark, sf):
    v = verify.verify_answers(I.contract_answers(spark, sf), I.contract_sources(spark, sf))
    routed = v.withColumn("intent", F.when(F.col("answer_id") % 4 == 0, "general").otherwise("qa"))
    return evals.unrelated_handled(routed).groupBy("ok").agg(F.count("*").alias("answers"))


@query
def eval_compliance(spark, sf):
    items = dims.checklist_items(spark).where(F.col("checklist") == "gdpr_art28").select("item_id", "position")
    key = (
        I.table(spark, sf, "customer")
        .select(F.col("c_custkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("position"))
        .join(F.broadcast(items), "position")
        .withColumn("truth", F.when((F.col("doc_id") + F.col("position")) % 2 == 0, "present").otherwise("absent"))
    )
    scored = evals.compliance_scores(key.drop("position"), _verdicts(spark, sf), ["doc_id"])
    return scored.groupBy("item_id").agg(
        F.count_if("ok").alias("correct"), F.count_if("false_positive").alias("false_positives"), F.count("*").alias("checks")
    )


@query
def eval_regressions(spark, sf):
    """Events per type against a baseline made of the average; types under it."""
    per_type = I.table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))
    mean = per_type.agg(F.avg("value").alias("mean"))
    baseline = per_type.join(F.broadcast(mean)).select("metric", F.col("mean").alias("value"))
    return evals.regressions(per_type, baseline).select("metric", "value", F.round("recorded", 6).alias("recorded"))


# --- streams -----------------------------------------------------------------------------------
# Events arrive in four parts, written to a shared folder one after another; the stream runs after
# each and goes on where it stopped. The result table is read back.


def _streamed(spark, sf, name, part, run, again=None):
    """Folder of the results after ``run(events, out, checkpoint)`` over the four parts. ``part`` numbers the
    events from 0 to 3; those that match ``again`` come a second time with the last part."""
    from parchment.session import work_dir
    from parchment.streaming.sources import read_files

    out = work_dir(spark, name)
    events = I.table(spark, sf, "events")
    for k in range(4):
        now = events.where(part == k)
        if again is not None and k == 3:
            now = now.unionByName(events.where(again))
        now.write.mode("append").parquet(f"{out}/in")
        run(read_files(spark, f"{out}/in", events.schema), out, f"{out}/checkpoint")
    return out


def _by_time(spark, sf):
    """Quarter of the time span an event lies in: limits depend on the order of arrival."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = I.table(spark, sf, "events").agg(F.min(t), F.max(t)).first()
    width = max(1, ((hi or 0) - (lo or 0)) // 4 + 1)
    return F.floor((t - (lo or 0)) / width).cast("int")


@query
def stream_metric_summary(spark, sf):
    from parchment.streaming import metrics as stream

    run = lambda events, out, mark: stream.running_summary(I.metric_payloads(spark, sf, events), f"{out}/table", mark)
    out = _streamed(spark, sf, "metric-summary", F.col("event_id") % 4, run)
    return spark.read.parquet(f"{out}/table")


@query
def stream_period_answers(spark, sf):
    """Answers per day of event time; each of the four parts corrects days that earlier ones have written."""
    from parchment.streaming import metrics as stream

    run = lambda events, out, mark: stream.period_answers(I.metric_payloads(spark, sf, events), f"{out}/rows", mark)
    out = _streamed(spark, sf, "period-answers", F.col("event_id") % 4, run)
    rows = stream.read_periods(spark, f"{out}/rows")
    return rows.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query
def stream_metric_ingest(spark, sf):
    from parchment.streaming import metrics as stream

    run = lambda events, out, mark: stream.ingest(I.metric_payloads(spark, sf, events), out, mark)
    out = _streamed(spark, sf, "metric-ingest", F.col("event_id") % 4, run)
    good = spark.read.parquet(f"{out}/accepted").select("event_id", F.lit(None).cast("string").alias("problem"))
    return good.unionByName(spark.read.parquet(f"{out}/rejected").select("event_id", "problem"))


@query
def stream_rate_limit(spark, sf):
    from parchment.streaming import limits

    def run(events, out, mark):
        limits.rate_limited(events.select(F.col("user_id").alias("key"), "ts", "event_id"), 3, 6 * 3600, out, mark)

    out = _streamed(spark, sf, "rate-limit", _by_time(spark, sf), run)
    return spark.read.parquet(f"{out}/verdicts").select("event_id", "accepted")


@query
def stream_quota(spark, sf):
    from parchment.streaming import limits

    run = lambda events, out, mark: limits.take_messages(_with_limit(_dated(spark, sf, events)), out, mark)
    out = _streamed(spark, sf, "quota", _by_time(spark, sf), run)
    return spark.read.parquet(f"{out}/decisions").select("event_id", "accepted", "used")


@query
def stream_subscriptions(spark, sf):
    """Out of order, with repeats, unknown types, and customers that only a checkout event names."""
    from parchment.operators.billing import CHECKOUT_EVENT, SUBSCRIPTION_EVENTS
    from parchment.streaming import webhooks

    n = F.col("event_id")
    kind = F.when(n % 7 == 0, "invoice.paid").when(n % 11 == 3, CHECKOUT_EVENT).otherwise(SUBSCRIPTION_EVENTS[1])

    def run(events, out, mark):
        snapshots = I.snapshots(spark, sf, events=events).withColumn("event_type", kind)
        reference = F.when(F.col("event_type") == CHECKOUT_EVENT, F.col("customer_id"))
        webhooks.process(snapshots.withColumn("reference_id", reference), out, mark)

    out = _streamed(spark, sf, "subscriptions", n % 4, run, again=n % 5 == 0)
    who = F.col("user_id")
    users = I.table(spark, sf, "events").select("user_id", F.when(who % 2 == 1, who).alias("customer_id")).distinct()
    return webhooks.current_state(spark, out, users).withColumnRenamed("user_id", "customer_id").drop("renews_at")
