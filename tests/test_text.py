import pytest
from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.operators import pages


@pytest.mark.parametrize(
    "text, expected",
    [
        ("What are the termination rights?", ["termin", "right"]),
        ("Liabilities capped at £2,500,000", ["liability", "cap", "2", "500", "000"]),
        ("cap capped capping", ["cap", "cap", "cap"]),
        ("billing bills billed", ["bill", "bill", "bill"]),
        ("français", ["franc", "ais"]),
        ("ﬁnes 7 x", ["fin", "7"]),
        ("", []),
    ],
)
def test_tokens(one, text, expected):
    assert one(T.tokens, text) == expected


@pytest.mark.parametrize(
    "line, expected",
    [
        ("12. Limitation of Liability", "12. Limitation of Liability"),
        ("Section 4 Payment Terms", "Section 4 Payment Terms"),
        ("MASTER SERVICES AGREEMENT", "MASTER SERVICES AGREEMENT"),
        ("  Annex   B  ", "Annex B"),
        ("The parties shall cooperate in good faith.", None),
        ("AB", None),
    ],
)
def test_heading(one, line, expected):
    assert one(T.heading, line) == expected


def test_match_form(one):
    assert one(T.match_form, "“Café”  —  it’s\n5%!") == "\"cafe \" - it's 5%"


def test_ascii_boundaries_do_not_depend_on_the_runtime(one):
    assert one(lambda c: F.regexp_count(c, F.lit(T.WB)), "aéb") == 4


@pytest.mark.parametrize(
    "text, expected", [("Summarise this contract", True), ("What are the key terms?", True), ("What is the liability cap?", False)]
)
def test_summary_request(one, text, expected):
    assert one(T.is_summary_request, text) is expected


@pytest.mark.parametrize(
    "text, extended",
    [
        ("What is the uptime commitment?", False),
        ("And what about termination?", True),
        ("Why is it so short?", True),
        ("Explain more", True),
    ],
)
def test_search_text(one, text, extended):
    previous = "How quickly must a data breach be reported?"
    assert one(lambda c: T.search_text(c, F.lit(previous)), text) == (f"{text}\n{previous}" if extended else text)
    assert one(lambda c: T.search_text(c, F.lit("")), text) == text


def test_sentences(one):
    text = "First one. Second: 99.5% up; third? Last"
    assert one(T.sentences_of, text) == ["First one.", "5% up;", "third?", "Last"]


@pytest.mark.parametrize(
    "text, expected",
    [("<think>a\nb</think>  Yes", "Yes"), ("<think>never closed", ""), ("No <think>", "No <think>"), ("  <think>x</think>y", "y")],
)
def test_without_reasoning(one, text, expected):
    assert one(T.without_reasoning, text) == expected


def test_title_and_labels(one):
    assert one(T.thread_title, "x" * 41) == "x" * 40 + "…"
    assert one(T.thread_title, "short") == "short"
    assert one(lambda c: T.page_label(F.lit("a.pdf"), c), "4") == "a.pdf p. 4"
    assert one(lambda c: T.page_label(F.lit(None).cast("string"), c), "4") == "p. 4"


def test_pages(spark, one):
    docs = spark.createDataFrame([(1, "a" * 6001), (2, "  b  "), (3, "   ")], ["doc_id", "text"])
    got = [(r.doc_id, r.page, len(r.text)) for r in pages.paginate(docs).orderBy("doc_id", "page").collect()]
    assert got == [(1, 1, 3000), (1, 2, 3000), (1, 3, 1), (2, 1, 1)]
    assert [tuple(r) for r in pages.rejected_documents(docs).collect()] == [(3, "no extractable text")]
    assert one(pages.clean_page, " a \t\n\n\n\nb\n") == "a\n\nb"


def test_combine_one_document_stays_itself(spark):
    p = spark.createDataFrame([("s", "a", 1, "x"), ("t", "b", 1, "y"), ("t", "c", 1, "zz")], ["set", "name", "page", "text"])
    merged, sets = pages.combine_documents(p, "set", "name")
    assert {(r.set, r.filename, r.char_count) for r in sets.collect()} == {("s", "a", 1), ("t", "2 documents", 3)}
    assert {(r.text, r.file) for r in merged.collect()} == {("x", None), ("y", "b"), ("zz", "c")}
