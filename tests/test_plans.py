from pyspark.sql import functions as F

from parchment.operators import chunking
from parchment.plans.answers import answer_plan
from tests.test_chunking import CONTRACT, filler


def test_modes_and_sources(spark):
    long = CONTRACT + [filler(14)] * 10
    pages = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(long)], ["doc_id", "page", "text"])
    chunks = chunking.chunk_pages(pages, ["doc_id"])
    questions = spark.createDataFrame(
        [(1, 1, "What is the total of the repair cover?"), (2, 1, "How deep is the Baltic?"), (3, 1, "what does this mean?"), (4, 1, "Summarise it")],
        "query_id int, doc_id int, text string",
    )
    modes, sources = answer_plan(chunks, questions, F.lit(1200))
    assert {r.query_id: r["mode"] for r in modes.collect()} == {1: "search", 2: "abstain", 3: "sample", 4: "summary"}
    rows = sources.join(chunks, ["doc_id", "chunk_idx"]).collect()
    assert any("£1,750,000" in r.text for r in rows if r.query_id == 1)
    assert {r.query_id for r in rows} == {1, 3, 4}
    for q in (1, 3, 4):
        mine = [r for r in rows if r.query_id == q]
        assert sum(-(-len(r.text) // 3) + 16 for r in mine) <= 1200
        assert {r.source_id for r in mine} == {f"S{i + 1}" for i in range(len(mine))}


def test_each_question_under_its_own_budget_and_with_the_one_before(spark):
    long = CONTRACT + [filler(14)] * 10
    pages = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(long)], ["doc_id", "page", "text"])
    chunks = chunking.chunk_pages(pages, ["doc_id"])
    cover = "What is the total of the repair cover?"
    rows = [
        (1, 1, "And why is it so?", cover, 1200),
        (2, 1, "And why is it so?", None, 1200),
        (3, 1, "Summarise it", cover, 100),
        (4, 1, "Summarise it", cover, 5000),
        (5, 1, cover, "How deep is the Baltic?", 0),
    ]
    questions = spark.createDataFrame(rows, "query_id int, doc_id int, text string, previous_question string, source_budget long")
    modes, sources = answer_plan(chunks, questions, F.col("source_budget"))
    modes = {r.query_id: r["mode"] for r in modes.collect()}
    got = sources.join(chunks, ["doc_id", "chunk_idx"]).collect()
    assert modes == {1: "search", 2: "sample", 3: "summary", 4: "summary", 5: "sample"}
    assert any("£1,750,000" in r.text for r in got if r.query_id == 1)
    cost = {q: sum(-(-len(r.text) // 3) + 16 for r in got if r.query_id == q) for q in modes}
    assert all(cost[q] <= budget for q, _, _, _, budget in rows) and cost[4] > 1000 and cost[5] == 0
