from parchment.operators import chunking


def filler(n):
    return " ".join(f"The gardeners water row number {i} before the sun is too high." for i in range(n))


CONTRACT = [
    f"GREENHOUSE LEASE\n\n1. Words Used\n{filler(12)}",
    f"2. Duration\nThe lease runs for four (4) years from the first harvest.\n\n{filler(10)}",
    filler(14),
    f"11. Repair Cover\nRepairs are covered up to a total of £1,750,000 within one growing season.\n\n{filler(6)}",
    "13. Courts\nQuarrels about the lease go to the courts of Leeds.\n\n"
    "14. Ending\nThe tenant or the owner can end the lease after sixty (60) days of written warning.",
]


def contract(spark, doc_id=1):
    return spark.createDataFrame([(doc_id, i + 1, t) for i, t in enumerate(CONTRACT)], ["doc_id", "page", "text"])


def test_sections_and_limits(spark):
    got = chunking.chunk_pages(contract(spark), ["doc_id"]).orderBy("chunk_idx").collect()
    assert [r.chunk_idx for r in got] == list(range(len(got)))
    assert all(len(r.text) <= chunking.MAX_CHARS + 300 for r in got)
    for r in got:
        assert r.text[:40] in " ".join(CONTRACT[r.page - 1].split())
    cap = next(r for r in got if "£1,750,000" in r.text)
    assert (cap.page, cap.section) == (4, "11. Repair Cover")
    # A section goes on over a page break until another heading comes.
    assert next(r for r in got if r.page == 3).section == "2. Duration"


def test_hard_wrap_and_overlap(spark):
    docs = spark.createDataFrame([(1, "x" * 2900), (2, "\n\n".join(["Short line " + "y" * 230] * 8))], ["doc_id", "text"])
    got = chunking.chunk_documents(docs).collect()
    assert [len(r.text) for r in got if r.doc_id == 1] == [1200, 1200, 500]
    second = [r.text for r in got if r.doc_id == 2]
    assert len(second) > 2 and second[1].startswith("Short line")
    assert second[0].split("Short")[-1].strip() == second[1].split("Short")[1].strip()  # the short tail is repeated


def test_rows_and_page_tables_agree(spark):
    """The one-row path and the page-table path cut the same text the same way."""
    from pyspark.sql import functions as F

    from parchment.operators.pages import paginate

    text = "\n\n".join(CONTRACT * 4)
    docs = spark.createDataFrame([(1, text), (2, text[700:])], ["doc_id", "text"])
    columns = ["doc_id", "chunk_idx", "page", "section", "text"]
    whole = chunking.chunk_documents(docs).select(*columns)
    paged = chunking.chunk_pages(paginate(docs), ["doc_id"], pages_per_block=2).select(
        "doc_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), "page", "section", "text"
    )
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, paged.collect()), key=str)


def test_headings_do_not_pass_to_another_file(spark):
    df = contract(spark, 1).unionByName(spark.createDataFrame([(2, 1, "No heading in this file at all.")], ["doc_id", "page", "text"]))
    got = chunking.chunk_pages(df, ["doc_id"]).where("doc_id = 2").collect()
    assert [r.section for r in got] == [None]


def test_one_row_cutting_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "text")], ["doc_id", "text"])
    assert "Exchange" not in chunking.chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
