"""Work done inside a document's row equals the work on exploded rows; hot documents stay spread."""

from pyspark.sql import functions as F

from parchment.operators import chunking, selection, verify
from parchment.operators.pages import paginate
from parchment.sources import files


def documents(spark):
    body = "\n\n".join(f"{k}. Heading {k}\nRow {k} of the greenhouse holds {k * 3} pots, mail a{k}@b.org. " * 6 for k in range(40))
    rows = [(1, body), (2, "short"), (3, ""), (4, None), (5, "word " * 9000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_of_documents(spark):
    docs = documents(spark)
    for budget in (50, 400, 4000):
        by_rows = selection.select_spread(chunking.chunk_documents(docs), ["doc_id"], F.lit(budget))
        in_row = selection.spread_documents(docs, F.lit(budget))
        assert sorted(map(str, in_row.select(sorted(in_row.columns)).collect())) == sorted(map(str, by_rows.select(sorted(in_row.columns)).collect()))
        assert "Exchange" not in plan(in_row)


def test_redaction_of_documents(spark):
    docs = documents(spark)
    in_row = files.redacted_documents(docs)
    by_rows = files.redacted_copies(paginate(docs))
    assert sorted(map(str, in_row.collect())) == sorted(map(str, by_rows.collect()))
    assert "Exchange" not in plan(in_row)


def test_items_of_a_hot_document(spark):
    """One document has most pages and items; values with and without figures, cited rightly or not."""
    pages = [(1, k, f"S{k}", f"Row {k} costs £{k},000 for {k % 7} days, called Plot{'ABCDEFG'[k % 7]}.") for k in range(1, 600)] + [(2, 1, "S1", "nothing")]
    sources = spark.createDataFrame(pages, "doc_id int, source_order int, source_id string, text string")
    items, want = [], {}
    for k in range(1, 600):
        cited = k if k % 3 else k + 1
        value = f"£{k},000" if k % 4 else f"£{k + 1000},000"
        items.append((1, k, f"Price {k}", value, f"s{cited}"))
        want[k] = f"S{k}" if k % 4 else None
    items += [(1, 1000, "Name", "called PlotC", "S9"), (1, 1001, "Name", "called PlotZ", "S2"), (2, 1, "Any", "£3,000", "S1"), (2, 2, "", "nothing", "S1")]
    want |= {1000: "S9" if 9 % 7 == 2 else "S2", 1001: None}
    df = spark.createDataFrame(items, "doc_id int, item_no int, label string, value string, source string")
    rows = verify.verify_items(df, sources, ["doc_id"]).collect()
    got = {r.item_no: r.source if r.verified else None for r in rows if r.doc_id == 1}
    assert got == want
    assert [(r.item_no, r.verified) for r in rows if r.doc_id == 2] == [(1, False)]
