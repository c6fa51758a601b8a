"""Cheaper forms of text functions against the plain forms they stand for, and the work they save."""

import random

import pytest
from pyspark.sql import functions as F

from parchment.functions import citations as C
from parchment.functions import spans as S
from parchment.functions import text as T
from parchment.operators import figures as G

WB, WS = T.WB, T.WS
PLAIN = [
    G.PATTERNS[0][1],
    rf"(?i)(?<!\w)\d[\d,]*(?:\.\d+)?{WS}?(?:GBP|USD|EUR|pounds|dollars|euros)(?!\w)",
    rf"(?i)(?<!\w)\d+(?:\.\d+)?{WS}?(?:%|per{WS}?cent(?!\w))",
    rf"(?i){WB}(?:[a-z]+(?:-[a-z]+)?{WS})?\(\d+\){WS}*{G.UNIT}",
    rf"(?i)(?<!\w)\d+{WS}*{G.UNIT}(?!\w)",
    rf"(?i)(?<!\w)\d{{1,2}}(?:st|nd|rd|th)?{WS}+{G.MONTHS}{WS}+\d{{4}}(?!\w)",
    rf"(?i)(?<!\w){G.MONTHS}{WS}+\d{{1,2}},?{WS}+\d{{4}}(?!\w)",
]
PIECES = (
    "12 3 1,200.50 2024 7th May MAY sept june 31 (30) (5) thirty-five a-b x_9 days Day months per cent % GBP usd pounds £ $ 2.5 "
    "and clause S7 s 12.3 article _ é £9m k million - . , ! “ ” ' \" running studies hopping flies action"
).split() + ["7 May 2024", "May 7, 2024", "31st sept 1999", " ", " ", " ", "\n", " ", "\x01", "\x02", "😀"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    rows = ["".join(rng.choice(PIECES) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    return spark.createDataFrame([(t,) for t in [*rows, None]], "text string").cache()


def _differ(texts, a, b):
    return texts.where(~a.eqNullSafe(b)).count()


@pytest.mark.parametrize("at", range(len(PLAIN)))
def test_figure_patterns_find_the_same(texts, at):
    t = F.col("text")
    of = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    assert texts.where(F.size(of(PLAIN[at])) > 0).count() > 20
    assert _differ(texts, of(PLAIN[at]), of(G.PATTERNS[at][1])) == 0
    plain = F.when(t.isNotNull(), S._split_spans(t, PLAIN[at])).otherwise(F.array().cast(S.SPAN))
    assert _differ(texts, plain, S.spans(t, G.PATTERNS[at][1])) == 0


def test_forms_are_the_same(texts):
    t = F.col("text")
    old = F.translate(T.decomposed(F.lower(t)), *T._QUOTES_AND_DASHES)
    old = F.regexp_replace(old, r"[^\p{L}\p{N}%.,'\"\-" + T.SPACE_SET + "]", " ")
    assert _differ(texts, T.trimmed(F.regexp_replace(old, f"{WS}+", " ")), T.match_form(t)) == 0
    clause = rf"(?i){WB}(?:S|section|clause|article|schedule|annex|para(?:graph)?){WS}*\d+(?:\.\d+)*"
    assert _differ(texts, F.regexp_replace(t, clause, " "), F.regexp_replace(t, C.CLAUSE_REFERENCE, " ")) == 0
    assert _differ(texts, F.transform(T.term_words(t), T.stem), T.tokens(t)) == 0


def _searches(spark, column, pattern):
    """How often the plan of ``column`` searches for ``pattern``."""
    plan = spark.createDataFrame([("x",)], "text string").select(column.alias("x"))._jdf.queryExecution().analyzed().toString()
    return plan.count(pattern)


def test_a_match_is_searched_for_once(spark):
    found = _searches(spark, S.spans(F.col("text"), "qqq"), "qqq")
    assert found == 1 + 2  # the marked search, and two where the text holds a mark
    assert _searches(spark, C.numbers(F.regexp_replace("text", "qqq", "")), "qqq") == 1
