"""Amounts, percentages, durations and dates: verbatim candidates and table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.spans import overlaps, spans
from parchment.functions.text import WB, WS, bound, trimmed
from parchment.operators.scan import by_key

# What counts as a figure ------------------------------------------------------
MONTHS = (
    "(?:January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)"
)
UNIT = rf"(?:business{WS}+|calendar{WS}+|working{WS}+)?(?:days?|weeks?|months?|years?|hours?)"
# A figure's first digit is read before the look-behind, which then runs at digits only; runs of letters are
# possessive, as nothing that may follow them is a letter.
DIGIT = r"\d(?<!\w\d)"
PATTERNS = [
    ("amount", rf"(?i)[£$€]{WS}?\d[\d,]*(?:\.\d+)?(?:{WS}?(?:million|billion|bn|m|k)(?!\w))?"),
    ("amount", rf"(?i){DIGIT}[\d,]*(?:\.\d+)?{WS}?(?:GBP|USD|EUR|pounds|dollars|euros)(?!\w)"),
    ("percent", rf"(?i){DIGIT}\d*(?:\.\d+)?{WS}?(?:%|per{WS}?cent(?!\w))"),
    ("duration", rf"(?i)(?:(?<!\w)[a-z]++(?:-[a-z]++)?{WS}|(?=\()(?<=\w))\(\d+\){WS}*{UNIT}"),
    ("duration", rf"(?i){DIGIT}\d*{WS}*{UNIT}(?!\w)"),
    ("date", rf"(?i){DIGIT}\d?(?:st|nd|rd|th)?{WS}+{MONTHS}{WS}+\d{{4}}(?!\w)"),
    ("date", rf"(?i)(?=[jfmasond])(?<!\w){MONTHS}{WS}+\d{{1,2}},?{WS}+\d{{4}}(?!\w)"),
]
DENSITY = (
    rf"(?i)[£$€]{WS}?\d|\d+(?:\.\d+)?{WS}?%"
    rf"|(?<!\w)\d{{1,2}}(?:st|nd|rd|th)?{WS}+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*(?!\w)"
    r"|(?<!\w)(?:19|20)\d{2}(?!\w)"
    rf"|\(\d+\){WS}*(?:days?|weeks?|months?|years?|hours?)"
    rf"|(?<!\w)\d+{WS}*(?:days?|weeks?|months?|years?|hours?)(?!\w)"
)
KIND_LABELS = {"amount": "amount", "percent": "percentage", "duration": "duration", "date": "date"}
KIND_WORDS = {
    "amount": r"(amounts?|fees?|prices?|costs?|money|monetary|caps?|limits?|charges?|payments?|sums?)",
    "percent": r"(percent|percentages?|rates?|interest)",
    "duration": r"(durations?|periods?|notice|deadlines?|time\s+limits?|terms?|days|months|years)",
    "date": r"(dates?|deadlines?|when)",
}
FIGURE_WORDS = (
    r"(amounts?|fees?|figures?|numbers?|prices?|costs?|dates?|deadlines?|durations?|periods?|percent|percentages?"
    r"|caps?|limits?|thresholds?|terms?|notice|time\s+limits?|money|monetary|values?|key\s+data)"
)
FACT_WORDS = (
    r"(obligations?|part(?:y|ies)|names?|who|responsibilit(?:y|ies)|duties|rights|defined\s+terms|definitions?)"
)
# --------------------------------------------------------------------------------------------

CANDIDATE_LIMIT = 24
ROW_LIMIT = 40
SNIPPET = 110
_SPAN = "array<struct<start:int,end:int,value:string,kind:string>>"


def _whole_word(words: str) -> str:
    return "(?i)" + WB + words.replace(r"\s", WS) + WB


def figure_density(text: Column) -> Column:
    return F.regexp_count(text, F.lit(DENSITY))


def figure_spans(text: Column) -> Column:
    """Figures in text order; of overlapping matches the longest stays, the first on equal length."""
    def typed(kind: str, pattern: str) -> Column:
        return F.transform(
            spans(text, pattern),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(kind).alias("kind")),
        )

    found = [typed(kind, pattern) for kind, pattern in PATTERNS]

    def keep(taken: Column, new: Column) -> Column:
        beaten = F.exists(
            taken, lambda t: overlaps(new, t) & ((t["end"] - t["start"]) >= (new["end"] - new["start"]))
        )
        return F.when(beaten, taken).otherwise(F.array_append(F.filter(taken, lambda t: ~overlaps(new, t)), new))

    longest = F.aggregate(F.concat(*found), F.array().cast(_SPAN), keep)
    # What stays does not overlap, so the starts, which come first in the structs, give the order.
    return F.when(text.rlike("[0-9]"), F.array_sort(longest)).otherwise(F.array().cast(_SPAN))


def sentence_around(text: Column, start: Column, end: Column, stops: Column) -> Column:
    """The sentence that holds a span. ``stops`` are the spans of ". " not after a digit."""
    before = F.array_max(F.transform(F.filter(stops, lambda s: s["start"] < start), lambda s: s["end"]))
    after = F.array_min(F.transform(F.filter(stops, lambda s: s["start"] >= end), lambda s: s["start"] + 1))
    begin = F.coalesce(before, F.lit(0))
    sentence = trimmed(F.substring(text, begin + 1, F.coalesce(after, F.length(text)) - begin))
    return F.regexp_replace(sentence, rf"^\d+(?:\.\d+)*\.?{WS}+(?=[A-Z])", "")


def candidates(
    sources: DataFrame,
    scope: list[str],
    order: str = "source_order",
    source_id: str = "source_id",
    limit: int = CANDIDATE_LIMIT,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Figures of each scope's sources, repeats dropped, the first ``limit`` per scope (a feature).

    A scope's sources meet in one task as texts, several times smaller than their figures with sentences; what
    follows stays there. Figures of a scope of many sources are moved instead: repeats are settled by a minimum per
    (scope, value, sentence), which combines before the shuffle.
    """
    dealt = by_key(sources.select(*scope, order, source_id, *carry, "text"), scope)
    found = _first_figures(dealt.whole, scope, order, source_id, limit, carry)
    return found if dealt.large is None else found.unionByName(_first_figures(dealt.large, scope, order, source_id, limit, carry))


def _first_figures(sources: DataFrame, scope: list[str], order: str, source_id: str, limit: int, carry: tuple[str, ...]) -> DataFrame:
    text = F.col("text")
    found = sources.select(
        *scope,
        order,
        source_id,
        *carry,
        "text",
        bound(
            spans(text, rf"(?<!\d)\.{WS}"),
            lambda stops: F.transform(
                figure_spans(text),
                lambda s: F.struct(
                    s["start"].alias("start"),
                    trimmed(s["value"]).alias("value"),
                    s["kind"].alias("kind"),
                    sentence_around(text, s["start"], s["end"], stops).alias("context"),
                ),
            ),
        ).alias("figures"),
    )
    found = found.select(*scope, order, source_id, *carry, F.explode_outer("figures").alias("f"))
    found = found.where(F.col("f").isNotNull())
    first = (
        found.groupBy(*scope, F.lower("f.value").alias("_value"), F.lower("f.context").alias("_context"))
        .agg(
            F.min(
                F.struct(
                    order, F.col("f.start"), F.col("f.value"), F.col("f.kind"), F.col(source_id), F.col("f.context"), *carry
                )
            ).alias("first")
        )
        .select(*scope, "first.*")
    )
    in_order = Window.partitionBy(*scope).orderBy(order, "start")
    return (
        first.withColumn("n", F.row_number().over(in_order))
        .where(F.col("n") <= limit)
        .withColumn("candidate_id", F.concat(F.lit("C"), F.col("n")))
    )


def clean_heading(section: Column) -> Column:
    bare = F.regexp_replace(
        F.coalesce(section, F.lit("")), rf"(?i)^(?:section|clause|article)?{WS}*\d+(?:\.\d+)*[.)]?{WS}*", ""
    )
    return trimmed(bare)


def context_snippet(sentence: Column, value: Column, most: int = SNIPPET) -> Column:
    at = F.greatest(F.lit(0), F.instr(sentence, value) - 1)
    start = F.greatest(F.lit(0), at - F.floor((F.lit(most) - F.length(value)) / 2).cast("int"))

    def cut(begin: Column) -> Column:
        return F.concat(
            F.when(begin > 0, F.lit("…")).otherwise(F.lit("")),
            trimmed(F.substring(sentence, begin + 1, F.lit(most))),
            F.when(begin + most < F.length(sentence), F.lit("…")).otherwise(F.lit("")),
        )

    return F.when(F.length(sentence) <= most, sentence).otherwise(bound(start, cut))


def figure_rows(
    sources: DataFrame, scope: list[str], kinds: Column | None = None, order: str = "source_order"
) -> DataFrame:
    """Figures as table rows: category, label (section heading or first six words), value, context."""
    found = candidates(sources, scope, order=order, limit=ROW_LIMIT, carry=("section",))
    if kinds is not None:
        found = found.where(F.array_contains(kinds, F.col("kind")))
    heading = clean_heading(F.col("section"))
    labelled = found.withColumn("heading", heading).withColumn(
        "sentence",
        F.when(
            (F.col("heading") != "") & F.col("context").startswith(F.col("heading")),
            trimmed(F.substring(F.col("context"), F.length("heading") + 1, F.length("context"))),
        ).otherwise(F.col("context")),
    )
    category = F.col("kind")
    for kind, label in KIND_LABELS.items():
        category = F.when(F.col("kind") == kind, label).otherwise(category)
    words = F.array_join(F.slice(F.split("sentence", f"{WS}+"), 1, 6), " ")
    return labelled.select(
        *scope,
        "n",
        category.alias("category"),
        F.when(F.col("heading") != "", F.col("heading")).otherwise(words).alias("label"),
        "value",
        F.col("source_id").alias("source"),
        F.col("context").alias("quote"),
        context_snippet(F.col("sentence"), F.col("value")).alias("context"),
    )


def extraction_plan(question: Column) -> dict[str, Column]:
    """``figures``, ``facts`` and ``kinds`` a request needs; a request naming neither gets all."""
    figures = question.rlike(_whole_word(FIGURE_WORDS))
    facts = question.rlike(_whole_word(FACT_WORDS))
    every = F.array(*[F.lit(k) for k in KIND_WORDS])
    named = F.array_compact(
        F.array(*[F.when(question.rlike(_whole_word(words)), F.lit(k)) for k, words in KIND_WORDS.items()])
    )
    neither = ~figures & ~facts
    return {
        "figures": figures | neither,
        "facts": facts | neither,
        "kinds": F.when(figures & (F.size(named) > 0), named).otherwise(every),
    }
