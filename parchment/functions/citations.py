"""Column expressions over answers: citations, quotes, figures, support by a source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions.text import WS, bound, match_form

# How answers cite, quote and abstain ------------------------------------------
CITATION_GROUP = rf"(?i)\[~?((?:S\d+)(?:{WS}*[,;&]{WS}*(?:and{WS}+)?~?S?\d+)*)\]"
ANY_CITATION = r"(?i)\[~?S\d+"
QUOTE = r"[\"“]([^\"“”]{20,400})[\"”]"
NUMBER = (
    rf"(?<![\w.])(?:[£$€]{WS}?)?\d{{1,3}}(?:[,{WS[1:-1]}]\d{{3}})+(?:\.\d+)?%?"
    rf"|(?<![\w.])(?:[£$€]{WS}?)?\d+(?:\.\d+)?%?"
)
CLAUSE_NUMBER = rf"(^|{WS})\d+(?:\.\d+)*\.?(?={WS}+[A-Z])"
PAGE_REFERENCE = rf"(?i)\((?:p|pp|page|pages)\.?{WS}*[\d{WS[1:-1]},–-]+\)"
LIST_NUMBER = rf"(?m)^{WS}*\d+[.)]{WS}+"
CLAUSE_REFERENCE = rf"(?i)(?=[scap])(?<!\w)(?:S|section|clause|article|schedule|annex|para(?:graph)?){WS}*\d+(?:\.\d+)*"
NOT_FOUND = (
    r"(?i)^\W*(?:i{ws}+(?:can['’]?t|cannot|could{ws}*not|couldn['’]?t|was{ws}+unable{ws}+to|am{ws}+unable{ws}+to){ws}+find"
    r"|(?:the{ws}+)?(?:document|sources?|excerpts?){ws}+(?:does|do){ws}*(?:not|n['’]t){ws}+"
    r"(?:contain|mention|include|specify|say|provide))"
).replace("{ws}", WS)
SHINGLE = 4
SHINGLE_SHARE = 0.9
# --------------------------------------------------------------------------------------------
# A sentence ends at . ! ? before a space or the end; citations written after the stop belong to
# it. Possessive runs: Java would otherwise recurse once per character.
_INNER = rf"[.!?](?!{WS}|\z)"
SENTENCE = rf"(?=[^\n.!?]|{_INNER})[^\n.!?]*+(?:{_INNER}[^\n.!?]*+)*+[.!?]*(?:[ \t]*\[~?S\d+[^\]\n]*\])*"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def cited_ids(answer: Column) -> Column:
    numbers = F.flatten(F.transform(_all(answer, CITATION_GROUP, 1), lambda group: _all(group, r"\d+")))
    return F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("S"), n)))


def strip_citations(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), CITATION_GROUP, "")
    return F.regexp_replace(bare, r"[ \t]+([.,;!?])", "$1")


def is_abstention(answer: Column) -> Column:
    return F.coalesce(answer.rlike(NOT_FOUND), F.lit(False))


def without_references(answer: Column) -> Column:
    """Citations, page references, list numbers and clause references blanked out."""
    text = answer
    for pattern in (CITATION_GROUP, PAGE_REFERENCE, LIST_NUMBER, CLAUSE_REFERENCE):
        text = F.regexp_replace(text, pattern, " ")
    return text


def bare_digits(figure: Column) -> Column:
    return F.regexp_replace(figure, rf"[£$€,{WS[1:-1]}]", "")


def numbers(text: Column) -> Column:
    """Figures as written."""
    return bound(text, lambda t: F.when(t.rlike("[0-9]"), _all(t, NUMBER)).otherwise(F.array().cast("array<string>")))


def figures(text: Column) -> Column:
    return F.transform(numbers(text), bare_digits)


def plain_figure(figure: Column) -> Column:
    """A figure as it is compared: digits without currency, separators or a percent sign."""
    return F.regexp_replace(bare_digits(figure), r"%\z", "")


def figures_outside(answer: Column, known: Column) -> Column:
    """Figures of an answer that ``known`` (plain figures) lacks, as written."""

    def unknown(figure: Column) -> Column:
        value = plain_figure(figure)
        return (F.length(value) > 0) & ~F.array_contains(known, value)

    return F.array_distinct(F.transform(F.filter(numbers(without_references(answer)), unknown), lambda n: F.btrim(n)))


def no_quote_marks(text: Column) -> Column:
    return F.translate(text, "\"'", "")


def haystack_form(text: Column) -> Column:
    return no_quote_marks(match_form(text))


def quote_supported(quote: Column, haystack: Column) -> Column:
    """Exact containment, or 90 % of the quote's four-word shingles."""

    def share(words: Column) -> Column:
        count = F.size(words) - SHINGLE + 1
        shingles = F.transform(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
            lambda i: F.array_join(F.slice(words, i, SHINGLE), " "),
        )
        hits = F.size(F.filter(shingles, lambda s: F.contains(haystack, s)))
        return (F.size(words) >= SHINGLE) & (hits / count >= SHINGLE_SHARE)

    return bound(
        haystack_form(quote),
        lambda q: F.when(q == "", True).when(F.contains(haystack, q), True).otherwise(bound(F.split(q, " "), share)),
    )


def without_clause_numbers(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CLAUSE_NUMBER, "$1")


def support_form(source_text: Column) -> Column:
    """A source prepared once for ``supports``: its matching form and its figures."""
    return bound(
        without_clause_numbers(source_text), lambda t: F.struct(haystack_form(t).alias("haystack"), F.array_distinct(figures(t)).alias("figures"))
    )


def supports(prepared: Column, quote: Column) -> Column:
    """True when the prepared source holds the quote, every figure of it exactly."""
    return bound(
        without_clause_numbers(quote),
        lambda q: F.when(F.size(F.array_except(figures(q), prepared["figures"])) > 0, False).otherwise(
            quote_supported(q, prepared["haystack"])
        ),
    )
