"""Column expressions for words, matching and headings. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------
STOPWORDS = (
    "a an and are as at be been being but by can could did do does for from had has have how i if in into is it its "
    "may me might must my no nor not of on or our shall should so such than that the their them then there these they "
    "this those to was we were what when where which who whom why will with would you your about any all also each "
    "per please tell explain describe give show list document doc file say says said mean means meaning "
    "elaborate clarify simply simpler more again detail details further expand"
).split()
SUFFIXES = ["ations", "ation", "ings", "ing", "ies", "ied", "ed", "es", "s", "ly"]
UNDOUBLED = "bcdfghjkmnpqrtvwxy"
HEADING_CASELESS = r"^(?:section|clause|article|schedule|annex|appendix|part|chapter){ws}+[\w.]+{wb}.{{0,80}}\z"
HEADING_NUMBERED = r"^\d+(?:\.\d+){{0,3}}[.)]?{ws}+[A-Z][^.!?]{{0,80}}\z"
HEADING_CAPITALS = r"^[A-Z][A-Z0-9 ,&/'()\-]{3,70}\z"
SUMMARY_WORDS = (
    r"(summar(y|ise|ize|ising|izing)|overview|recap|rundown|nutshell|highlights|tl;?dr|outline|gist|"
    r"key (points|terms|takeaways|clauses|provisions)|main points|"
    r"what is (this|the) (document|file|agreement|contract) about)"
)
FOLLOW_UP_START = r"(and|but|also|so|then|what about|how about|why)"
FOLLOW_UP_WORDS = r"(it|its|they|them|their|those|that one|the same|above|previous|earlier)"
# --------------------------------------------------------------------------------------------

# White space as the source texts' own rules understand it: ASCII blanks plus the Unicode spaces,
# which Java's \s leaves out.
_SPACES = " \t\n\x0b\f\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
SPACE_SET = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{SPACE_SET}]"
# ASCII word boundary. Java's \b takes accented letters for word characters up to JDK 18 and not
# after, so the boundary is spelled out to give the same spans on every runtime.
WB = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

_QUOTES_AND_DASHES = ("‘’‚‛“”„‟‐‑‒–—―", "''''\"\"\"\"------")


def ascii_boundaries(pattern: str) -> str:
    """Rewrites ``\\b`` and ``\\s`` of a pattern to the runtime-independent forms."""
    return pattern.replace(r"\b", WB).replace(r"\s", WS)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once: expressions inside a lambda are not shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(col: Column) -> Column:
    return F.btrim(col, F.lit(_SPACES))


def decomposed(col: Column) -> Column:
    """NFKD. Spark has no built-in for it, but ships ICU, whose one-call form ``reflect`` can reach.

    ``reflect`` counts as non-deterministic for the optimiser: keep it in a projection, not inside
    an aggregate or a join condition.
    """
    call = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(col, F.lit("")), F.lit(True))
    return F.when(col.rlike(r"[^\x00-\x7f]"), call).otherwise(F.coalesce(col, F.lit("")))


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(decomposed(F.lower(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def is_term(word: Column) -> Column:
    return ~word.isin(*STOPWORDS) & ((F.length(word) >= 2) | word.rlike("[0-9]"))


def _ending(word: Column) -> Column:
    """Characters of the ending that a word loses."""
    cut = F.lit(0)
    for ending in reversed(SUFFIXES):
        cut = F.when(word.endswith(ending) & (F.length(word) >= len(ending) + 3), len(ending)).otherwise(cut)
    return cut


def _whole(word: Column) -> Column:
    return (F.length(word) <= 4) | word.rlike("[0-9]")


def _mended(word: Column, cut: Column, base: Column) -> Column:
    """``base``, what is left of a word without its ending: ``y`` put back, a doubled consonant made single."""
    last = F.substring(base, -1, 1)
    doubled = (F.substring(base, -2, 1) == last) & (F.instr(F.lit(UNDOUBLED), last) > 0)
    ends_y = (cut == 3) & (word.endswith("ies") | word.endswith("ied"))
    return (
        F.when(ends_y, F.concat(base, F.lit("y")))
        .when(doubled, F.substring(base, F.lit(1), F.length(base) - 1))
        .otherwise(base)
    )


def stem(word: Column) -> Column:
    """Drops one ending, longest first, if three letters stay; plain comparisons, no regex."""
    cut = _ending(word)
    base = F.substring(word, F.lit(1), F.length(word) - cut)
    return F.when(_whole(word) | (cut == 0), word).otherwise(_mended(word, cut, base))


def _stem_bound(word: Column) -> Column:
    """``stem`` for use inside a lambda, where the ending would be worked out again at each mention."""

    def without(cut: Column) -> Column:
        base = F.substring(word, F.lit(1), F.length(word) - cut)
        return F.when(cut == 0, word).otherwise(bound(base, lambda b: _mended(word, cut, b)))

    return F.when(_whole(word), word).otherwise(bound(_ending(word), without))


def term_words(text: Column) -> Column:
    """Words that count as terms, not yet stemmed; stem after an explode where generated code runs."""
    return F.filter(raw_words(text), is_term)


def tokens(text: Column) -> Column:
    """Stemmed terms of a text in order, for short texts (questions, sentences, passages)."""
    return F.transform(term_words(text), _stem_bound)


def match_form(text: Column) -> Column:
    """Lower-case text with plain quotes, dashes and single spaces, for containment checks."""
    plain = F.translate(decomposed(F.lower(text)), *_QUOTES_AND_DASHES)
    # White space and all that is dropped go in one pass; only plain blanks are left to trim.
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}%.,'\"\-]+", " "))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 3).cast("int")


def passage_cost(text: Column) -> Column:
    return token_estimate(text) + 16


_HEADINGS = "|".join(
    ["(?i:" + HEADING_CASELESS.format(ws=WS, wb=WB) + ")", HEADING_NUMBERED.format(ws=WS), HEADING_CAPITALS]
)


def heading_of_trimmed(text: Column) -> Column:
    """The line as a heading, or null; the length test comes first and settles most lines."""
    return F.when(
        F.length(text).between(3, 100), F.when(text.rlike(_HEADINGS), F.regexp_replace(text, f"{WS}+", " "))
    )


def heading(line: Column) -> Column:
    return bound(trimmed(line), heading_of_trimmed)


def sentences_of(paragraph: Column) -> Column:
    """Pieces that end in ``. ! ? ;`` before a space or the end.

    A piece can only succeed where it starts right after a terminator, so the look-behind and the
    possessive run keep the match linear in the text.
    """
    pattern = rf"(?<![^.!?;])[^.!?;]++(?:[.!?;]+(?={WS}|\z)|\z)"
    parts = bound(
        F.regexp_extract_all(paragraph, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(paragraph)),
    )
    return F.filter(F.transform(parts, trimmed), lambda s: s != "")


def embedding_text(section: Column, text: Column) -> Column:
    return F.when(section.isNotNull() & ~text.startswith(section), F.concat(section, F.lit("\n"), text)).otherwise(text)


def keyword_text(section: Column, text: Column, weight: int = 3) -> Column:
    return F.when(section.isNotNull(), F.concat(F.repeat(F.concat(section, F.lit("\n")), weight), text)).otherwise(text)


def page_label(file: Column, page: Column) -> Column:
    return F.concat_ws(" ", file, F.concat(F.lit("p. "), page))


def is_summary_request(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + WB + SUMMARY_WORDS + WB), F.lit(False))


def search_text(question: Column, previous: Column) -> Column:
    """The question, with the previous one appended when it reads like a follow-up."""
    follow_up = (
        question.rlike(f"(?i)^{WS}*{FOLLOW_UP_START}{WB}|{WB}{FOLLOW_UP_WORDS}{WB}") | (F.size(tokens(question)) <= 1)
    )
    has_previous = previous.isNotNull() & (previous != "")
    return F.when(has_previous & follow_up, F.concat(question, F.lit("\n"), previous)).otherwise(question)


def thread_title(first_message: Column) -> Column:
    return F.when(F.length(first_message) > 40, F.concat(F.substring(first_message, 1, 40), F.lit("…"))).otherwise(
        first_message
    )


def without_reasoning(text: Column) -> Column:
    """Drops a leading ``<think>`` block; one that never closes leaves nothing."""
    return F.regexp_replace(text, r"(?s)^\s*<think>(?:.*?</think>\s*|.*\z)", "")
