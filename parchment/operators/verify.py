"""Answers against the sources they were given: citations, quotes, figures, attribution.

An answer may have any number of sources. Every source row meets its own answer in one equi join, on
the answer and a block of the sources' order, and gives facts: figures and cited ids it holds, and
the sentences it covers. Facts are few (an answer bounds them) and combine before they are shuffled;
sources are never gathered. Quotes are looked up in windows of the sources' joined text, so one that
runs on from a source into the next is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import citations as C
from parchment.functions.text import bound, match_form, tokens, trimmed
from parchment.session import fits_broadcast

MIN_OVERLAP = 0.6
GRAM = 4
FIGURE_BONUS = 0.25
MIN_WORDS = 3
# Sources of an answer that share a join key, and characters of its joined text that are searched at once.
SOURCE_BLOCK = 256
WINDOW_CHARS = 8192
# Answers of at most this size are sent to every executor, as about four times as many bytes.
ANSWER_BYTES = 4 << 20

_ISSUE = "array<struct<kind:string,detail:string>>"
_TEXTS = "array<string>"


def _answer() -> Column:
    return F.coalesce(F.col("answer"), F.lit(""))


def _quotes() -> Column:
    return F.regexp_extract_all(_answer(), F.lit(C.QUOTE), F.lit(1))


def _shingles(words: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - C.SHINGLE + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, C.SHINGLE), " "))


def _stated() -> Column:
    """Figures of the answer, references left out, as they are compared."""
    found = C.numbers(C.without_references(_answer()))
    return F.filter(F.array_distinct(F.transform(found, C.plain_figure)), lambda f: f != "")


def _open_sentences() -> Column:
    """(text, words, figures) of the sentences that carry no citation and enough words for a search."""
    uncited = F.filter(F.array_distinct(F.regexp_extract_all(_answer(), F.lit(C.SENTENCE), F.lit(0))), lambda s: ~s.rlike(C.ANY_CITATION))
    parts = F.transform(
        uncited,
        lambda s: F.struct(
            s.alias("text"), F.array_distinct(tokens(s)).alias("words"), C.figures(C.without_references(s)).alias("figures")
        ),
    )
    return F.filter(parts, lambda s: F.size(s["words"]) >= MIN_WORDS)


def _in_blocks(sources: DataFrame, answer_id: str) -> DataFrame:
    block = F.coalesce(F.floor(F.col("source_order") / SOURCE_BLOCK), F.lit(0)).cast("long")
    return sources.select(answer_id, "source_order", "source_id", "text", block.alias("_block"))


def _meet(asked: DataFrame, placed: DataFrame, answer_id: str, few: bool) -> DataFrame:
    """Sources beside what their answer asks. ``few`` answers, by rows and bytes, go to every executor; else
    an answer is repeated once per block of its sources, and the join shuffles."""
    if few:
        return placed.join(F.broadcast(asked), answer_id)
    on = [answer_id, "_block"]
    return placed.join(asked.join(placed.select(*on).distinct(), answer_id), on)


def _held_facts(answers: DataFrame, placed: DataFrame, answer_id: str, few: bool, attribute: bool = True) -> DataFrame:
    """(answer, kind, key, rank) of each source: that it is there, ids, figures and, to ``attribute`` them,
    sentences it covers."""
    asked = answers.select(answer_id, C.cited_ids(_answer()).alias("ids"), _stated().alias("stated"), _open_sentences().alias("sentences"))

    def fact(kind: str, key: Column, cost: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), cost.alias("cost"))

    def covered(words: Column, figures: Column) -> Column:
        scored = F.transform(
            "sentences",
            lambda s: fact(
                "sentence",
                s["text"],
                -(
                    F.size(F.array_intersect(s["words"], words)) / F.size(s["words"])
                    + F.when(F.arrays_overlap(s["figures"], figures), FIGURE_BONUS).otherwise(0.0)
                ),
            ),
        )
        return F.filter(scored, lambda x: x["cost"] <= -MIN_OVERLAP)

    text = F.coalesce(F.col("text"), F.lit(""))
    sentences = bound(
        F.struct(F.array_distinct(tokens(text)).alias("words"), F.array_distinct(C.figures(text)).alias("figures")),
        lambda s: covered(s["words"], s["figures"]),
    )
    known = F.transform(C.figures(C.haystack_form(text)), C.plain_figure)
    zero = F.lit(0.0)
    facts = F.concat(
        F.array(fact("source", F.lit(""), zero)),
        F.transform(F.array_intersect("ids", F.array("source_id")), lambda i: fact("id", i, zero)),
        F.when(F.size("stated") > 0, F.transform(F.array_intersect("stated", known), lambda n: fact("figure", n, zero))).otherwise(F.array()),
    )
    if attribute:
        facts = F.concat(facts, F.when((F.size("sentences") > 0) & F.col("source_id").isNotNull(), sentences).otherwise(F.array()))
    each = _meet(asked, placed, answer_id, few).select(answer_id, "source_order", "source_id", F.explode_outer(facts).alias("f"))
    return each.select(
        answer_id, "f.kind", "f.key", F.struct(F.col("f.cost").alias("cost"), F.col("source_order").alias("order"), F.col("source_id").alias("id")).alias("rank")
    )


def _quote_facts(answers: DataFrame, placed: DataFrame, answer_id: str, few: bool, window: int) -> DataFrame:
    """(answer, kind, key, rank) of the quotes and their shingles that stand in the sources' joined text.

    The texts are laid end to end by running sums of their lengths and cut into windows that overlap by
    the longest quote, so that a row holds a window, whatever the number and length of the sources.
    """
    forms = F.filter(F.transform(_quotes(), C.haystack_form), lambda q: q != "")
    needles = F.array_distinct(F.flatten(F.transform(forms, lambda q: F.concat(F.array(q), _shingles(F.split(q, " "))))))
    asked = answers.select(answer_id, needles.alias("needles")).where(F.size("needles") > 0)
    asked = asked.groupBy(answer_id).agg(F.array_distinct(F.flatten(F.collect_list("needles"))).alias("needles"))
    asked = asked.withColumn("reach", F.array_max(F.transform("needles", lambda n: F.length(n))).cast("long"))
    formed = _meet(asked, placed, answer_id, few).withColumn("form", match_form(F.coalesce("text", F.lit("")))).where("form <> ''")
    formed = formed.select(answer_id, "_block", "source_order", "source_id", "needles", "reach", F.concat(C.no_quote_marks(F.col("form")), F.lit(" ")).alias("form"))
    size = F.length("form").cast("long")
    before = Window.partitionBy(answer_id).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = formed.groupBy(answer_id, "_block").agg(F.sum(size).alias("_chars"))
    begins = begins.select(answer_id, "_block", F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(answer_id, "_block").orderBy("source_order", "source_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = formed.withColumn("_at", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(begins, [answer_id, "_block"])
    laid = laid.withColumn("start", F.col("_at") + F.col("_from")).withColumn("stop", F.col("start") + size)
    first = F.greatest(F.floor((F.col("start") - F.col("reach")) / window), F.lit(0))
    pieces = laid.withColumn("window", F.explode_outer(F.sequence(first, F.floor((F.col("stop") - 1) / window))))
    opens = F.col("window") * window
    left = F.greatest("start", opens)
    right = F.least("stop", opens + window + F.col("reach"))
    piece = F.substring("form", (left - F.col("start") + 1).cast("int"), (right - left).cast("int"))
    # The piece on which a window opens brings the quotes.
    brings = F.when((F.col("start") <= opens) & (opens < F.col("stop")), F.col("needles"))
    held = pieces.where(right > left).groupBy(answer_id, "window").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(left.alias("at"), piece.alias("piece")))), lambda p: p["piece"]), "").alias("haystack"),
        F.max(brings).alias("needles"),
    )
    hits = F.filter("needles", lambda n: F.contains(F.col("haystack"), n))
    found = held.select(answer_id, F.explode_outer(hits).alias("key")).where("key IS NOT NULL")
    nothing = F.lit(None).cast(placed.schema["source_order"].dataType)
    rank = F.struct(F.lit(0.0).alias("cost"), nothing.alias("order"), F.lit(None).cast(placed.schema["source_id"].dataType).alias("id"))
    return found.select(answer_id, F.lit("quote").alias("kind"), "key", rank.alias("rank"))


def _with_facts(
    answers: DataFrame, sources: DataFrame, answer_id: str, window: int = WINDOW_CHARS, attribute: bool = True
) -> DataFrame:
    """``answers`` with ``_facts``: whether there are sources, ids, figures and quotes they hold, and the
    best source of each uncited sentence (first in order among equals)."""
    placed = _in_blocks(sources, answer_id)
    few = fits_broadcast(answers.select(answer_id, "answer"), max_bytes=ANSWER_BYTES)
    facts = _held_facts(answers, placed, answer_id, few, attribute).unionByName(_quote_facts(answers, placed, answer_id, few, window))
    best = facts.groupBy(answer_id, "kind", "key").agg(F.min("rank").alias("rank"))
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("key")))
    winners = F.collect_list(F.when(F.col("kind") == "sentence", F.struct(F.col("key"), F.col("rank.id").cast("string").alias("id"))))
    settled = best.groupBy(F.col(answer_id)).agg(
        F.struct(
            F.lit(True).alias("any"),
            of("id").alias("ids"),
            of("figure").alias("figures"),
            of("quote").alias("quotes"),
            F.map_from_entries(winners).alias("winners"),
        ).alias("_facts")
    )
    empty = F.array().cast(_TEXTS)
    none = F.struct(
        F.lit(False).alias("any"), empty.alias("ids"), empty.alias("figures"), empty.alias("quotes"), F.create_map().cast("map<string,string>").alias("winners")
    )
    return answers.join(settled, answer_id, "left").withColumn("_facts", F.coalesce("_facts", none))


def _issue(kind: str, detail: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))


def _quote_holds(quote: Column) -> Column:
    found = F.col("_facts.quotes")

    def share(words: Column) -> Column:
        hits = F.size(F.filter(_shingles(words), lambda s: F.array_contains(found, s)))
        return (F.size(words) >= C.SHINGLE) & (hits / (F.size(words) - C.SHINGLE + 1) >= C.SHINGLE_SHARE)

    return bound(
        C.haystack_form(quote),
        lambda q: F.when((q == "") | F.array_contains(found, q), True).otherwise(bound(F.split(q, " "), share)),
    )


def _verified(asked: DataFrame) -> DataFrame:
    answer = _answer()
    known = F.concat(F.col("_facts.figures"), F.transform(C.figures(match_form(F.coalesce(F.col("question"), F.lit("")))), C.plain_figure))
    checked = asked.select(
        "*",
        C.is_abstention(answer).alias("abstained"),
        F.array_intersect(C.cited_ids(answer), F.col("_facts.ids")).alias("cited"),
        F.array_except(C.cited_ids(answer), F.col("_facts.ids")).alias("_invalid"),
        F.filter(_quotes(), lambda q: ~_quote_holds(q)).alias("_quotes"),
        bound(known, lambda k: C.figures_outside(answer, k)).alias("_figures"),
    )
    one = lambda when, issue: F.when(when, F.array(issue)).otherwise(F.array().cast(_ISSUE))
    issues = F.concat(
        one(F.size("_invalid") > 0, _issue("invalid-citation", F.array_join("_invalid", ", "))),
        one(~F.col("abstained") & F.col("_facts.any") & (F.size("cited") == 0), _issue("no-citation")),
        F.transform("_quotes", lambda q: _issue("unverified-quote", F.substring(q, 1, 80))),
        one(F.size("_figures") > 0, _issue("unsupported-number", F.array_join("_figures", ", "))),
    )
    return (
        checked.withColumn("issues", issues)
        .withColumn(
            "status",
            F.when(F.col("abstained"), "abstained").when(F.size("issues") > 0, "warning").otherwise("grounded"),
        )
        .drop("_invalid", "_quotes", "_figures")
    )


def verify_answers(answers: DataFrame, sources: DataFrame, answer_id: str = "answer_id") -> DataFrame:
    """Adds ``abstained``, ``cited``, ``issues`` and ``status`` to answers (answer, question), given their
    sources (source_order, source_id, text). A figure has to stand in one source, a quote in their joined text."""
    return _verified(_with_facts(answers, sources, answer_id, attribute=False)).drop("_facts")


def _attributed(sentence: Column) -> Column:
    """(text, id, unmatched) of one sentence; the id is null when nothing was added."""

    def outcome(text: Column, source: Column, unmatched: Column) -> Column:
        return F.struct(text.alias("text"), source.cast("string").alias("id"), unmatched.cast("string").alias("unmatched"))

    none = F.lit(None)
    ending = F.regexp_extract(sentence, r"([.!?]*)\z", 1)
    body = F.substring(sentence, F.lit(1), F.length(sentence) - F.length(ending))
    winner = F.col("_facts.winners")[sentence]
    cited = outcome(F.concat(body, F.lit(" [~"), winner, F.lit("]"), ending), winner, none)
    as_is = sentence.rlike(C.ANY_CITATION) | ~F.col("_facts.any") | (F.size(F.array_distinct(tokens(sentence))) < MIN_WORDS)
    return (
        F.when(winner.isNotNull(), cited)
        .when(as_is, outcome(sentence, none, none))
        .otherwise(outcome(sentence, none, trimmed(sentence)))
    )


def _with_attributions(verified: DataFrame) -> DataFrame:
    """Adds ``content`` (uncited sentences marked ``[~S#]``), ``auto_ids`` and ``unmatched``."""
    pieces = F.transform(F.regexp_extract_all(_answer(), F.lit(C.SENTENCE), F.lit(0)), _attributed)
    parts = verified.select("*", pieces.alias("_parts"), F.split(_answer(), C.SENTENCE, -1).alias("_gaps"))
    text = F.concat(
        F.array_join(
            F.zip_with(
                F.slice("_gaps", 1, F.size("_parts")), "_parts", lambda gap, part: F.concat(gap, part["text"])
            ),
            "",
        ),
        F.coalesce(F.get("_gaps", F.size("_parts")), F.lit("")),
    )
    return parts.select(
        *verified.columns,
        text.alias("content"),
        F.array_distinct(F.array_compact(F.transform("_parts", lambda p: p["id"]))).alias("auto_ids"),
        F.array_compact(F.transform("_parts", lambda p: p["unmatched"])).alias("unmatched"),
    )


def ground_answers(answers: DataFrame, sources: DataFrame, answer_id: str = "answer_id", window: int = WINDOW_CHARS) -> DataFrame:
    """The whole check. Adds ``content``, ``cited``, ``auto_cited``, ``issues`` and ``status``."""
    base = _verified(_with_facts(answers, sources, answer_id, window))
    done = _with_attributions(base)
    alone = ~F.col("_facts.any")
    skip = (F.col("status") == "abstained") | alone
    cited = F.array_union("cited", "auto_ids")
    kept = F.filter("issues", lambda i: i["kind"] != "no-citation")
    last = (
        F.when(F.size(cited) == 0, F.array(_issue("no-citation")))
        .when(
            F.size("unmatched") > 0,
            F.array(_issue("unsupported-sentence", F.size("unmatched").cast("string"))),
        )
        .otherwise(F.array().cast(_ISSUE))
    )
    grounded = done.select(
        *[c for c in base.columns if c not in ("cited", "issues", "status", "_facts")],
        F.when(skip, F.col("answer")).otherwise(F.col("content")).alias("content"),
        F.when(skip, F.col("cited")).otherwise(cited).alias("cited"),
        F.when(skip, F.array().cast(_TEXTS)).otherwise(F.array_except("auto_ids", "cited")).alias("auto_cited"),
        F.when(skip, F.col("issues")).otherwise(F.concat(kept, last)).alias("issues"),
        F.when(skip, F.array().cast(_TEXTS)).otherwise(F.slice("unmatched", 1, 3)).alias("unsupported"),
        F.when(skip, F.col("status")).alias("_status"),
    )
    settled = F.when(F.size("issues") > 0, "warning").otherwise("grounded")
    return grounded.withColumn("status", F.coalesce("_status", settled)).drop("_status")


def add_relevance(verified: DataFrame, ratio_issue: Column) -> DataFrame:
    """Appends an ``off-topic`` issue (its ratio as detail) and turns the status to warning."""
    flagged = ratio_issue.isNotNull() & (F.col("status") != "abstained")
    return verified.withColumn(
        "issues",
        F.when(flagged, F.array_append("issues", _issue("off-topic", ratio_issue.cast("string")))).otherwise(
            F.col("issues")
        ),
    ).withColumn("status", F.when(flagged, "warning").otherwise(F.col("status")))


def _grams(word: Column) -> Column:
    """The distinct runs of one to ``GRAM`` characters of a word."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(word) - F.lit(n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, GRAM + 1)]))


def _probes(words: Column, rows: Column) -> Column:
    """Words of a value of which every source that supports it has at least one, inside its own words;
    ``rows`` has the number of sources per word.

    A value of fewer than four words must stand in the source as a whole: its rarest word will do. Of a
    longer one a tenth of its shingles may be missing, so the rarest word of one shingle more is taken.
    """
    ranked = F.transform(
        words, lambda w: F.struct(F.when(w == "", F.lit(1 << 60)).otherwise(F.coalesce(rows[w], F.lit(0))).alias("n"), w.alias("w"))
    )

    def chosen(r: Column) -> Column:
        count = F.size(r) - (C.SHINGLE - 1)
        least = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_min(F.slice(r, i, C.SHINGLE)))
        taken = F.slice(F.array_sort(least), F.lit(1), F.greatest((count / 10).cast("int"), F.lit(0)) + 1)
        return F.array_distinct(F.transform(taken, lambda x: x["w"]))

    return bound(ranked, chosen)


def _without_figures(values: DataFrame, sources: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, value, source_order, source_id) of all sources that may hold a value without figures.

    Values meet sources in equi joins on their rarest words. As a value may begin and end inside a
    word, its words are looked up first among the distinct words of the scope, by a run of characters.
    """
    split = lambda text: F.split(C.haystack_form(C.without_clause_numbers(text)), " ")
    bare = values.select(*scope, "value", split(F.col("value")).alias("words"))
    near = sources.join(bare.select(*scope).distinct(), scope, "left_semi")
    held = near.select(*scope, "source_order", "source_id", F.explode(F.array_distinct(split(F.col("text")))).alias("word"))
    grams = held.groupBy(*scope, "word").agg(F.count(F.lit(1)).alias("n")).select(*scope, "word", "n", F.explode(_grams(F.col("word"))).alias("gram"))
    each = bare.select(*scope, "value", F.explode(F.array_distinct("words")).alias("probe")).where("probe <> ''")
    asked = each.select(*scope, "probe", F.substring("probe", 1, GRAM).alias("gram")).distinct()
    inside = asked.join(grams, [*scope, "gram"]).where(F.contains("word", F.col("probe"))).drop("gram")
    rows = each.join(inside.groupBy(*scope, "probe").agg(F.sum("n").alias("n")), [*scope, "probe"])
    rows = rows.groupBy(*scope, "value").agg(F.map_from_entries(F.collect_list(F.struct("probe", "n"))).alias("rows"))
    known = bare.join(rows, [*scope, "value"], "left").withColumn("rows", F.coalesce("rows", F.create_map().cast("map<string,bigint>")))
    chosen = known.select(*scope, "value", F.explode(_probes(F.col("words"), F.col("rows"))).alias("probe"))
    found = chosen.join(inside.drop("n"), [*scope, "probe"]).join(held, [*scope, "word"])
    # Marks only: any source may hold them.
    marks = chosen.where("probe = ''").join(near, scope)
    keep = [*scope, "value", "source_order", "source_id"]
    return found.select(*keep).unionByName(marks.select(*keep))


def _holders(values: DataFrame, sources: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Which sources hold which values: (scope, value, wanted) of cited sources that do, and the first
    source in order per (scope, value).

    A source can only hold a value if it has its longest figure, so pairs come from an equi join on
    the figure, of distinct values; a value without figures meets the sources that have its rarest
    words. Clause numbers are no figures, as in ``C.supports``. Texts join last, once, by source.
    """
    figures = lambda text: C.figures(C.without_clause_numbers(text))
    figured = sources.select(*scope, "source_order", "source_id", F.explode(F.array_distinct(figures(F.col("text")))).alias("figure"))
    longest = F.array_max(F.transform(figures(F.col("value")), lambda f: F.struct(F.length(f).alias("n"), f.alias("f"))))["f"]
    distinct = values.select(*scope, "value").distinct().withColumn("figure", longest)
    by_figure = distinct.where(F.col("figure").isNotNull()).join(figured, [*scope, "figure"]).drop("figure")
    by_word = _without_figures(distinct.where(F.col("figure").isNull()), sources, scope)
    cited = values.select(*scope, "value", F.col("wanted").alias("source_id")).distinct()
    own = sources.select(*scope, "source_order", "source_id")
    pairs = by_figure.unionByName(by_word).unionByName(cited.join(own, [*scope, "source_id"])).distinct()
    forms = sources.select(*scope, "source_order", "source_id", C.support_form(F.col("text")).alias("form"))
    held = pairs.join(forms, [*scope, "source_order", "source_id"]).where(C.supports(F.col("form"), F.col("value")))
    best = held.groupBy(*scope, "value").agg(F.min(F.struct("source_order", "source_id")).alias("first"))
    holds = held.select(*scope, "value", F.col("source_id").alias("wanted")).distinct().withColumn("cited_holds", F.lit(True))
    return holds, best.select(*scope, "value", F.col("first.source_id").alias("_first"))


def verify_items(items: DataFrame, sources: DataFrame, scope: list[str], item_no: str = "item_no") -> DataFrame:
    """Extracted rows with the source that really holds their value; duplicates dropped.

    The cited source counts if it holds the value, else the first one that does. No scope's sources
    are gathered, however many it has.
    """
    formed = items.where(
        (trimmed(F.coalesce("value", F.lit(""))) != "") & (trimmed(F.coalesce("label", F.lit(""))) != "")
    ).withColumn("wanted", F.upper(trimmed(F.coalesce("source", F.lit("")))))
    holds, best = _holders(formed, sources, scope)
    held = formed.join(holds, [*scope, "value", "wanted"], "left").join(best, [*scope, "value"], "left")
    settled = held.withColumn("_holder", F.when(F.col("cited_holds"), F.col("wanted")).otherwise(F.col("_first")))
    settled = settled.select(*items.columns, "_holder")
    norm = lambda c: trimmed(F.regexp_replace(F.lower(c), r"\s+", " "))
    # First of each (label, value, source): one aggregate that keeps the whole row, so that rows are
    # checked once and repeats combine before the shuffle.
    rest = [c for c in settled.columns if c not in (*scope, item_no)]
    firsts = (
        settled.groupBy(
            *scope,
            norm(F.col("label")).alias("_label"),
            norm(F.col("value")).alias("_value"),
            F.coalesce("_holder", F.lit("?")).alias("_at"),
        )
        .agg(F.min_by(F.struct(item_no, *rest), F.col(item_no)).alias("first"))
        .select(*scope, "first.*")
    )
    return (
        firsts.withColumn("verified", F.col("_holder").isNotNull())
        .withColumn("source", F.coalesce("_holder", "source"))
        .withColumn("problem", F.when(~F.col("verified"), "value not found in any source"))
        .drop("_holder")
    )


def allowed_labels(items: DataFrame, sources: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items whose source label is one of their call's labels, and the others."""
    labels = sources.select(*scope, F.col("source_id").alias("source")).distinct()
    on = [*scope, "source"]
    return items.join(labels, on, "left_semi"), items.join(labels, on, "left_anti")


def extraction_status(verified: DataFrame, questions: DataFrame, scope: list[str]) -> DataFrame:
    """Per question: rows, unverified rows, cited sources and status."""
    totals = verified.groupBy(*scope).agg(
        F.count("*").alias("rows"),
        F.count_if(~F.col("verified")).alias("unverified"),
        F.array_sort(F.collect_set(F.when(F.col("verified"), F.col("source")))).alias("cited"),
    )
    return (
        questions.select(*scope)
        .join(totals, scope, "left")
        .select(
            *scope,
            F.coalesce("rows", F.lit(0)).alias("rows"),
            F.coalesce("unverified", F.lit(0)).alias("unverified"),
            F.coalesce("cited", F.array().cast("array<string>")).alias("cited"),
            F.when(F.col("unverified") > 0, "warning").when(F.col("rows") > 0, "grounded").otherwise("abstained").alias("status"),
        )
    )
