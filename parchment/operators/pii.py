"""Personal identifiers with a recognisable format: find, validate, redact, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.spans import overlaps, spans
from parchment.functions.text import WB, WS, bound, page_label
from parchment.session import stored

# Formats of the identifiers, most specific first ------------------------------
EMAIL = WB + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + WB
IBAN = rf"(?<!\w)[A-Z]{{2}}\d{{2}}(?:{WS}?[A-Z0-9]{{4}}){{2,7}}(?:{WS}?[A-Z0-9]{{1,3}})?(?!\w)"
CARD = r"(?<!\w)(?:\d[ -]?){12,18}\d(?!\w)"
UK_NI = rf"(?<!\w)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]{WS}?\d{{2}}{WS}?\d{{2}}{WS}?\d{{2}}{WS}?[A-D](?!\w)"
US_SSN = r"(?<!\w)\d{3}-\d{2}-\d{4}(?!\w)"
PHONE_INTERNATIONAL = rf"\+\d{{1,3}}(?:[.\-{WS[1:-1]}]?\(?\d{{1,4}}\)?){{2,5}}{WB}"
PHONE_NATIONAL = (
    rf"(?:\(\d{{3,5}}\){WS}?|(?<!\w)0[1-9]\d{{1,3}}[.\-{WS[1:-1]}]?|(?<!\w)\d{{3}}[.-])"
    rf"\d{{3,4}}[.\-{WS[1:-1]}]?\d{{3,4}}(?!\w)"
)
IP = r"(?<!\w)(?:\d{1,3}\.){3}\d{1,3}(?!\w)"
NI_PREFIXES_NOT_ISSUED = r"^(BG|GB|NK|KN|TN|NT|ZZ)"
ONE_DIGIT_REPEATED = r"^(\d)\1+$"
# --------------------------------------------------------------------------------------------

HIT = "array<struct<type:string,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def iban_valid(value: Column) -> Column:
    """ISO 7064 mod 97 on the rearranged code, letters counting 10 to 35."""
    code = F.upper(F.regexp_replace(value, f"{WS}+", ""))

    def remainder(iban: Column) -> Column:
        turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

        def step(rest: Column, ch: Column) -> Column:
            letter = ch >= "A"
            number = F.ascii(ch) - F.when(letter, 55).otherwise(48)
            return ((rest * F.when(letter, 100).otherwise(10) + number) % 97).cast("int")

        return F.length(iban).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)

    return bound(code, remainder)


def card_valid(value: Column) -> Column:
    return bound(
        _digits(value),
        lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d) & ~d.rlike(ONE_DIGIT_REPEATED),
    )


def ni_valid(value: Column) -> Column:
    return ~F.regexp_replace(value, WS, "").rlike(NI_PREFIXES_NOT_ISSUED)


def ssn_valid(value: Column) -> Column:
    area, group, serial = F.substring(value, 1, 3), F.substring(value, 5, 2), F.substring(value, 8, 4)
    return ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")


def phone_valid(value: Column) -> Column:
    return bound(_digits(value), lambda d: F.length(d).between(10, 15) & ~d.rlike(ONE_DIGIT_REPEATED))


def ip_valid(value: Column) -> Column:
    return F.forall(
        F.split(value, r"\."), lambda o: (o.cast("int") <= 255) & (o.cast("int").cast("string") == o)
    )


def _detectors(text: Column) -> list[tuple[str, Column, str, object]]:
    """(type, cheap test, pattern, validity check) in order of priority."""
    digit = text.rlike("[0-9]")
    return [
        ("email", F.contains(text, F.lit("@")), EMAIL, None),
        ("iban", digit, IBAN, iban_valid),
        ("card", digit, CARD, card_valid),
        ("uk_ni", digit, UK_NI, ni_valid),
        ("us_ssn", digit, US_SSN, ssn_valid),
        ("phone", F.contains(text, F.lit("+")), PHONE_INTERNATIONAL, phone_valid),
        ("phone", digit, PHONE_NATIONAL, phone_valid),
        ("ip", digit, IP, ip_valid),
    ]


def find_pii(text: Column) -> Column:
    """Valid, non-overlapping identifiers in text order; earlier detectors claim their span first."""
    def detected(kind: str, pattern: str, valid) -> Column:
        hits = spans(text, pattern)
        if valid is not None:
            hits = F.filter(hits, lambda h: valid(h["value"]))
        return F.transform(
            hits,
            lambda h: F.struct(
                F.lit(kind).alias("type"), h["start"].alias("start"), h["end"].alias("end"), h["value"].alias("value")
            ),
        )

    found = [
        F.when(test, detected(kind, pattern, valid)).otherwise(F.array().cast(HIT))
        for kind, test, pattern, valid in _detectors(text)
    ]

    def claim(taken: Column, hit: Column) -> Column:
        return F.when(F.exists(taken, lambda t: overlaps(t, hit)), taken).otherwise(F.array_append(taken, hit))

    claimed = F.aggregate(F.concat(*found), F.array().cast(HIT), claim)
    ordered = F.array_sort(
        claimed, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    )
    suspect = text.rlike("[@0-9]")
    return F.when(suspect, ordered).otherwise(F.array().cast(HIT))


def placeholder(kind: Column) -> Column:
    return F.concat(F.lit("["), F.upper(kind), F.lit(" REDACTED]"))


def redact_hits(text: Column, hits: Column) -> Column:
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, hit: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, hit["start"] - state["at"])
        return F.struct(F.concat(state["out"], kept, placeholder(hit["type"])).alias("out"), hit["end"].alias("at"))

    return F.aggregate(
        hits,
        start,
        step,
        lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))),
    )


def redact(text: Column) -> Column:
    return bound(find_pii(text), lambda hits: F.when(F.size(hits) > 0, redact_hits(text, hits)).otherwise(text))


def mask(value: Column) -> Column:
    """Up to two characters stay at each end; other letters and digits become bullets."""
    keep = F.least(F.lit(2), F.floor(F.length(value) / 4).cast("int"))
    middle = F.substring(value, keep + 1, F.length(value) - 2 * keep)
    return F.concat(
        F.substring(value, F.lit(1), keep),
        F.regexp_replace(middle, "[A-Za-z0-9]", "•"),
        F.substring(value, F.length(value) - keep + 1, keep),
    )


def scan(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per finding: keys, type, start, end, value. Narrow; most pages yield nothing."""
    # The outer form keeps the optimiser from testing the array first, which would find it twice.
    found = pages.select(*keys, F.explode_outer(find_pii(F.col(text))).alias("hit"))
    return found.where(F.col("hit").isNotNull()).select(*keys, "hit.*")


def counts(findings: DataFrame, document: str) -> DataFrame:
    """Findings per document and type, with each document's total in the row where type is null."""
    return (
        findings.groupingSets([[document, "type"], [document]], document, "type")
        .agg(F.count("*").alias("findings"))
        .select(document, "type", "findings")
    )


def report(
    findings: DataFrame, document: str, page: str = "page", file: str | None = None, documents: DataFrame | None = None
) -> DataFrame:
    """Per document and type: count, first eight distinct pages, first two masked examples.

    With ``documents``, those without a finding have one row with a null type and no findings.
    The lists come from rank limits, so a document full of findings is never gathered. Findings are
    few next to the texts and needed three times: they are stored first, and the texts read once.
    """
    findings = stored(findings, "pii-findings")
    keys = [document, "type"]
    totals = findings.groupBy(*keys).agg(F.count("*").alias("findings"))
    label = page_label(F.col(file), F.col(page).cast("string")) if file else F.col(page).cast("string")
    by_page = findings.groupBy(*keys, label.alias("label")).agg(F.min(F.struct(page, "start")).alias("first"))
    in_order = Window.partitionBy(*keys).orderBy("first")
    pages = (
        by_page.withColumn("n", F.row_number().over(in_order))
        .where("n <= 8")
        .groupBy(*keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]), ", ").alias("pages"))
    )
    first = Window.partitionBy(*keys).orderBy(page, "start")
    examples = (
        findings.withColumn("n", F.row_number().over(first))
        .where("n <= 2")
        .groupBy(*keys)
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("n", mask(F.col("value")).alias("m")))), lambda x: x["m"]),
                ", ",
            ).alias("examples")
        )
    )
    rows = totals.join(pages, keys).join(examples, keys)
    if documents is None:
        return rows
    clean = documents.select(document).distinct().join(findings.select(document).distinct(), document, "left_anti")
    none = F.lit(None).cast("string")
    return rows.unionByName(
        clean.select(document, none.alias("type"), F.lit(0).cast("long").alias("findings"), none.alias("pages"), none.alias("examples"))
    )


def redact_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.withColumn(text, redact(F.col(text)))
