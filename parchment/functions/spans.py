"""Match positions. Spark's regex functions return texts only; a split with the same pattern gives
the gaps between matches, and running lengths of both give every span."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions.text import bound

SPAN = "array<struct<start:int,end:int,value:string>>"


_OPEN, _CLOSE = "\x01", "\x02"


def _split_spans(text: Column, pattern: str) -> Column:
    """Matches and the gaps between them by two searches, whatever characters the text has."""

    def located(matches: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        pairs = F.zip_with(
            F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value"))
        )
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(state: Column, pair: Column) -> Column:
            begin = state["at"] + pair["gap"]
            end = begin + F.length(pair["value"])
            hit = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
            return F.struct(end.alias("at"), F.array_append(state["out"], hit).alias("out"))

        return F.aggregate(pairs, start, step, lambda state: state["out"])

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def spans(text: Column, pattern: str) -> Column:
    """Non-overlapping matches as (start, end, value), 0-based code points, end exclusive.

    One search marks every match; the marked text is cut at the marks. A text that holds a mark itself is
    searched twice instead.
    """

    def located(parts: Column) -> Column:
        # A part after the first is a match, the closing mark and the gap behind it.
        found = F.transform(
            F.slice(parts, F.lit(2), F.size(parts)),
            lambda p: F.struct(F.substring_index(p, _CLOSE, 1).alias("value"), (F.length(p) - 1).alias("step")),
        )
        start = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(state: Column, part: Column) -> Column:
            begin = state["at"]
            hit = F.struct(begin.alias("start"), (begin + F.length(part["value"])).alias("end"), part["value"].alias("value"))
            return F.struct((begin + part["step"]).alias("at"), F.array_append(state["out"], hit).alias("out"))

        return F.when(F.size(parts) > 1, F.aggregate(found, start, step, lambda state: state["out"]))

    marked = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN, -1)
    held = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE))
    return F.coalesce(F.when(held, _split_spans(text, pattern)).otherwise(bound(marked, located)), F.array().cast(SPAN))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])
