"""Token counts of sections by offset mapping.

A text is encoded once as a whole; the character span of every token is joined with the spans of
the sections, and each token is allocated by one rule:

* ``start``: to the section that holds its first character;
* ``majority``: to the section that holds most of its characters, the earlier one on a tie;
* ``split``: to every section it touches, in proportion to the characters it has there.

Sections that overlap each get their tokens, except under ``majority``. What no section gets is
reported under the section null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.bpe import BytePairs, _blocks, default_path, tokenizer

RULES = ("start", "majority", "split")
_OUT = "doc_id long, section string, start long, end long, n_tokens double, doc_tokens long"


def token_spans(t: BytePairs, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one behind its last; a token that holds part of a
    character's bytes has that character in its span."""
    stop = np.cumsum(t.sizes[t.whole(text)])
    heads = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    first = np.r_[0, stop[:-1]]
    return heads[first] - 1 if len(first) and len(heads) else first[:0], heads[stop - 1] if len(heads) else stop[:0]


def allocate(first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, float]:
    """Tokens of each section, and those of none, for token spans in order of the text."""
    lo, hi = np.searchsorted(last, start, side="right"), np.searchsorted(first, end, side="left")
    n = np.maximum(hi - lo, 0) * (end > start)
    section = np.repeat(np.arange(len(start)), n)
    token = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    if rule == "start":
        ok = (first[token] >= start[section]) & (first[token] < end[section])
        section, token, share = section[ok], token[ok], np.ones(ok.sum())
    else:
        share = np.minimum(last[token], end[section]) - np.maximum(first[token], start[section])
        if rule == "majority":
            order = np.lexsort((section, start[section], -share, token))
            best = order[np.r_[True, token[order][1:] != token[order][:-1]]] if len(order) else order
            section, token, share = section[best], token[best], np.ones(len(best))
        else:
            share = share / (last - first)[token]
    counts = np.bincount(section, share, minlength=len(start))
    covered = np.bincount(token, share, minlength=len(first)).clip(0, 1)
    return counts, float(len(first) - covered.sum())


def pieces(text: str, separator: str) -> list[tuple[str, int, int]]:
    """Sections between separators, numbered from 0; a separator belongs to the section it ends."""
    out, at = [], 0
    for k, piece in enumerate(text.split(separator)):
        end = min(at + len(piece) + len(separator), len(text))
        if end > at:
            out.append((str(k), at, end))
        at = end
    return out


def _attribute(path: str, rule: str, separator: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for part, texts in _blocks(batches):
            rows: list[tuple] = []
            given = part.column(1).to_pylist()
            for doc_id, own, text in zip(part.column(0).to_pylist(), given, texts):
                if separator is not None:
                    own = pieces(text.decode(), separator)
                else:
                    own = [(s["name"], s["start"], s["end"]) for s in own or [] if s and s["start"] is not None and s["end"] is not None]
                first, last = token_spans(t, text)
                start, end = (np.array([s[k] for s in own], np.int64) for k in (1, 2))
                counts, rest = allocate(first, last, start, end, rule)
                rows += [(doc_id, *s, float(c), len(first)) for s, c in zip(own, counts)]
                if rest > 1e-9 or not own:
                    rows.append((doc_id, None, None, None, round(rest, 9), len(first)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                ["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"],
            )

    return run


def section_counts(docs: DataFrame, rule: str = "majority", separator: str | None = "\n", path: str | None = None) -> DataFrame:
    """One row per section of every row of ``docs`` (doc_id, text), and one with a null section for
    tokens outside all sections or texts without sections.

    Columns: doc_id, section, start, end (characters), n_tokens, doc_tokens. Sections are the pieces
    between ``separator``s; with None they come from the column ``sections``, an array of (name, start,
    end), of which entries without start or end are passed over. A null or empty text has one row with a
    null section and no tokens. Repeated rows are counted each; other columns are not read; an empty
    table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    sections = F.lit(None).cast("array<struct<name:string,start:bigint,end:bigint>>") if separator is not None else F.col("sections")
    rows = docs.select("doc_id", sections.alias("sections"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_attribute(path or default_path(), rule, separator), _OUT)


def field_counts(rows: DataFrame, doc_id: str, fields: list[str], joiner: str = "\n", rule: str = "majority", path: str | None = None) -> DataFrame:
    """``section_counts`` of several columns encoded as one text, joined by ``joiner``; a null field is
    empty, and joiners belong to no field."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    at, spans = F.lit(0).cast("bigint"), []
    for name, v in zip(fields, values):
        end = at + F.char_length(v)
        spans.append(F.struct(F.lit(name).alias("name"), at.alias("start"), end.alias("end")))
        at = end + len(joiner)
    docs = rows.select(F.col(doc_id).alias("doc_id"), F.concat_ws(joiner, *values).alias("text"), F.array(*spans).alias("sections"))
    return section_counts(docs, rule, None, path)
