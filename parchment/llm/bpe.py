"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 32 bytes cuts every text into chunks, so texts that share a passage
share chunks whatever stands before it. Documents are dealt out by the least digest among their chunks: those with
common content meet in one task, and a task encodes each distinct chunk once. The rebalancing
exchange splits a digest with too many rows by size.

Chunks joined in this way may differ from the encoding of the whole text around a join. The join is repaired: the text
from a split point before it to one after it is encoded anew and takes the place of what both chunks
have there. A split point stands between a character that isn't white space and a blank or line end. No
pre-token of the byte-level pattern contains both, so a text's encoding is that of the parts on either side,
and the new ids agree exactly with those of both chunks from there on. Where none is near, the window doubles, up
to the whole text.

Encoding itself is done by a merge engine fed with the vocabulary of the tokenizer file.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST, MEAN_BITS = 128, 8192, 9
CACHE_IDS = 8_000_000  # ids of chunks that a task keeps: 16 MB
BLOCK_BYTES, BLOCK_ROWS = 1_000_000, 500
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
# The split pattern of byte-level BPE.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = re.compile(rb"(?:[\x21-\x7e]|[\xc2-\xf4][\x80-\xbf]{1,3})(?=[ \n])")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable bytes for themselves, the others
    for the next letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        vocab = model["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or merged != sorted(merged):
            raise ValueError("only plain byte-level BPE, with ids in the order of merges, is read")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("added tokens that take in their surroundings are not read")
        letters = _byte_letters()
        self.special = {a["content"].encode(): a["id"] for a in added}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if i not in self.special.values()}
        self.pieces = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for t, i in [*ranks.items(), *self.special.items()]:
            self.pieces[i] = t
        self.sizes = np.array([len(t) for t in self.pieces], np.int64)
        self._engine = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        longest = sorted(self.special, key=len, reverse=True)
        self._cut = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if longest else None
        self.chunks: dict[bytes, np.ndarray] = {}
        self.held = 0

    def parts(self, text: bytes) -> list[bytes]:
        """The text between added tokens, and these themselves at odd places."""
        return self._cut.split(text) if self._cut else [text]

    def plain(self, text: bytes) -> np.ndarray:
        return np.array(self._engine.encode_ordinary(text.decode()), np.uint16 if len(self.pieces) <= 1 << 16 else np.uint32)

    def whole(self, text: bytes) -> np.ndarray:
        """Ids of a text encoded in one go."""
        got = [self.plain(p) if k % 2 == 0 else np.array([self.special[p]], np.uint16) for k, p in enumerate(self.parts(text))]
        return np.concatenate(got).astype(np.uint32)

    def chunk(self, text: bytes) -> np.ndarray:
        ids = self.chunks.get(text)
        if ids is None:
            if self.held > CACHE_IDS:
                # The older half goes; what is shared comes back at its next use.
                for old in list(self.chunks)[: len(self.chunks) // 2]:
                    self.held -= len(self.chunks.pop(old)) + 64
            ids = self.chunks[text] = self.plain(text)
            self.held += len(ids) + 64
        return ids

    def joined(self, text: bytes, cuts: list[int]) -> np.ndarray:
        """Ids of a text without added tokens from its chunks, every join repaired."""
        edges = [0, *cuts, len(text)]
        ids = np.concatenate([self.chunk(text[a:b]) for a, b in zip(edges, edges[1:])])
        if not cuts:
            return ids
        ends = np.cumsum(self.sizes[ids])
        spans: list[list[int]] = []
        for cut in cuts:
            if spans and cut < spans[-1][1]:
                continue  # the window of the last join covers this one too
            lo, hi = _split_before(text, cut), _split_behind(text, cut)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            elif lo < hi:
                spans.append([lo, hi])
        out, at = [], 0
        for lo, hi in spans:
            while True:
                left, right = (int(np.searchsorted(ends, p)) + 1 if p else 0 for p in (lo, hi))
                if (not lo or ends[left - 1] == lo) and ends[right - 1] == hi:
                    break
                lo, hi = _split_before(text, lo - 1), _split_behind(text, hi + 1)  # no agreement yet
            out += [ids[at:left], self.plain(text[lo:hi])]
            at = right
        return np.concatenate([*out, ids[at:]])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text."""
        parts = [self.parts(t) for t in texts]
        flat = [p for own in parts for p in own[::2]]
        cuts = iter(cut_points(flat))
        out = []
        for own in parts:
            got = [self.joined(p, next(cuts)) if k % 2 == 0 else np.array([self.special[p]], np.uint16) for k, p in enumerate(own)]
            out.append(np.concatenate(got).astype(np.uint32))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> BytePairs:
    return BytePairs(path)


def _is_split(text: bytes, p: int) -> bool:
    """Whether p stands between a character that isn't white space and a blank or line end."""
    q = p - 1
    while q > 0 and text[q] & 0xC0 == 0x80:
        q -= 1
    return text[p] in b" \n" and text[q] > 0x20 and not text[q:p].decode().isspace()


def _split_before(text: bytes, p: int) -> int:
    """The last split point up to ``p``, or the start."""
    reach = 32
    while True:
        lo = max(0, p - reach)
        for q in range(min(p, len(text) - 1), lo, -1):
            if text[q] in b" \n" and _is_split(text, q):
                return q
        if lo == 0:
            return 0
        p, reach = lo, reach * 2


def _split_behind(text: bytes, p: int) -> int:
    """The first split point from ``p`` on, or the end."""
    for q in range(max(p, 1), len(text)):
        if text[q] in b" \n" and _is_split(text, q):
            return q
    return len(text)


def cut_points(texts: list[bytes]) -> list[list[int]]:
    """Chunk borders of each text, at character borders. They depend on the bytes near them and the
    distance from the last border, on nothing else."""
    code = np.frombuffer(b"".join(texts), np.uint8)
    roll = _GEAR[code]
    for s in (1, 2, 4, 8, 16):
        more = roll[:-s] << np.uint32(s)
        roll[s:] = roll[s:] + more
    found = np.flatnonzero(roll >> np.uint32(32 - MEAN_BITS) == 0) + 1
    inner = (code & 0xC0) == 0x80
    out, start = [], 0
    for text in texts:
        stop = start + len(text)
        if len(text) <= LEAST:
            out.append([])
            start = stop
            continue
        near = found[np.searchsorted(found, start) : np.searchsorted(found, stop)].tolist()
        own, at = [], start
        while stop - at > LEAST:
            k = bisect_left(near, at + LEAST)
            nxt = min(near[k] if k < len(near) else stop, at + MOST)
            while nxt < stop and inner[nxt]:
                nxt += 1
            if nxt >= stop:
                break
            own.append(nxt - start)
            at = nxt
        out.append(own)
        start = stop
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with a bounded number of rows and bytes, and their last column."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            n = max(1, min(BLOCK_ROWS, int(np.searchsorted(np.cumsum(size[at : at + BLOCK_ROWS]), BLOCK_BYTES))))
            part = batch.slice(at, n)
            yield part, [t or b"" for t in part.column(part.num_columns - 1).to_pylist()]
            at += n


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the least chunk digest of each text."""
    for part, texts in _blocks(batches):
        least = []
        for text, cuts in zip(texts, cut_points(texts)):
            edges = [0, *cuts, len(text)]
            least.append(min(xxhash.xxh64_intdigest(text[a:b]) for a, b in zip(edges, edges[1:])) >> 1)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(least, pa.int64()), part.column(1)], ["doc_id", "sketch", "text"])


def _round_trip(path: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        t.chunks, t.held = {}, 0
        for part, texts in _blocks(batches):
            ids = t.encode(texts)
            cols = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
            if with_text:
                cols.append(pa.array([t.decode(x).decode("utf-8", "replace") for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"][: len(cols)])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for part, ids in _blocks(batches):
            texts = [t.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _gathered(docs: DataFrame) -> DataFrame:
    """doc_id and text as bytes; documents with common chunks share a partition."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_sketch, "doc_id long, sketch long, text binary").hint("rebalance", "sketch").select("doc_id", "text")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row of ``docs``
    (doc_id, text), as the tokenizers library encodes the whole text with the file at ``path`` and
    without adding special tokens; their strings in a text count as these tokens.

    A null or empty text has no ids. Rows keep no order; repeated rows each get a row; other columns
    are not read; an empty table gives an empty result. ``path`` must exist on every executor.
    """
    return _gathered(docs).mapInArrow(_round_trip(path or default_path(), False), "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text for rows of doc_id and ids; null ids give an empty text, bytes that are no UTF-8
    the replacement character."""
    return tokens.select("doc_id", "ids").mapInArrow(_decode(path or default_path()), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``encode`` with the column ``decoded`` beside it, in one pass."""
    return _gathered(docs).mapInArrow(_round_trip(path or default_path(), True), "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``round_trip``."""
    return round_trip(docs, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
