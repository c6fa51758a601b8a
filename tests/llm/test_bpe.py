"""Chunked BPE against the tokenizers library on whole texts."""

import hashlib
import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parchment.llm import bpe


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(bpe.default_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def texts():
    rng = random.Random(2)
    bits = ["the", " of", "  ", "\n", "\n\n ", "\t", "’s", "'s", "'ll", "naïve", "straße", "日本語", " ", "　", " ", "🙂", "🙂‍↔️", "12", "3.14", "!!", "—", "<|endoftext|>", "<|endof", "a" * 40, "\x85", "\x1c", "é", "é", "привет", "x_y"]
    out = ["", " ", "<|endoftext|>", "<|endoftext|><|endoftext|> a", "a" * 30_000, " " * 5_000 + "x", "\n" * 3_000, "🙂" * 4_000, "日本語" * 3_000, "ab " * 4_000]
    shared = "".join(rng.choice(bits) for _ in range(900))
    for _ in range(30):
        own = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.choice([3, 50, 600])))
        out += [own, own + shared, shared + own, own[:40] + shared + own]
    return out


def test_chunks_give_the_ids_of_the_whole_text(whole):
    t = bpe.BytePairs(bpe.default_path())
    cases = texts()
    raw = [c.encode() for c in cases]
    assert sum(map(len, bpe.cut_points(raw))) > 300
    for case, ids in zip(cases, t.encode(raw)):
        assert ids.tolist() == whole(case)
        assert t.decode(ids).decode() == case


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), st.lists(st.integers(0, 200), max_size=4))
def test_any_cut_is_repaired(text, cuts):
    t = bpe.tokenizer(bpe.default_path())
    raw = text.encode()
    cuts = sorted({c for c in cuts if 0 < c < len(raw) and raw[c] & 0xC0 != 0x80})
    assert t.joined(raw, cuts).tolist() == t.plain(raw).tolist()


def test_every_character_is_split_as_the_library_does(whole):
    t = bpe.tokenizer(bpe.default_path())
    letters = [chr(c) for c in range(1, sys.maxunicode + 1, 1) if not 0xD800 <= c < 0xE000 and c < 0x3400 or c % 97 == 0 and not 0xD800 <= c < 0xE000]
    odd = []
    for at in range(0, len(letters), 50):
        part = "".join(f"a{c} {c}{c}1" for c in letters[at : at + 50])
        if t.whole(part.encode()).tolist() != whole(part):
            odd += [c for c in letters[at : at + 50] if t.whole(f"a{c} {c}{c}1".encode()).tolist() != whole(f"a{c} {c}{c}1")]
    assert odd == []


def test_chunks_follow_content():
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefgh ") for _ in range(20_000)).encode()
    a, b = bpe.cut_points([body, b"something else in front " * 9 + body])
    shift = len(b"something else in front " * 9)
    assert len(a) > 10 and len(set(a) & {c - shift for c in b}) > 0.8 * len(a)


def test_shared_chunks_are_encoded_once():
    t = bpe.BytePairs(bpe.default_path())
    calls = []
    t.plain = lambda text, f=t.plain: calls.append(text) or f(text)
    t.encode([x.encode() for x in texts()[-1:]] * 5)
    chunks = [c for c in calls if c in t.chunks]
    assert len(chunks) > 5 and len(chunks) == len(set(chunks))


def test_a_full_cache_changes_nothing(whole, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_IDS", 500)
    t = bpe.BytePairs(bpe.default_path())
    cases = texts()[-12:] * 2
    assert [x.tolist() for x in t.encode([c.encode() for c in cases])] == [whole(c) for c in cases]


def test_operator_on_a_table(spark, whole):
    cases = [(k, c) for k, c in enumerate(texts())] + [(900, None), (None, "no id"), (901, "twice"), (901, "twice")]
    docs = spark.createDataFrame(cases, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("sketch", F.lit(1))
    rows = bpe.digests(docs.repartition(3)).collect()
    want = []
    for i, c in cases:
        ids = whole(c or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((c or "").encode()).hexdigest()))
    assert sorted([tuple(r) for r in rows], key=repr) == sorted(want, key=repr)
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=repr) == sorted([(i, c or "") for i, c in cases], key=repr)
    assert bpe.digests(docs.limit(0)).collect() == []
