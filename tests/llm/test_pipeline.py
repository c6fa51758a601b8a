"""The pipeline against brute force, and each stage's columns."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from parchment.llm import bpe, langid
from tests.llm.test_decontam import brute, words
from tests.llm.test_dedup import AZ, SCHEMA, brute_components, fingerprint
from tests.llm.test_langid import SYLLABLES, speak


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []
    for k in range(120):
        lang = rng.choice(list(SYLLABLES))
        rows.append((k, speak(rng, lang, rng.choice([5, 60, 300])), lang, f"s{k % 3}", 1))
    items = [(k, speak(rng, "bb", 25)) for k in range(4)]
    for k in range(0, 40, 4):  # copies, near copies, leaks
        _, text, lang, source, n = rows[k]
        rows.append((200 + k, text.upper() if lang == "aa" else text, lang, source, n))
        long = (text + " ") * (1 + 400 // len(text.split()))
        rows.append((300 + k, long, lang, source, n))
        rows.append((400 + k, long + "one", lang, source, n))
        rows.append((500 + k, f"{text} {items[k % 4][1]}", lang, source, n))
    rows += [(900, None, "aa", None, None), (901, "123", None, "s", 3), (902, "", "bb", "s", 0), (5, *rows[5][1:]), (None, speak(rng, "cc", 50), "cc", "s", 2)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def expected(spark, folder, rows, items):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = {(r.doc_id, r.rejected) for r in langid.identify(docs).collect()}
    left = [(i, t) for i, t, *_ in rows if (i, False) in gone]
    winner = {}
    for i, t in left:
        key = (t or "").translate(AZ)
        winner[key] = max(winner.get(key, (-1, "")), (i if i is not None else -1, t or ""))
    left = [(i if i >= 0 else None, t) for i, t in winner.values()]
    codes = [fingerprint(t) for _, t in left]
    left = [p for p, c in zip(left, brute_components(left, codes)) if p[0] == c]
    bad = {r[0] for r in brute(left, items) if r[5]}
    library = Tokenizer.from_file(bpe.default_path())
    out = []
    for i, t in left:
        if i not in bad:
            ids = library.encode(t, add_special_tokens=False).ids
            out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_run_matches_brute_force(spark, tables):
    folder, rows, items = tables
    got = sorted([tuple(r) for r in corpus_pipeline.run(spark, folder).collect()], key=repr)
    assert got == expected(spark, folder, rows, items)
    assert 60 < len(got) < len(rows) - 40
    assert not {900, 901, 902} & {r[0] for r in got}


def test_stages_keep_the_columns_of_documents(spark, tables, tmp_path):
    folder, rows, items = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "bpe":
            assert docs.count() == before
        else:
            assert docs.columns == columns and docs.count() < before
        before = docs.count()
    assert words("a, b") == ["a", "b"]


def test_an_empty_corpus(spark, tables, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{tables[0]}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
