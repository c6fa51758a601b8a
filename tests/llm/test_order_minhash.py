"""Order MinHash against plain loops over the k-mers of a text."""

import random
import re
from hashlib import sha256

from pyspark.sql import functions as F

from parchment.llm import order_minhash as O

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hashed(spark, rows):
    """xxhash64 of rows of columns, as Spark computes it."""
    width = len(rows[0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *[f"c{k}" for k in range(width)]])
    out = df.select("i", F.xxhash64(*[f"c{k}" for k in range(width)]).alias("h")).collect()
    return [r.h for r in sorted(out, key=lambda r: r.i)]


def brute(spark, text):
    """Select under every hash function, order by place, hash the pairs."""
    pieces = re.findall(r"\S{1,16}", text)
    shingles = [tuple((pieces[i : i + 5] + [None] * 5)[:5]) for i in range(max(len(pieces) - 4, 1))]
    schema = "i int, a string, b string, c string, d string, e string"
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(shingles)], schema)
    h = [r[1] for r in sorted(df.select("i", F.xxhash64("a", "b", "c", "d", "e").alias("h")).collect())]
    seen, numbers = {}, []
    for x in h:
        numbers.append(seen.get(x, 0))
        seen[x] = numbers[-1] + 1
    items = spark.createDataFrame(list(enumerate(zip(h, numbers))), "i int, s struct<h:long,n:int>")
    ids = [r[1] >> 24 for r in sorted(items.select("i", F.xxhash64("s.h", "s.n")).collect())]
    under = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x long")
    least = []
    columns = under.select("i", *[F.xxhash64("x", F.lit(m)).alias(f"m{m}") for m in range(64)]).collect()
    for m in range(64):
        least.append(min((r[f"m{m}"] >> 24, r.i) for r in columns))
    pairs = []
    for m in range(64):
        a, b = least[m], least[(m + 1) % 64]
        a, b = (a, b) if a[1] <= b[1] else (b, a)
        pairs.append((a[0], b[0]))
    return "".join(f"{x & 0xFFFF:04x}" for x in hashed(spark, pairs))


TEXTS = [
    "the quick brown fox jumps over the lazy dog and the quick brown fox jumps over the lazy cat",
    "one two", "", " \n ", "x " * 40, "a b c d e " * 12 + "f g h i j k l", "ä" * 50 + " ö ü",
]


def test_signatures_select_number_and_order(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r.i: r.fingerprint for r in O.signatures(df, ["i"]).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == brute(spark, text), text


def expected(rows):
    """(doc_id, n_chars, edited digest) with ids in a ring, one text per id."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)
    return docs.withColumn("k", F.lit("x")).withColumn("salt", F.lit(1))


def test_edited_texts_and_likeness(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i * 5_000_011 - 9, " ".join(rng.choices(words, k=rng.choice([0, 1, 7, 60, 400])))) for i in range(60)]
    rows += [(2**62, None), (-(2**63), "ä ö ü ß 語 end"), (None, "text of no id " * 9), (7, "same text " * 30), (8, "same text " * 30), (9, "same text " * 30)]
    rows += [(11, "é" * 100_001 + " tail")]
    got = O.fingerprints(table(spark, rows)).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=repr) == expected(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[7].fingerprint == by_id[8].fingerprint == by_id[9].fingerprint
    assert by_id[9].near_next == by_id[8].near_next == 1.0 and by_id[9].near_edited == 1.0
    long = [r for r in got if r.n_chars > 1000]
    assert len(long) > 5
    for r in long:
        if r.doc_id not in (11,):
            assert 0.0 < r.near_edited < 0.5 and r.near_next < 0.1
    assert all(len(r.fingerprint) == 256 and 0 <= r.near_edited <= 1 for r in got)


def test_order_tells(spark):
    """The same k-mers in another order: a plain MinHash would see no difference."""
    rng = random.Random(6)
    passages = [" ".join(f"p{i}w{j}" for j in range(40)) for i in range(30)]
    moved = passages[:]
    rng.shuffle(moved)
    df = spark.createDataFrame([(0, " ".join(passages)), (1, " ".join(moved)), (2, " ".join(passages[:-3]))], "i int, text string")
    f = {r.i: r.fingerprint for r in O.signatures(df, ["i"]).collect()}
    both = spark.createDataFrame([(f[0], f[1], f[2])], "a string, b string, c string")
    near, cut = both.select(O.likeness(F.col("a"), F.col("b")), O.likeness(F.col("a"), F.col("c"))).first()
    assert near < 0.75 and cut > near


def test_repeated_ids_rows_and_small_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here"), (2, "zz yy xx ww vv uu")]
    got = O.fingerprints(table(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 1, 2]
    assert sorted((r.n_chars) for r in got) == [11, 11, 16, 17]
    lone = O.fingerprints(table(spark, [(3, "abcdef")])).first()
    assert lone.edited_sha256 == sha256(b"abcabc").hexdigest() and lone.near_next == 1.0
    only_null = O.fingerprints(table(spark, [(None, "ab")])).first()
    assert only_null.doc_id is None and only_null.edited_sha256 == sha256(b"aa").hexdigest()
    assert O.fingerprints(table(spark, rows).limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = O.fingerprints(table(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
