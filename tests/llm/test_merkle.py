"""The manifest against a plain tree built in lists."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from parchment.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    if value is None:
        return "-"
    return f"{len(str(value).encode())}:{value}"


def brute(rows):
    """Levels as lists; the proof of a leaf by walking them."""

    def leaf(r, text):
        return h(*[field(x) for x in (r[0], r[3], r[2], r[4], text)])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            now = out[-1]
            out.append([h(*now[k : k + 3]) for k in range(0, len(now), 3)])
        return out

    def path(tree, k):
        for level in tree[:-1]:
            run = k // 3 * 3
            yield level[run:k], level[k + 1 : run + 3]
            k //= 3

    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = levels([leaf(r, r[1]) for r in by_source[s]])
    upper = levels([trees[s][-1][0] for s in names])
    root = upper[-1][0] if names else None
    out = []
    for place, s in enumerate(names):
        for k, r in enumerate(by_source[s]):
            steps = [*path(trees[s], k), *path(upper, place)]
            text = r[1]
            if text is not None and zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for left, right in steps:
                folded = h(*left, folded, *right)
            siblings = h(*[d for left, right in steps for d in [*left, *right]])
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], root, siblings, folded, folded == root))
    return sorted(out, key=repr)


def rows_of(n, seed=3):
    rng = random.Random(seed)
    out = [(i * 7 % 1009, rng.choice(["a\nb", "plain", None, "", "ä\n\n", "x" * 50]), rng.choice(["en", None]), "hot", 3) for i in range(n)]
    out += [(i, f"t{i}\n", "de", f"s{i % 5}", None) for i in range(40)]
    out += [(5, "one", "en", "lone", 3), (None, "n\n", None, None, None), (None, None, None, None, None), (8, "", "", "", 0)]
    return [*out, out[0], out[0], (2, "other", "en", "hot", 1)]


@pytest.mark.parametrize("n, height", [(300, 2), (81, 4), (82, 4), (1, 1)])
def test_same_as_plain_trees(spark, n, height):
    rows = rows_of(n)
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("tree", F.lit("x")).withColumn("pos", F.lit(1))
    got = merkle.manifest(docs, height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert dict(got.dtypes)["doc_id"] == "bigint"


def test_one_row_and_no_row(spark):
    row = [(4, "a", "en", "s", 1)]
    assert [tuple(r) for r in merkle.manifest(spark.createDataFrame(row, SCHEMA)).collect()] == brute(row)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_queue_holds_an_open_path_only():
    """Messages wait for the labels of one path: at most two for each level."""
    n, most = 3**6, 0
    push = merkle.heappush

    def counted(queue, x):
        nonlocal most
        push(queue, x)
        most = max(most, len(queue))

    merkle.heappush = counted
    try:
        digest, _ = merkle.sweep_up([(k, h(str(k))) for k in range(n)], n, 6)
    finally:
        merkle.heappush = push
    assert most <= 3 * 6 and len(digest) == 64
