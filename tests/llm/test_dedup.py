"""Exact and near-duplicate operators against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parchment.llm import exact_dedup, simhash
from parchment.llm.gray_index import GrayIndex, gray_rank

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], SCHEMA)


CASES = [
    (1, "Same TEXT"), (5, "same text"), (3, "SAME text"), (9, "ÄB"), (8, "äb"), (7, "Äb"), (2, None), (4, ""), (6, " "),
    (None, "same text"), (None, "alone"), (11, "alone two"), (11, "alone two"), (12, "x" * 300_000), (13, "X" * 300_000),
]


def brute_exact(pairs):
    norm = [(i, (t or "").translate(AZ)) for i, t in pairs]
    out = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        known = [j for j in ids if j is not None]
        out.append((i, max(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups(spark):
    rows = exact_dedup.groups(docs_of(spark, CASES)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows], key=repr) == brute_exact(CASES)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({r.text_sha256 for r in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_texts_that_share_a_digest_stay_apart(spark):
    rows = exact_dedup.groups(docs_of(spark, CASES), digest=lambda text: F.lit("same")).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows], key=repr) == brute_exact(CASES)


def test_a_third_of_all_rows_one_text_without_ids(spark):
    """The copies are counted where they are read: no window sees more of them than there are tasks."""
    hot = spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("Hot text").alias("text"))
    rest = spark.range(6_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") / 2).cast("int")).alias("text"))
    docs = hot.unionByName(rest).repartition(6)
    counts = {(r.kept, r.group_size): r["count"] for r in exact_dedup.groups(docs).groupBy("kept", "group_size").count().collect()}
    assert counts == {(True, 3000): 1, (False, 3000): 2999, (True, 2): 3000, (False, 2): 3000}
    assert exact_dedup.deduplicate(docs).count() == 3001


def test_exact_filter_keeps_columns_and_a_clashing_name(spark):
    docs = docs_of(spark, CASES).withColumn("keep_id", F.lit(1)).withColumn("_key_text", F.lit("z")).withColumn("salt", F.lit("s"))
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = [(r.text or "").translate(AZ) for r in rows]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(AZ) for _, t in CASES})
    assert {r.doc_id for r in rows} == {5, 9, 8, 4, 6, None, 11, 13}


def test_exact_empty_table(spark):
    assert exact_dedup.groups(docs_of(spark, [])).collect() == []
    assert exact_dedup.deduplicate(docs_of(spark, [])).collect() == []


def test_a_text_with_half_of_all_rows(spark):
    pairs = [(k, "hot" if k % 2 else f"t{k}") for k in range(4000)]
    rows = exact_dedup.groups(docs_of(spark, pairs).repartition(16)).where("group_size > 1").collect()
    assert len(rows) == 2000 and {r.keep_id for r in rows} == {3999} and sum(r.kept for r in rows) == 1


def fingerprint(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "").translate(AZ)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, codes, bits=3):
    root = list(range(len(pairs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(pairs)):
        for b in range(a):
            if bin(codes[a] ^ codes[b]).count("1") <= bits:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(pairs))]


def near_pairs(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["É", "straße", "A b"]
    pairs, k = [], 0
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 300, 900]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(words)
            pairs.append((k * 7 % 1009, rng.choice([" ", "\n", "\t "]).join(text)))
            k += 1
    return pairs + [(2000, None), (2001, ""), (2002, "   "), (None, pairs[0][1]), (2003, pairs[5][1].upper()), (2003, pairs[5][1].upper())]


@pytest.mark.parametrize("subtree_rows", [2000, 30, 1])
def test_near_duplicates_match_brute_force(spark, subtree_rows):
    pairs = near_pairs()
    codes = [fingerprint(t) for _, t in pairs]
    want = sorted([(i, f"{c:016x}", r) for (i, _), c, r in zip(pairs, codes, brute_components(pairs, codes))], key=repr)
    rows = simhash.near_duplicates(docs_of(spark, pairs).withColumn("code", F.lit("clash")), subtree_rows=subtree_rows).collect()
    assert sorted([tuple(r) for r in rows], key=repr) == want


def test_one_document_of_each_component_stays(spark):
    pairs = near_pairs(2, 30)
    docs = docs_of(spark, pairs).withColumn("salt", F.lit(1))
    kept = simhash.one_of_each(docs)
    found = simhash.near_duplicates(docs).collect()
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in found})
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_components_with_one_label_each_keep_a_text(spark):
    rng = random.Random(8)
    one, two, three, four, five = (" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(999)) for _ in range(60)) for _ in range(5))
    # Unrelated texts of null ids, one of them twice, one with a near copy that has an id; and a repeated id.
    pairs = [(None, one), (None, two), (None, two), (None, three), (4, three.upper()), (7, four), (7, five), (9, five)]
    kept = simhash.one_of_each(docs_of(spark, pairs)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(None, one), (None, two), (4, three.upper()), (7, four), (7, five)], key=repr)


def test_gray_rank_orders_neighbours():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(gray_rank(codes))].tolist()
    assert all(bin(a ^ b).count("1") == 1 for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("fan", [2, 8])
def test_index_links_like_all_pairs(fan):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    codes = np.unique(np.concatenate([base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (40, 12)).astype(np.uint64)), base[:, None]], axis=1))
    codes = np.unique(np.concatenate([codes, rng.integers(0, 1 << 12, 300).astype(np.uint64)]))
    roots = GrayIndex(codes, np.zeros(len(codes)), fan).link(3, block=500)
    pairs = [(int(c), None) for c in codes]
    want = brute_components(pairs, [int(c) for c in codes])
    assert roots.tolist() == want


def test_most_pairs_fall_above_the_leaves():
    """A sub-tree of the size tasks get, with near copies: what is compared and what is pruned, by level."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 16_000).astype(np.uint64)
    copies = base[:2_000] ^ (np.uint64(1) << rng.integers(0, 64, 2_000).astype(np.uint64))
    codes = np.unique(np.concatenate([base, copies]))
    index, seen = GrayIndex(codes, np.zeros(len(codes))), Counter()
    roots = index.link(3, seen=seen)
    assert len(index.first) >= 7
    # Groups of four whose members were compared one by one stand for sixteen pairs each.
    assert 16 * seen[1] < 0.1 * len(codes) ** 2 / 2
    assert seen[0] < 3 * len(copies)
    by_root = dict(zip(codes.tolist(), roots.tolist()))
    assert all(by_root[a] == by_root[b] for a, b in zip(base[:2_000].tolist(), copies.tolist()))


@pytest.mark.parametrize("n, subtree_rows", [(100, 1000), (5_000, 100), (10**9, 20_000), (10**13, 20_000)])
def test_sub_trees_hold_every_pair(n, subtree_rows):
    orders = simhash._orders(n, 3, subtree_rows)
    rng = random.Random(n)
    for _ in range(300):
        apart = 0
        for b in rng.sample(range(64), 3):
            apart |= 1 << b
        assert any(not apart & m for m in orders)
    assert len(set(m.bit_count() for m in orders)) == 1


def test_bucket_masks_cover_every_pair():
    top = simhash._masks(0, 3)
    assert sum(top) == (1 << 64) - 1
    rng = random.Random(3)
    for _ in range(200):
        apart = 0
        for b in rng.sample(range(64), 3):
            apart |= 1 << b
        first = [m for m in top if not apart & m]
        assert first and all(any(not apart & m2 for m2 in simhash._masks(m, 3)) for m in first)


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 300).selectExpr("id * 37 % 1009 as u", "(id + 1) * 37 % 1009 as v")
    rows = simhash.components(edges).collect()
    assert {r.root for r in rows} == {min(k * 37 % 1009 for k in range(1, 301))} and len(rows) == 299
