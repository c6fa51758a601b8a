"""Surrogates: detection, format, distinctness and coreference."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parchment.llm import surrogates as S

KEY = b"test key"


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to Anna.Lee+x@mail.example.co.uk.", [("email", "Anna.Lee+x@mail.example.co.uk")]),
        ("call +1 (017) 555-7713 or 555-7713, 01 23 45 67 89.", [("phone", "+1 (017) 555-7713"), ("phone", "555-7713"), ("phone", "01 23 45 67 89")]),
        ("from 97.51.17.173. v1.2.3 300.1.1.1", [("ip", "97.51.17.173")]),
        ("7536784127813050 4845168114407329 4111-1111-1111-1111", [("card", "7536784127813050"), ("card", "4845168114407329"), ("card", "4111-1111-1111-1111")]),
        ("DE89 3704 0044 0532 0130 00, not DE00 3704", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("123-45-6789; 2020-12-01; 1200-1300; 12345678", [("ssn", "123-45-6789")]),
        ("04dbebab91ab85687d33eeaaf9ac699e1188f962 sk-abcdEFGH12345678", [("key", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), ("key", "sk-abcdEFGH12345678")]),
        ("Mr. Blake met Mary Jones and Мария Иванова.", [("name", "Mr. Blake"), ("name", "Mary Jones"), ("name", "Мария Иванова")]),
        ("nothing here, 42 and 3.14 by mary", []),
    ],
)
def test_detection(text, want):
    assert [(k, text[a:b]) for a, b, k in S.detect(text)] == want


def shape(text):
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", text))


@pytest.mark.parametrize(
    "text", ["+1 (017) 555-7713", "4111-1111-1111-1111", "DE89 3704 0044 0532 0130 00", "AB12cd.x@Mail.example.COM", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "97.51.17.173", "123-45-6789"]
)
def test_format_is_kept(text):
    new, n = S.replace_entities(text, KEY, {})
    assert n == 1 and new != text
    assert shape(new) == shape(text)
    assert [k for *_, k in S.detect(new)] == [k for *_, k in S.detect(text)]
    if "4111" in text:
        assert S._luhn(re.sub(r"\D", "", new))


def test_names_keep_gender_script_and_case():
    new, _ = S.replace_entities("Mary Jones, MR. JONES? Mr. Jones; Мария Иванова, господин Иванов", KEY, {})
    m = re.fullmatch(r"(\w+) (\w+), MR\. JONES\? Mr\. (\w+); (\w+) (\w+), господин (\w+)", new)
    assert m and m[1] in S.FIRST[("latin", "f")] and m[2] == m[3] and m[2] in S.LAST["latin"]
    assert m[4] in S.FIRST[("cyrillic", "f")] and m[5] == m[6] + "а"


def test_later_bare_surnames_and_names_of_all_scripts():
    text = "Anna Orlov met. Later Orlov left, ORLOV or Orlovsky. Mr Šimon Novák, Mr Łukasz; Ольга Морозова, Морозов. Mr Παπαδάκης: Παπαδάκης"
    found = [(k, text[a:b]) for a, b, k in S.detect(text)]
    assert ("surname", "Orlov") in found and ("name", "Mr Šimon Novák") in found and ("name", "Mr Łukasz") in found
    assert ("surname", "Морозов") in found and ("surname", "Παπαδάκης") in found
    new, _ = S.replace_entities(text, KEY, {})
    assert not any(w in new for w in ("Orlov ", "Novák", "Łukasz", "Мороз", "Παπαδ"))
    last = re.match(r"\w+ ([\w-]+) met\. Later ([\w-]+) left", new)
    assert last[1] == last[2] and "Orlovsky" in new
    greek = re.search(r"Mr (\w+): (\w+)$", new)
    assert greek[1] == greek[2] and all("Ͱ" <= c <= "Ͽ" for c in greek[1])


def test_every_script_stays_its_own():
    new, n = S.replace_entities("αβγ.δε@example.gr und ٠١٧-٥٥٥-٧٧١٣", KEY, {})
    assert n == 2 and re.match(r"[α-ωά-ώς]{3}\.[α-ωά-ώς]{2}@[a-z]{7}\.gr und [٠-٩]{3}-[٠-٩]{3}-[٠-٩]{4}$", new)


def test_ranges_are_no_phones():
    assert S.detect("100-2000 items, 050-1234") == [] and len(S.detect("555-7713")) == 1


def test_assignment_against_a_plain_walk(spark):
    """Distinct units in the order of their hash, attempt after attempt, in dictionaries."""
    entities = [("last latin", f"name{k}") for k in range(60)] + [("first f latin", f"given{k}") for k in range(40)] + [("ssn", f"{k:09d}") for k in range(50)]
    df = spark.createDataFrame(entities, "kind string, canon string")
    order = {(r.kind, r.canon): r.h for r in df.select("kind", "canon", F.xxhash64("canon").alias("h")).collect()}
    taken, out, pending, attempt = {(k, c) for k, c in entities}, {}, list(entities), 0
    while pending:
        rest = []
        for unit in sorted(pending, key=lambda u: (order[u], u[1])):
            sub = (unit[0], S.surrogate(KEY, *unit, attempt))
            if sub in taken:
                rest.append(unit)
            else:
                taken.add(sub)
                out[unit] = (attempt, sub[1])
        pending, attempt = rest, attempt + 1
    got = {(r.kind, r.canon): (r.attempt, r["sub"]) for r in S.assign(df, KEY).collect()}
    assert got == out and max(a for a, _ in out.values()) > 1


def corpus():
    rng = random.Random(6)
    phones = [f"{rng.randint(200, 999)}-{rng.randint(1000, 9999)}" for _ in range(150)]
    mails = [f"user.{k}@m{k % 7}.example.com" for k in range(60)]
    names = [f"{rng.choice(['Mary', 'John', 'Paul', 'Linda'])} Q{chr(97 + k % 26)}{chr(97 + k // 26)}son" for k in range(80)]
    things = phones + mails + names + ["97.51.17.173", "8.8.8.8", "9.9.9.9"]
    docs = [(k, " and ".join(rng.sample(things, 4)) + " end") for k in range(200)]
    return docs + [(500, None), (501, ""), (502, "clean text, 12 words"), (None, things[0]), (503, mails[3].upper()), (3, docs[3][1]), (504, "x " * 50_000 + mails[0])], things


def test_distinctness_and_coreference_over_a_corpus(spark):
    docs, things = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("again", F.lit(1))
    rows = S.pseudonymize(table, KEY).collect()
    assert len(rows) == len(docs)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[500].text is None and by_id[501].text == "" and by_id[502].text == docs[202][1] and by_id[502].n_entities == 0
    seen = {}
    for i, text in docs[:200]:
        old = text[: -len(" end")].split(" and ")
        new = by_id[i].text[: -len(" end")].split(" and ")
        assert by_id[i].n_entities == len(old) == len(new)
        for a, b in zip(old, new):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)
    assert not set(seen.values()) & set(things)
    assert by_id[503].text == seen.get("user.3@m3.example.com", by_id[503].text.lower()).upper()
    assert S.pseudonymize(table.limit(0), KEY).collect() == []


def test_colliding_units_try_again(spark):
    # Ten one-digit octets at most: many units share a first surrogate.
    ips = [("ip", f"{a}.{b}.1.1") for a in range(1, 10) for b in range(1, 10)] + [("last latin", f"n{k}") for k in range(40)]
    got = S.assign(spark.createDataFrame(ips, "kind string, canon string"), KEY).collect()
    assert sorted((r.kind, r.canon) for r in got) == sorted(ips)
    assert len({(r.kind, r.sub) for r in got}) == len(ips)
    assert not {(r.kind, r.sub) for r in got} & set(ips)
    assert any(r.attempt for r in got) and all(r.sub == S.surrogate(KEY, r.kind, r.canon, r.attempt) for r in got)
