"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

A detected entity is made of units: an email of its local part and its domain, a name of first and
last name, any other entity of itself. A unit's surrogate follows from a secret key, the unit and a number of
attempts, so the same unit reads the same in every document (coreference), and mentions keep their
separators and letter case. Across the corpus no two units of a kind may get the same surrogate, and none may
get a text that is a real unit: colliding units try again, in rounds, until none collides. Only the
units that needed a second attempt are sent back to the texts.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.bpe import _blocks
from parchment.llm.common import checkpoint, text_key
from parchment.session import broadcast_if_small

# Names by gender and script, for detection and as surrogates.
FIRST = {
    ("latin", "m"): "James John Robert Michael William David Richard Thomas Paul Mark Peter Hans Karl Pierre Jean Carlos Juan".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Anna Maria Greta Heidi Claire Sophie Carmen Lucia".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей".split(),
    ("cyrillic", "f"): "Мария Анна Ольга Елена Наталья Татьяна Ирина Светлана".split(),
}
LAST = {
    "latin": "Archer Barlow Carver Dalton Ellery Foster Garner Harlow Irving Keller Lambert Mercer Norwood Osborne Prescott Sawyer".split(),
    "cyrillic": "Орлов Лебедев Соколов Морозов Волков Зайцев Павлов Голубев Виноградов Богданов".split(),
}
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"]}
PREFIXES = ("sk-", "sk_", "pk_", "ghp_", "AKIA")
LENGTHEN = 50  # attempts after which a surrogate may be longer than the original

_GENDER = {n: g for (_, g), names in FIRST.items() for n in names}
_CAP = "[" + "".join(chr(c) for c in range(0x3000) if chr(c).isupper()) + r"][\w’'-]*\w"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_NAME = re.compile(
    rf"\b(?:(?P<title>{_TITLE})\.?[ ](?P<a>{_CAP})(?:[ ](?P<b>{_CAP}))?|(?P<first>{'|'.join(_GENDER)})[ ](?P<last>{_CAP}))"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_WITH_DIGITS = [
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ip", re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])")),
    ("phone", re.compile(
        r"(?<![\w+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
        r"|\d{3}[ .-]\d{3}[ .-]\d{4}|(?![01])\d{3}-\d{4}|0\d(?:[ .]\d{2}){4})(?![\w-])")),
    ("key", re.compile(r"(?<!\w)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?:sk[-_]|pk_|ghp_|AKIA)[A-Za-z0-9_-]{12,})(?!\w)")),
]
_EMAIL = re.compile(r"[\w.+%-]+@(?:[\w-]+\.)+[A-Za-z]{2,}")
_DIGIT = re.compile(r"\d")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def detect(text: str) -> list[tuple[int, int, str]]:
    """Start, end and type of the entities of a text, without overlaps; the longer of two that start
    together, the earlier of two that overlap. A surname that stands in a name is also found wherever
    else the text has it by itself, with or without its feminine ending."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern in _WITH_DIGITS:
            for m in pattern.finditer(text):
                own = m[0]
                if kind == "iban" and _mod97(own.replace(" ", "")) != 1:
                    continue
                if kind == "key" and not own.startswith(PREFIXES) and (own.isdigit() or own.isalpha()):
                    continue
                if kind == "phone" and not 7 <= sum(c.isdigit() for c in own) <= 15:
                    continue
                found.append((*m.span(), kind))
    names = list(_NAME.finditer(text))
    found += [(*m.span(), "name") for m in names]
    known = {_surname(m) for m in names} - {""}
    if known:
        forms = {f for n in known for f in (n, n + "а") if f == n or _male_form(f.casefold())[1]}
        again = re.compile(rf"(?<![\w-])(?:{'|'.join(map(re.escape, sorted(forms)))})(?![\w-])")
        found += [(*m.span(), "surname") for m in again.finditer(text)]
    out, upto = [], 0
    for a, b, kind in sorted(found, key=lambda f: (f[0], -f[1])):
        if a >= upto:
            out.append((a, b, kind))
            upto = b
    return out


def _script(word: str) -> str:
    if re.search(r"[Ѐ-ӿ]", word):
        return "cyrillic"
    return "latin" if re.search(r"[A-Za-zÀ-ɏ]", word) else "other"


def _male_form(word: str) -> tuple[str, bool]:
    """A surname without its feminine ending, and whether it had one."""
    if re.search(r"(?:ов|ев|ёв|ин|ын)а$", word):
        return word[:-1], True
    return word, False


def _surname(name: re.Match) -> str:
    """The last name of a match, without a feminine ending; empty where it has a first name only."""
    word = name["b"] or name["last"] or name["a"]
    if word in _GENDER:
        return ""
    return word[: len(_male_form(word.casefold())[0])]


def units(kind: str, mention: str) -> list[tuple[int, int, str, str]]:
    """Start and end in the mention, kind and canonical text of its units."""
    if kind == "email":
        at = mention.rindex("@")
        return [(0, at, "local", mention[:at].lower()), (at + 1, len(mention), "domain", mention[at + 1 :].lower())]
    if kind == "name":
        m = _NAME.match(mention)
        out = []
        gender = next((g for g, ts in TITLES.items() if m["title"] in ts), None) if m["title"] else _GENDER[m["first"]]
        whole = [(g, *m.span(g)) for g in ("a", "b", "first", "last") if m[g]]
        for k, (group, a, b) in enumerate(whole):
            word = mention[a:b]
            if group == "first" or (group == "a" and (m["b"] or word in _GENDER)):
                out.append((a, b, f"first {_GENDER.get(word, gender)} {_script(word)}", word.casefold()))
            else:
                out.append((a, b, f"last {_script(word)}", _male_form(word.casefold())[0]))
        return out
    if kind == "surname":
        return [(0, len(mention), f"last {_script(mention)}", _male_form(mention.casefold())[0])]
    if kind in ("phone", "ssn", "card"):
        return [(0, len(mention), kind, ("+" if mention.startswith("+") else "") + re.sub(r"\D", "", mention))]
    if kind == "iban":
        return [(0, len(mention), kind, mention.replace(" ", ""))]
    return [(0, len(mention), kind, mention)]


def _numbers(key: bytes, kind: str, canon: str, attempt: int) -> Callable[[int], int]:
    """A keyed stream: each call gives a number below its argument."""
    seed = hmac.new(key, f"{kind}\0{canon}\0{attempt}".encode(), hashlib.sha256).digest()
    state = {"at": 0, "pool": b""}

    def below(n: int) -> int:
        if len(state["pool"]) < 8:
            state["pool"] += hmac.new(seed, str(state["at"]).encode(), hashlib.sha256).digest()
            state["at"] += 1
        head, state["pool"] = state["pool"][:8], state["pool"][8:]
        return int.from_bytes(head, "big") % n

    return below


@lru_cache(maxsize=4096)
def _letters(c: str) -> str:
    """Letters a letter may turn into: its script's, of its case. Scripts without a list of their own
    give the letters around it."""
    if _script(c) != "other":
        return "абвгдежзиклмнопрстуфхцчшэюя" if _script(c) == "cyrillic" else "abcdefghijklmnopqrstuvwxyz"
    first = ord(c.lower()) // 32 * 32
    near = "".join(chr(x) for x in range(first, first + 32) if chr(x).isalpha() and chr(x).lower() == chr(x))
    return near or c


def _digits(c: str) -> str:
    """The ten digits of the script that ``c`` is a digit of."""
    zero = ord(c) - unicodedata.decimal(c, 0)
    return "".join(chr(zero + k) for k in range(10))


def _like(text: str, below: Callable[[int], int], hexadecimal: bool = False) -> str:
    """Digits for digits, letters for letters, of the same script and case; everything else stays."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(_digits(c)[below(10)])
        elif hexadecimal and c in "abcdefABCDEF":
            x = "abcdef"[below(6)]
            out.append(x.upper() if c.isupper() else x)
        elif c.isalpha():
            x = _letters(c)[below(len(_letters(c)))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """Canonical text of the surrogate of a unit."""
    below = _numbers(key, kind, canon, attempt)
    longer = _like("0" * (1 + (attempt - LENGTHEN) // 10), below) if attempt >= LENGTHEN else ""
    if kind.startswith(("first ", "last ")):
        parts = kind.split()
        if parts[-1] == "other":
            return _like(canon + canon[-1] * len(longer), below)
        pool = FIRST[(parts[2], parts[1])] if parts[0] == "first" else LAST[parts[1]]
        name = pool[below(len(pool))]
        if attempt:
            name += "-" + pool[below(len(pool))]
        if attempt > 3:
            name += _like(("а" if parts[-1] == "cyrillic" else "a") * (2 + attempt // 4), below)
        return name.casefold()
    if kind == "domain":
        head, _, tail = canon.rpartition(".")
        return _like(head, below) + longer + "." + tail
    if kind == "ip":
        ranges = {1: (1, 9), 2: (10, 90), 3: (100, 156)}
        octets = [ranges[3 if longer else len(o)] for o in canon.split(".")]
        return ".".join(str(low + below(n)) for low, n in octets)
    if kind == "phone":
        keep = 2 if canon.startswith("+") else 0
        return canon[:keep] + _like(canon[keep:], below) + longer
    if kind == "card":
        out = canon[0] + _like(canon[1:], below) + longer
        if _luhn(canon):
            out = next(o for o in (out[:-1] + d for d in _digits(canon[0])) if _luhn(o))
        return out
    if kind == "iban":
        body = canon[:2] + "00" + _like(canon[4:], below) + longer
        return f"{body[:2]}{98 - _mod97(body):02d}{body[4:]}"
    if kind == "key":
        start = next((p for p in PREFIXES if canon.startswith(p)), "")
        return start + _like(canon[len(start) :], below, hexadecimal=not start) + longer
    return _like(canon, below) + longer


def _worn(kind: str, mention: str, new: str) -> str:
    """The surrogate in the format of a mention: its separators, its letter case, its ending."""
    if kind.startswith(("first ", "last ")):
        if kind.startswith("last ") and _male_form(mention.casefold())[1]:
            new += "а"
        return new.upper() if mention.isupper() else "-".join(w.capitalize() for w in new.split("-"))
    if kind in ("local", "domain"):
        return "".join(n.upper() if m.isupper() else n for m, n in zip(mention, new)) + new[len(mention) :]
    if kind in ("phone", "card", "ssn", "iban"):
        fresh = iter(new)
        keep = (lambda c: c.isalnum() or c == "+")
        return "".join(next(fresh) if keep(c) else c for c in mention) + "".join(fresh)
    return new


def replace_entities(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with surrogates, and the number of entities."""
    out, at, found = [], 0, detect(text)
    for a, b, kind in found:
        for lo, hi, unit, canon in units(kind, text[a:b]):
            new = surrogate(key, unit, canon, attempts.get((unit, canon), 0))
            out += [text[at : a + lo], _worn(unit, text[a + lo : a + hi], new)]
            at = a + hi
    return "".join(out) + text[at:], len(found)


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in _blocks(batches):
        rows = []
        for doc_id, key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
            text = text.decode()
            own = {(u, c) for a, b, kind in detect(text) for _, _, u, c in units(kind, text[a:b])}
            rows += [(doc_id, key, u, c) for u, c in sorted(own)]
        cols = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key_id", "key_text", "kind", "canon"])


def mentions(docs: DataFrame) -> DataFrame:
    """key_id, key_text, kind, canon: the distinct units of every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", text_key(F.coalesce("text", F.lit(""))).alias("key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_mentions, "key_id long, key_text long, kind string, canon string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, attempt and sub (the surrogate) for distinct ``entities`` (kind, canon).

    Per kind, surrogates are distinct and none is itself an entity. Of units that collide the first in
    the order of a hash keeps the surrogate; the others try again.
    """

    @F.pandas_udf(T.StringType())
    def make(kind: pd.Series, canon: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, c, a) for k, c, a in zip(kind, canon, attempt)], dtype=object)

    real = entities.select("kind", F.col("canon").alias("sub"))
    pending, done, attempt = entities.select("kind", "canon"), None, 0
    while True:
        tried = checkpoint(pending.select("kind", "canon", F.lit(attempt).alias("attempt"), make("kind", "canon", F.lit(attempt)).alias("sub")))
        free = tried.join(real, ["kind", "sub"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "sub"), ["kind", "sub"], "left_anti")
        first = free.groupBy("kind", "sub").agg(F.min_by("canon", F.struct(F.xxhash64("canon"), "canon")).alias("canon"))
        won = checkpoint(first.select("kind", "canon", F.lit(attempt).alias("attempt"), "sub"))
        done = won if done is None else done.unionByName(won)
        pending = checkpoint(tried.join(won, ["kind", "canon"], "left_anti").select("kind", "canon"))
        if pending.isEmpty():
            return done
        attempt += 1


def _rewrite(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _blocks(batches):
            out, n = [], []
            for again, text, valid in zip(part.column(1).to_pylist(), texts, part.column(2).is_valid().to_pylist()):
                new, count = replace_entities(text.decode(), key, {(x["kind"], x["canon"]): x["attempt"] for x in again or []})
                out.append(new if valid else None)
                n.append(count)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_entities", "text"])

    return run


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, n_entities and text with surrogates for every row of ``docs`` (doc_id, text).

    Documents without entities come back as they were; a null text stays null, with no entities.
    Repeated rows each get a row; null ids are rows like others; other columns are not read; an empty
    table gives an empty result. The same key gives the same surrogates only over the same corpus, since
    collisions depend on what else occurs. Texts are not shuffled unless the units that needed a
    second attempt are too many, by rows or bytes, to be sent to every executor.
    """
    found = checkpoint(mentions(docs))
    again = assign(found.select("kind", "canon").distinct(), key).where("attempt > 0").select("kind", "canon", "attempt")
    # At most one entry per distinct unit of a document.
    per_doc = checkpoint(
        found.join(again, ["kind", "canon"]).groupBy("key_id", "key_text").agg(F.collect_set(F.struct("kind", "canon", "attempt")).alias("again"))
    )
    per_doc = broadcast_if_small(per_doc)
    rows = docs.select("doc_id", text_key(F.coalesce("text", F.lit(""))).alias("key"), "text")
    joined = rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["key_id"]) & (rows["key"] == per_doc["key_text"]), "left")
    return joined.select("doc_id", "again", F.col("text").cast("binary").alias("text")).mapInArrow(_rewrite(key), "doc_id long, n_entities long, text string")
