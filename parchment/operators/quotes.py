"""Quotes looked up in all documents: containment, or 90 % of a quote's four-word shingles.

A join with a count threshold. A shingle that occurs in a document has its two middle words there as whole
words, one after the other, whatever its outer words end in; that pair is its key. Of ``n`` shingles at most a
tenth may be missing, so of any tenth plus one at least one is there: only a quote's rarest keys, enough to
cover that many shingles, have to meet the documents. Quotes of three words are looked up by the
middle one, shorter ones by the words of the vocabulary that hold them. Candidates are few, and
each is then judged in full on its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import citations as C
from parchment.session import broadcast_if_small, stored


def _pairs(words: Column) -> Column:
    """Adjacent whole words, first to last."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1)))
    pairs = F.transform(starts, lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def _long_keys(quotes: DataFrame) -> DataFrame:
    """quote_no, key and n (shingles of that key) of quotes with four words or more, and how many ``may_miss``."""
    middles = _pairs(F.slice("words", F.lit(2), F.size("words") - 2))
    total = F.size("words") - C.SHINGLE + 1
    # The same comparison as in the judgement, so that rounding cannot lose a candidate.
    misses = F.size(F.filter(F.sequence(F.lit(1), total), lambda m: (total - m) / total >= C.SHINGLE_SHARE))
    rows = quotes.where(F.size("words") >= C.SHINGLE)
    exploded = rows.select("quote_no", misses.alias("may_miss"), F.explode(middles).alias("key"))
    return exploded.groupBy("quote_no", "may_miss", "key").agg(F.count(F.lit(1)).alias("n"))


def _rarest(keys: DataFrame, found_in: DataFrame) -> DataFrame:
    """The keys of each quote, rarest first, until they cover one shingle more than may be missing."""
    rare = Window.partitionBy("quote_no").orderBy("df", "key").rowsBetween(Window.unboundedPreceding, -1)
    counted = keys.join(found_in, "key", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ahead = counted.withColumn("ahead", F.coalesce(F.sum("n").over(rare), F.lit(0)))
    return ahead.where((F.col("ahead") <= F.col("may_miss")) & (F.col("df") > 0)).select("quote_no", "key")


def _short_keys(quotes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """quote_no and the whole words of the documents that a quote of up to three words can stand in."""
    three = quotes.where(F.size("words") == 3).select("quote_no", F.get("words", F.lit(1)).alias("key"))
    # A word that ends like the first of two (or begins like the second, where the first is empty), and a
    # word that holds the only one: runs of the asked lengths, cut from each distinct word once.
    first, second = F.get("words", F.lit(0)), F.get("words", F.lit(1))
    side = F.when(F.size("words") == 1, "any").when(first != "", "end").otherwise("start")
    part = quotes.where(F.size("words") < 3).select("quote_no", F.when(side == "start", second).otherwise(first).alias("part"), side.alias("side"))
    part = part.withColumn("size", F.length("part"))
    # One row: the lengths that quotes of one and two words have.
    sizes = part.agg(F.collect_set(F.struct("size", "side")).alias("sizes"))
    word, n = F.col("word"), F.col("cut.size")
    last = F.length(word) - n + 1
    runs = (
        F.when(F.col("cut.side") == "end", F.array(F.substring(word, last, n)))
        .when(F.col("cut.side") == "start", F.array(F.substring(word, F.lit(1), n)))
        .otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(word, i, n))))
    )
    fitting = vocabulary.crossJoin(F.broadcast(sizes)).select("word", F.explode(F.filter("sizes", lambda s: s["size"] <= F.length("word"))).alias("cut"))
    held = part.join(fitting.select("word", F.col("cut.side").alias("side"), F.explode(runs).alias("part")), ["part", "side"])
    held = held.select("quote_no", F.col("word").alias("key"))
    return three.unionByName(held)


def quoted_in(docs: DataFrame, quotes: DataFrame, doc_keys: list[str], quote_keys: list[str], text: str = "text") -> DataFrame:
    """(quote_keys, doc_keys) of every quote that ``quote_supported`` finds in a document.

    Both tables need ``text`` and keys that are not null. Quotes without words are found nowhere; a quote whose keys repeat is one row
    for each text it has, and pairs come once.
    """
    forms = docs.select(*doc_keys, C.haystack_form(F.col(text)).alias("haystack"))
    asked = quotes.select(*quote_keys, C.haystack_form(F.col(text)).alias("quote")).where(F.trim("quote") != "").distinct()
    asked = stored(
        asked.select(*quote_keys, "quote", F.split("quote", " ").alias("words"), F.xxhash64(*quote_keys, "quote").alias("quote_no")),
        "quotes",
    )
    short = not asked.where(F.size("words") < C.SHINGLE).isEmpty()
    long_keys = stored(_long_keys(asked), "quote-keys")
    words = forms.select(*doc_keys, F.split("haystack", " ").alias("words"))
    keys = long_keys.select("key").distinct()
    if short:
        vocabulary = stored(words.select(F.explode("words").alias("word")).where("word <> ''").distinct(), "quote-vocabulary")
        short_keys = stored(_short_keys(asked, vocabulary), "quote-words")
        keys = keys.unionByName(short_keys.select("key").distinct())
        runs = F.concat(_pairs(F.col("words")), F.col("words"))
    else:
        runs = _pairs(F.col("words"))
    # Keys no quote has are dropped where the text lies.
    met = words.select(*doc_keys, F.explode(F.array_distinct(runs)).alias("key")).join(broadcast_if_small(keys), "key", "left_semi")
    met = stored(met, "quote-postings")
    chosen = _rarest(long_keys, met.groupBy("key").agg(F.count(F.lit(1)).alias("df")))
    if short:
        chosen = chosen.unionByName(short_keys)
    pairs = met.join(chosen, "key").select(*doc_keys, "quote_no").distinct()
    full = pairs.join(asked.select(*quote_keys, "quote", "quote_no"), "quote_no").join(forms, doc_keys)
    return full.where(C.quote_supported(F.col("quote"), F.col("haystack"))).select(*quote_keys, *doc_keys).distinct()
