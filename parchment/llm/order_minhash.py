"""Order MinHash fingerprints of documents, with DataFrame functions only.

A text is cut into pieces (runs of at most ``PIECE`` characters that are not white space), every ``K``
successive pieces are a k-mer, and equal k-mers of a text are numbered by their occurrence. Each of
``SKETCHES`` hash functions selects the numbered k-mer that is minimal under it. Two selected k-mers,
those of a function and of the one after it, are put in the order they have in the text, and the hash of
that ordered pair is one part of the signature. Parts agree where both texts select the same k-mers in the
same order, so moved passages tell, not only shared ones: likeness follows the edit distance.

Each text crosses the network once, keyed by id, to meet the head of its neighbour; its k-mers are numbered
by sorting inside the row and selected by minima that combine where the text lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.common import checkpoint, salt_set, salts_in, SALTS
from parchment.session import stored

K = 5
PIECE = 16
SKETCHES = 64
# The low bits of a selected value hold the k-mer's place in its text, the others its hash.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
PART_HEX = 4
# Ids that share all but their last bits are put in order by one task.
ID_BITS = 12
FEW_IDS = 1_000


def kmers(text: Column, k: int = K) -> Column:
    """Hashes of the k-mers along the text. Fewer than ``k`` pieces are one k-mer, and so are none."""
    cut = lambda p: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(p) - k, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(p, i + j) for j in range(k)]),
    )
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(rf"\S{{1,{PIECE}}}"), F.lit(0))), cut)[0]


def numbered(hashes: Column) -> Column:
    """Every k-mer with the number of its occurrence hashed in, and its place in the low bits; places
    of texts with more k-mers than fit there are cut to the first of their bits."""

    def packed(h: Column, at: Column, number: Column, n: Column) -> Column:
        over = F.when(n <= 1 << PLACE_BITS, 0).otherwise(F.length(F.bin(n)) - PLACE_BITS)
        place = F.call_function("shiftright", at.cast("long"), over)
        return F.xxhash64(h, number).bitwiseAND(F.lit(~PLACE)).bitwiseOR(place)

    def low(h: Column) -> Column:
        return F.when(F.size(h) <= 1 << 20, F.lit((1 << 20) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("long")

    def runs(order: Column, h: Column) -> Column:
        place = lambda j: F.get(order, j).bitwiseAND(low(h)).cast("int")
        head = lambda j: F.get(order, j).bitwiseAND(F.bitwise_not(low(h)))
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda j: (j == 0) | (head(j) != head(j - 1)))
        number = lambda s: F.flatten(
            F.transform(
                s,
                lambda a, r: F.transform(
                    F.sequence(a, F.coalesce(F.get(s, r + 1), F.size(h)) - 1),
                    lambda j: packed(F.get(h, place(j)), place(j), j - a, F.size(h)),
                ),
            )
        )
        return F.transform(F.array(starts), number)[0]

    def of(h: Column) -> Column:
        # Sorted with the place in the low bits, equal k-mers stand together in the order of the text.
        order = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low(h))).bitwiseOR(i.cast("long"))))
        alone = F.transform(h, lambda x, i: packed(x, i, F.lit(0), F.size(h)))
        repeated = F.transform(F.array(order), lambda o: runs(o, h))[0]
        return F.when(F.size(F.array_distinct(h)) == F.size(h), alone).otherwise(repeated)

    return F.transform(F.array(hashes), of)[0]


def _signature(least: list[str]) -> Column:
    """Hex parts from the minima: neighbours in the ring of hash functions, ordered by their place."""

    def part(a: str, b: str) -> Column:
        x, y = F.col(a), F.col(b)
        first = x.bitwiseAND(F.lit(PLACE)) <= y.bitwiseAND(F.lit(PLACE))
        left, right = F.when(first, x).otherwise(y), F.when(first, y).otherwise(x)
        pair = F.xxhash64(F.shiftright(left, PLACE_BITS), F.shiftright(right, PLACE_BITS))
        return F.lpad(F.lower(F.hex(pair.bitwiseAND(F.lit((1 << 4 * PART_HEX) - 1)))), PART_HEX, "0")

    return F.concat(*[part(a, b) for a, b in zip(least, [*least[1:], least[0]])])


def signatures(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``rows`` and ``fingerprint`` of every distinct ``keys``; rows that agree on ``keys`` must agree
    on the text, and are counted. No shuffle where ``texts`` is already dealt out by some of ``keys``."""
    least = [f"_m{i}" for i in range(SKETCHES)]
    each = texts.select(*keys, F.posexplode(numbered(kmers(F.col(text)))).alias("_at", "_item"))
    item = each.select(*keys, "_at", F.shiftright("_item", PLACE_BITS).alias("_id"), F.col("_item").bitwiseAND(F.lit(PLACE)).alias("_place"))
    value = lambda i: F.xxhash64(F.col("_id"), F.lit(i)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(F.col("_place"))
    found = item.groupBy(*keys).agg(
        F.count_if(F.col("_at") == 0).alias("rows"), *[F.min(value(i)).alias(least[i]) for i in range(SKETCHES)]
    )
    return found.select(*keys, "rows", _signature(least).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the parts in which two fingerprints agree, 0 to 1."""
    x, y, size = F.unhex(a), F.unhex(b), PART_HEX // 2
    same = [(F.substring(x, i * size + 1, size) == F.substring(y, i * size + 1, size)).cast("int") for i in range(SKETCHES)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(SKETCHES))


def _previous(rows: DataFrame) -> DataFrame:
    """key and before (the ``last`` of the nearest smaller key) from distinct (key, last), both ascending."""
    if rows.limit(FEW_IDS + 1).count() <= FEW_IDS:
        return rows.select("key", F.lag("last").over(Window.orderBy("key")).alias("before"))
    blocks = rows.withColumn("block", F.shiftright("key", ID_BITS))
    upper = checkpoint(blocks.groupBy(F.col("block").alias("key")).agg(F.max("last").alias("last")))
    entering = _previous(upper).select(F.col("key").alias("block"), F.col("before").alias("entering"))
    inside = F.lag("last").over(Window.partitionBy("block").orderBy("key"))
    return blocks.withColumn("inside", inside).join(entering, "block").select("key", F.coalesce("inside", "entering").alias("before"))


def _neighbours(texts: DataFrame) -> DataFrame:
    """Per id (k, z): mark of the text that stands for it, and of the id before it in the ring of
    descending ids: its key (pk, pz), half of its longest text, the salts of its texts."""
    half = F.expr("char_length(text) div 2").cast("int")
    salted = texts.groupBy("k", "z", "salt").agg(F.max(half).alias("half"), F.min(F.xxhash64("text")).alias("mark"))
    ids = checkpoint(salted.groupBy("k", "z").agg(F.max("half").alias("half"), F.min("mark").alias("mark"), salt_set("salt").alias("salts")))
    known = ids.where("not z")
    lower = _previous(known.select(F.col("k").alias("key"), F.col("k").alias("last")))
    ends = ids.agg(F.max(F.when(~F.col("z"), F.col("k"))).alias("top"), F.max("z").alias("has_null"))
    # One row: the largest id, and whether there is a null one, which comes last in descending order.
    ring = ids.join(lower.withColumnRenamed("key", "k").withColumn("z", F.lit(False)), ["k", "z"], "left").join(F.broadcast(ends))
    to_null = ~F.col("z") & F.col("before").isNull() & F.col("has_null") | F.col("top").isNull()
    out = ring.select(
        F.when(to_null, F.lit(0)).otherwise(F.coalesce("before", "top")).cast("long").alias("k"),
        to_null.alias("z"),
        F.col("k").alias("pk"), F.col("z").alias("pz"), "half", "salts",
    )
    return checkpoint(out.join(ids.select("k", "z", "mark"), ["k", "z"]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, an integer, and text): its fingerprint, that of the edited
    text, and their likeness.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint and edited_fingerprint (64 parts of four
    hex digits), near_edited, near_next. The edited text has its last floor(n_chars / 2) code points replaced
    by as many from the head of the next document by descending id, or all it has; the largest id follows
    the smallest. A null text counts as empty; texts without pieces have one k-mer, the empty one. A null id comes
    after all others; several rows of one id share their neighbours, and the text with the least XXH64 stands for
    them as the next document of another id. Repeated rows each get a row. A lone id is its own neighbour. Other
    columns are not read. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).cast("long").alias("k"), doc_id.isNull().alias("z"), text.alias("text"))
    # By the text, so that an id that many rows repeat is spread.
    of_text = lambda mark: F.pmod(mark, F.lit(SALTS)).cast("int")
    texts = rows.withColumn("salt", of_text(F.xxhash64("text")))
    around = _neighbours(texts)
    keys = ["k", "z", "salt"]
    source = around.withColumn("salt", of_text(F.col("mark")))
    # Written so that the mark is no join key: both joins then share one exchange of the texts.
    arriving = texts.join(source, keys).where(F.xxhash64("text").bitwiseXOR(F.col("mark")) == 0)
    heads = (
        arriving.select(F.col("pk").alias("k"), F.col("pz").alias("z"), salts_in("salts").alias("salt"), F.expr("left(text, half)").alias("head"))
        .groupBy(*keys)
        .agg(F.min("head").alias("head"))
    )
    met = texts.join(heads, keys).withColumn("n_chars", F.char_length("text").cast("long"))
    met = met.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(head, cast(n_chars div 2 as int)))"))
    sha = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    both = met.select(
        *keys, F.xxhash64("text").alias("mark"), "n_chars", sha,
        F.explode(F.array(F.struct(F.lit(False).alias("changed"), "text"), F.struct(F.lit(True).alias("changed"), F.col("edited").alias("text")))).alias("own"),
    )
    row = [*keys, "mark", "n_chars", "edited_sha256"]
    signed = signatures(both.select(*row, "own.changed", "own.text"), [*row, "changed"])
    of = lambda changed: F.max(F.when(F.col("changed") == F.lit(changed), F.col("fingerprint")))
    found = stored(
        signed.groupBy(*row).agg(F.max("rows").alias("rows"), of(False).alias("fingerprint"), of(True).alias("edited_fingerprint")),
        "order-minhash",
    )
    following = (
        found.select(*keys, "mark", "fingerprint")
        .join(source, [*keys, "mark"])
        .select(F.col("pk").alias("k"), F.col("pz").alias("z"), salts_in("salts").alias("salt"), F.unhex("fingerprint").alias("next"))
        .groupBy(*keys)
        .agg(F.min("next").alias("next"))
    )
    out = found.join(following, keys).withColumn("one", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select(
        F.when(~F.col("z"), F.col("k")).cast(kind).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.hex("next")).alias("near_next"),
    )
