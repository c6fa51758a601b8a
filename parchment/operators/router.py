"""Intent routing: 1-2-gram tf-idf features, multinomial logistic regression, routing rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import bound, is_summary_request
from parchment.operators import router_training
from parchment.session import broadcast_if_small, stored

MIN_CONFIDENCE = 0.45
MIN_CONFIDENCE_GENERAL = 0.5
MAX_OVERLAP_FOR_GENERAL = 0.15
REGULARISATION_C = 10.0
MIN_ACCURACY = 0.9
# Weights of a model that the driver may hold, at about 200 bytes each while it is fitted.
LOCAL_WEIGHTS = 500_000


def grams(text: Column) -> Column:
    """Words of two or more characters, then pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))

    def with_pairs(w: Column) -> Column:
        return F.concat(
            w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        )

    return bound(words, with_pairs)


def gram_counts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf). Rows of a text come from one row, and are combined before the shuffle."""
    return (
        texts.select(key, F.explode(grams(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    )


def fit_idf(counts: DataFrame, total: DataFrame) -> DataFrame:
    """(term, idf) with idf = ln((1 + n) / (1 + df)) + 1; ``total`` is one row with column ``n``."""
    return _frequencies(counts, total).select("term", "idf")


def _frequencies(counts: DataFrame, total: DataFrame) -> DataFrame:
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(total)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def features(counts: DataFrame, idf: DataFrame, key: str, named: tuple[str, ...] = ("term",)) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * idf, scaled to unit length; unknown terms dropped. ``named`` are the
    columns of ``idf`` that tell of a term."""
    raw = counts.join(idf, "term").select(key, *named, ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    # A key's rows are one text's terms; the sum over them spares a second join with the vocabulary.
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, *named, (F.col("raw") / norm).alias("weight"))


def score(counts: DataFrame, model: DataFrame, intercepts: dict[str, float], key: str) -> DataFrame:
    """(key, one probability column per class) from a weights table (term, idf, coef array).

    One pass: per text the squared length and each class's sum, then the softmax.
    """
    classes = list(intercepts)
    raw = counts.join(broadcast_if_small(model), "term").withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    sums = raw.groupBy(key).agg(
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"),
        *[F.sum(F.col("raw") * F.get("coef", F.lit(i))).alias(f"z{i}") for i in range(len(classes))],
    )
    logits = [F.lit(float(b)) + F.col(f"z{i}") / F.col("norm") for i, b in enumerate(intercepts.values())]
    shifted = sums.select(key, F.array(*logits).alias("z")).select(
        key, F.transform("z", lambda v: F.exp(v - F.array_max("z"))).alias("e")
    )
    total = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
    return shifted.select(key, *[(F.get("e", F.lit(i)) / total).alias(c) for i, c in enumerate(classes)])


def complete_scores(scores: DataFrame, keys: DataFrame, intercepts: dict[str, float], key: str) -> DataFrame:
    """Texts with no known term get the classes' base rates (softmax of the intercepts)."""
    import math

    top = max(intercepts.values())
    weights = {c: math.exp(b - top) for c, b in intercepts.items()}
    total = sum(weights.values())
    return keys.select(key).join(scores, key, "left").select(
        key, *[F.coalesce(c, F.lit(w / total)).alias(c) for c, w in weights.items()]
    )


@dataclass
class Router:
    model: DataFrame  # term, idf, coef array in class order
    intercepts: dict[str, float]

    def predict(self, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
        scores = score(gram_counts(texts, key, text), self.model, self.intercepts, key)
        return complete_scores(scores, texts, self.intercepts, key)


    def rounded(self, places: int = 5) -> Router:
        """The model as it is published: weights and intercepts at a few decimals."""
        weights = self.model.select(
            "term", F.round("idf", places).alias("idf"), F.transform("coef", lambda c: F.round(c, places)).alias("coef")
        )
        return Router(weights, {c: round(b, places) for c, b in self.intercepts.items()})

    def parity(self, texts: DataFrame, key: str, places: int = 4) -> DataFrame:
        """Rounded probabilities of fixed texts, to compare another scorer with."""
        return self.predict(texts, key).select(key, *[F.round(c, places).alias(c) for c in self.intercepts])


def _sparse(size: int):
    @F.udf(VectorUDT())
    def build(pairs):
        pairs = sorted((p["i"], p["weight"]) for p in pairs)
        return Vectors.sparse(size, [i for i, _ in pairs], [w for _, w in pairs])

    return build


def train(
    texts: DataFrame, key: str, label: str, text: str = "text", iterations: int = 100, local_weights: int = LOCAL_WEIGHTS
) -> Router:
    """Fits the classifier on labelled texts; the result is a weights table, not a local object.

    Up to ``local_weights`` weights (terms times classes) are fitted by MLlib, which keeps them and some twenty
    vectors like them on the driver. More are fitted over tables (``router_training``), to the same optimum.
    """
    counts = stored(gram_counts(texts, key, text), "gram-counts")
    total = texts.agg(F.count("*").alias("n"))
    n = total.first()["n"]
    # Written once, so that a term keeps its number.
    known = _frequencies(counts, total).select("term", "idf", (F.col("df") > 1).alias("shared"), F.monotonically_increasing_id().alias("i"))
    vocabulary = stored(known, "vocabulary")
    size = vocabulary.count()
    classes = [r[0] for r in texts.select(label).distinct().orderBy(label).collect()]
    indexed = F.array_position(F.lit(classes), F.col(label)).cast("double") - 1
    labels = texts.select(key, indexed.alias("label"))
    penalty = 1.0 / (REGULARISATION_C * n)
    fit = _fit_local if size * len(classes) <= local_weights else _fit_spread
    model, intercepts = fit(counts, vocabulary, labels, key, len(classes), penalty, iterations)
    return Router(model, dict(zip(classes, intercepts, strict=True)))


def _fit_local(counts, vocabulary, labels, key, classes, penalty, iterations):
    """Terms are numbered in their order."""
    spark = counts.sparkSession
    weighted = features(counts, vocabulary, key)
    ordered = spark.createDataFrame(
        vocabulary.orderBy("term").rdd.zipWithIndex().map(lambda r: (r[0]["term"], r[0]["idf"], r[1])),
        "term string, idf double, i long",
    )
    size = vocabulary.count()
    vectors = weighted.join(ordered.select("term", "i"), "term").groupBy(key).agg(F.collect_list(F.struct("i", "weight")).alias("pairs"))
    data = labels.join(vectors, key).select("label", _sparse(size)("pairs").alias("features"))
    fitted = LogisticRegression(family="multinomial", standardization=False, regParam=penalty, maxIter=iterations).fit(data)
    coef = fitted.coefficientMatrix.toArray()
    rows = ((i, [float(v) for v in coef[:, i]]) for i in range(size))
    weights = spark.createDataFrame(rows, "i long, coef array<double>")
    return ordered.join(weights, "i").select("term", "idf", "coef"), [float(b) for b in fitted.interceptVector]


def _fit_spread(counts, vocabulary, labels, key, classes, penalty, iterations):
    """Weights, gradients and their history stay in tables; a term's text meets its number once."""
    entries = stored(features(counts, vocabulary, key, ("i", "shared")), "text-terms")
    dual, intercepts = router_training.fit(entries, labels, key, classes, penalty, iterations)
    coef = entries.join(dual, key).groupBy("i").agg(
        F.array(*[F.sum(F.col("weight") * F.get("dual", F.lit(c))) for c in range(classes)]).alias("coef")
    )
    return stored(vocabulary.join(coef, "i").select("term", "idf", "coef"), "weights"), intercepts


def top_class(classes: list[str]) -> Column:
    """(confidence, class) of the most likely class; the earlier class wins a tie."""
    return F.greatest(
        *[
            F.struct(F.col(c).alias("confidence"), F.lit(-i).alias("order"), F.lit(c).alias("intent"))
            for i, c in enumerate(classes)
        ]
    )


def route(scored: DataFrame, classes: list[str], text: str = "text") -> DataFrame:
    """Adds ``intent``, ``confidence`` and ``reason``; needs ``has_document`` and ``overlap``."""
    top = F.col("_top.intent")
    confidence = F.col("_top.confidence")
    summary = is_summary_request(F.col(text)) & top.isin("qa", "summary")
    general = top == "general"
    sure = (confidence >= MIN_CONFIDENCE_GENERAL) & (F.col("overlap") < MAX_OVERLAP_FOR_GENERAL)
    low = confidence < MIN_CONFIDENCE

    def decided(intent: Column | str, conf: Column, reason: Column | str) -> Column:
        as_col = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.struct(as_col(intent).alias("intent"), conf.alias("confidence"), as_col(reason).alias("reason"))

    choice = (
        F.when(~F.col("has_document"), decided("chat", F.lit(1.0), "no document loaded"))
        .when(summary, decided("summary", F.greatest(confidence, F.col("summary")), "summary phrasing"))
        .when(general & sure, decided("general", confidence, "unrelated to the document"))
        .when(general, decided("qa", F.col("qa"), "possibly general, but shares vocabulary with the document"))
        .when(low, decided("qa", confidence, F.concat(F.lit("low confidence for "), top)))
        .otherwise(decided(top, confidence, "router"))
    )
    return scored.withColumn("_top", top_class(classes)).withColumn("_choice", choice).select(
        *scored.columns, "_choice.intent", "_choice.confidence", "_choice.reason"
    )


def predicted(scored: DataFrame, classes: list[str]) -> DataFrame:
    return scored.withColumn("predicted", top_class(classes)["intent"])


def confusion(scored: DataFrame, label: str = "label") -> DataFrame:
    return scored.groupBy(label, "predicted").agg(F.count("*").alias("texts"))


def accuracy(scored: DataFrame, label: str = "label") -> DataFrame:
    return scored.agg(
        F.count("*").alias("texts"),
        F.count_if(F.col(label) == F.col("predicted")).alias("correct"),
        F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("accuracy"),
    )


def require_accuracy(scored: DataFrame, label: str = "label", least: float = MIN_ACCURACY) -> float:
    """Refuses a model under the gate."""
    found = accuracy(scored, label).first()["accuracy"] or 0.0
    if found < least:
        raise ValueError(f"held-out accuracy {found:.4f} is under {least}")
    return found


def training_problems(train_texts: DataFrame, test_texts: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """Texts in both sets and classes without examples; empty when the data is sound."""
    shared = (
        train_texts.select(F.lower("text").alias("detail"))
        .intersect(test_texts.select(F.lower("text").alias("detail")))
        .select(F.lit("in both sets").alias("problem"), "detail")
    )
    spark = train_texts.sparkSession
    wanted = spark.createDataFrame([(c,) for c in classes], "detail string")
    missing = wanted.join(train_texts.select(F.col(label).alias("detail")).distinct(), "detail", "left_anti")
    return shared.unionByName(missing.select(F.lit("no examples").alias("problem"), "detail"))
