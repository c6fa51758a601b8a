"""The intent router as a Spark ML pipeline: hashed 1-2-grams of fixed width, tf-idf, logistic regression.

No vocabulary is built: terms fall into ``WIDTH`` slots, so the model's size depends on that number and the
classes only, whatever texts it is fitted on. All stages run in Spark; the fitted pipeline is saved and
loaded as one object.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.operators.router import REGULARISATION_C

WIDTH = 1 << 16

_WORDS = r"SELECT *, regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}', 0) AS router_words FROM __THIS__"
_GRAMS = """SELECT *, concat(router_words, if(size(router_words) > 1,
    transform(sequence(0, size(router_words) - 2), i -> concat(router_words[i], ' ', router_words[i + 1])), array())) AS router_grams FROM __THIS__"""


def fit(texts: DataFrame, label: str = "label", text: str = "text", width: int = WIDTH, iterations: int = 50) -> PipelineModel:
    """Fitted on labelled texts; rows without a label are passed over."""
    known = texts.where(F.col(label).isNotNull()).select(label, text)
    penalty = 1.0 / (REGULARISATION_C * max(known.count(), 1))
    stages = [
        SQLTransformer(statement=_WORDS.format(text=text)),
        SQLTransformer(statement=_GRAMS),
        HashingTF(numFeatures=width, inputCol="router_grams", outputCol="router_counts"),
        IDF(inputCol="router_counts", outputCol="router_weights"),
        Normalizer(inputCol="router_weights", outputCol="features"),
        StringIndexer(inputCol=label, outputCol="router_class", stringOrderType="alphabetAsc"),
        LogisticRegression(
            labelCol="router_class", featuresCol="features", family="multinomial", standardization=False, regParam=penalty, maxIter=iterations
        ),
    ]
    return Pipeline(stages=stages).fit(known)


def classes(model: PipelineModel) -> list[str]:
    return list(model.stages[-2].labels)


def scores(model: PipelineModel, texts: DataFrame, key: str) -> DataFrame:
    """(key, a probability per class) of every text; labels are not needed."""
    ready = model.stages[:-2] + model.stages[-1:]
    found = PipelineModel(ready).transform(texts)
    names = classes(model)
    return found.select(key, vector_to_array("probability").alias("p")).select(
        key, *[F.col("p")[i].alias(c) for i, c in enumerate(names)]
    )
