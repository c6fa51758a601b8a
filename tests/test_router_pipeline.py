"""The router as a pipeline: held-out accuracy, save and load, texts without labels."""

import random

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from parchment.operators import router, router_pipeline


def texts(spark, n=300):
    rng = random.Random(4)
    topics = {"qa": "what when who which".split(), "summary": "overview recap short outline".split(), "extract": "table figures amounts dates".split()}
    common = [f"word{i}" for i in range(50)]
    rows = []
    for i in range(n):
        label = rng.choice(list(topics))
        rows.append((i, label, " ".join(rng.sample(common, 6) + rng.choices(topics[label], k=2))))
    return spark.createDataFrame([*rows, (1000, None, "what who"), (1001, "qa", None)], "key long, label string, text string")


def test_held_out_accuracy_and_saved_parity(spark, tmp_path):
    t = texts(spark)
    model = router_pipeline.fit(t.where("key % 4 <> 0"), width=1 << 12)
    assert router_pipeline.classes(model) == ["extract", "qa", "summary"]
    held = t.where("key % 4 = 0 and label is not null")
    scored = router_pipeline.scores(model, held.drop("label"), "key")
    judged = router.predicted(scored, router_pipeline.classes(model)).join(held.select("key", "label"), "key")
    assert router.require_accuracy(judged, least=0.95) >= 0.95
    model.write().overwrite().save(str(tmp_path / "router"))
    again = router_pipeline.scores(PipelineModel.load(str(tmp_path / "router")), held, "key")
    parity = lambda df: sorted((r.key, round(r.qa, 4), round(r.summary, 4)) for r in df.collect())
    assert parity(scored) == parity(again)


def test_probabilities_of_any_text(spark):
    t = texts(spark, 60)
    model = router_pipeline.fit(t, width=1 << 10)
    got = router_pipeline.scores(model, spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "what who")], "key int, text string"), "key")
    rows = got.select("*", F.round(sum(F.col(c) for c in router_pipeline.classes(model)), 6).alias("total")).collect()
    assert len(rows) == 4 and {r.total for r in rows} == {1.0}
