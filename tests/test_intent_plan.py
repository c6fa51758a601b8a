import pytest

from parchment.operators import router


def test_features_join_the_vocabulary_once(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 1)], "key int, term string, tf long")
    idf = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "term string, idf double")
    found = router.features(counts, idf, "key")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    rows = {(r.key, r.term): r.weight for r in found.collect()}
    assert rows[2, "b"] == pytest.approx(1) and rows[1, "a"] ** 2 + rows[1, "b"] ** 2 == pytest.approx(1)
