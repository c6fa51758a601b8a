from pyspark.sql import functions as F

from checks import inputs as I


def test_rows_of_a_split_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "ROWS_PER_TASK", 100)
    spark.range(5000).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    dealt = I.texts(spark, str(tmp_path), "orders")
    assert dealt.rdd.getNumPartitions() == 50
    assert max(dealt.rdd.glom().map(len).collect()) <= 200
    assert dealt.select(F.sum("id")).first()[0] == 5000 * 4999 // 2
