"""Document and event analytics as Spark jobs: DataFrame in, DataFrame out."""
