"""Windows are many more rows than the lengths that they are made of, and must not be sent to the driver."""

from pyspark.sql import functions as F

from tidemark.operators import windows


def test_windows_are_shuffled(spark):
    nav = spark.range(4000).select(F.lit("a").alias("series_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("nav"))
    lengths = nav.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    found = windows.window_extremes(nav, windows.walk_forward_windows(lengths, 100, 50))
    rows = found.collect()
    assert {(r["low"], r["high"]) for r in rows if r["anchor"] == 0 and r["window"] == 1} == {(0.0, 149.0), (150.0, 199.0)}
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
