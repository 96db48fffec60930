"""Prices by the longest list: prefixes are joined by equality."""

from pyspark.sql import functions as F

from jobloom.operators import clustering as C


def test_rates_of_a_long_price_list(spark):
    prices = spark.range(100_000).select(F.col("id").cast("int").alias("priority"), F.concat(F.lit("m"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("model_prefix"), F.lit("2").cast("decimal(10,4)").alias("input_rate"), F.lit("4").cast("decimal(10,4)").alias("output_rate"))
    more = spark.createDataFrame([(-1, "m000007", "5", "6"), (200_000, "", "7", "8")], "priority int, model_prefix string, a string, b string")
    prices = prices.unionByName(more.select("priority", "model_prefix", F.col("a").cast("decimal(10,4)").alias("input_rate"), F.col("b").cast("decimal(10,4)").alias("output_rate")))
    calls = spark.createDataFrame([("m000007-large", 1), ("m012345", 2), ("other", 3), (None, 4), ("m000007-large", 5), ("m", 6)], "model string, n int")
    found = C.attach_rates(calls, prices, "model", ("1", "1"))
    assert {r["n"]: int(r["input_rate"]) for r in found.collect()} == {1: 5, 2: 2, 3: 7, 4: 1, 5: 5, 6: 7}
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
