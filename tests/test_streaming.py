from pyspark.sql import functions as F

from quernstone.streaming import state


def run(spark, df, name):
    q = df.writeStream.outputMode("update").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"select * from {name}").collect()


def source(spark, tmp_path):
    rows = [("a", "x", "2025-01-01 00:00:01"), ("a", "y", "2025-01-01 00:00:30"), ("b", "z", "2025-01-01 00:05:00")]
    spark.createDataFrame(rows, "k string, v string, t string").withColumn("t", F.col("t").cast("timestamp")).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("k string, v string, t timestamp").parquet(str(tmp_path / "in"))


def test_rates(spark, tmp_path):
    assert {(r.k, r.n) for r in run(spark, state.request_rates(source(spark, tmp_path), "k", "t"), "rates")} == {("a", 2), ("b", 1)}


def test_cache(spark, tmp_path):
    got = run(spark, state.ttl_cache(source(spark, tmp_path), "k", "v", "t"), "cache")
    assert {(r.key, r.data) for r in got} == {("a", "y"), ("b", "z")}
