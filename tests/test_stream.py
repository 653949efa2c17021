from pyspark.sql import functions as F

from tabulon.streaming import review


def test_cluster_summary_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "0.5"), ("a", "1.0"), ("b", "x")], "c string, s string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = review.stream_cluster_summary(stream, "c", "s").writeStream.outputMode("complete").format("memory").queryName("t1").start()
    q.processAllAvailable()
    q.stop()
    got = {r["cluster_id"]: (r["size"], r["average_match_score"]) for r in spark.table("t1").select("*", F.lit(1)).collect()}
    assert got == {"a": (2, 0.75), "b": (1, None)}
