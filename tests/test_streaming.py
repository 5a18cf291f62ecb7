from pyspark.sql import functions as F

from tarnwork.streaming.windows import sessions, tumbling


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = spark.range(400).select((F.lit(1767225600) + F.col("id") * 1800).cast("timestamp").alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    for n, f in (("tumbling", tumbling), ("sessions", lambda e: sessions(e, "3 hours"))):
        stream = f(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.outputMode("complete").format("memory").queryName(n).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(n).collect())) == sorted(map(tuple, f(rows).collect()))
