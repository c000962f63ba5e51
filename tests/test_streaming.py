"""The same rows from a stream as from a batch."""

from pyspark.sql import functions as F

from calyx.streaming import events


def _write(spark, path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 3, float(i)) for i in range(50)] + [(99, "2024-01-01 09:00:00", 0, 1.0)]
    df = spark.createDataFrame(rows, "id int, t string, user int, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.mode("overwrite").parquet(path)
    return df


def test_windows(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch = _write(spark, path)
    stream = spark.readStream.schema(batch.schema).parquet(path)
    query = events.to_files(events.windowed(stream, "ts", ["user"], "10 minutes"), out, str(tmp_path / "ck"))
    query.awaitTermination()
    want = {tuple(r) for r in events.windowed(batch, "ts", ["user"], "10 minutes").where("start < '2024-01-01 01:00:00'").collect()}
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want


def test_sessions_and_repeats(spark, tmp_path):
    path = str(tmp_path / "in")
    batch = _write(spark, path)
    assert sorted((r.user, r.n) for r in events.sessions(batch, "ts", ["user"], "30 minutes").collect()) == [(0, 1), (0, 17), (1, 17), (2, 16)]
    stream = spark.readStream.schema(batch.schema).parquet(path)
    query = events.to_files(events.without_repeats(stream, "ts", ["user"], "1 day"), str(tmp_path / "o"), str(tmp_path / "c"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3


def test_running_totals(spark, tmp_path):
    path = str(tmp_path / "in")
    batch = _write(spark, path)
    stream = spark.readStream.schema(batch.schema).parquet(path)
    query = events.running_totals(stream, "user", "value").writeStream.outputMode("update").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = {r.user: (r.n, r.t) for r in batch.groupBy("user").agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()}
    assert {r.user: (r.n, r.total) for r in spark.table("totals").collect()} == want
