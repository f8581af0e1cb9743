"""The streams give what a batch over the same rows gives."""

from pyspark.sql import functions as F

from cairnlake.streaming import counters


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def source(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 300")
    rows = e.select(F.col("ts").cast("timestamp").alias("ts"), F.lit("GET").alias("method"), F.concat(F.lit("/v2/files/"), F.col("user_id").cast("string")).alias("path"), (F.lit(200) + F.col("event_id") % 2).alias("status"), (F.col("event_id") % 40).cast("string").alias("hash"))
    rows.write.parquet(str(tmp_path / "events"))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events")), rows


def test_counts(spark, tmp_path):
    stream, rows = source(spark, tmp_path)
    got = run(counters.request_counts(stream), "counts", "complete")
    assert got.agg(F.sum("n")).first()[0] == rows.count()
    assert {r["path"] for r in got.collect()} == {"/v2/files/:id"}


def test_first_uploads(spark, tmp_path):
    stream, rows = source(spark, tmp_path)
    got = run(counters.first_uploads(stream, "5000 days"), "uploads", "append")
    assert got.count() == rows.select("hash").distinct().count()
