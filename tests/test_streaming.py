"""The coverage monitor gives the same on a stream of files as on a table."""

from foldspark.streaming.coverage import rolling_coverage


def test_stream_equals_table(spark, tmp_path):
    schema = "series_id string, model string, ts timestamp, actual double, lower double, upper double"
    rows = spark.sql("select 's' series_id, 'm' model, timestamp'2024-01-01' + make_interval(0,0,0,0,id*5) ts, cast(id as double) actual, 0.0D lower, 6.0D upper from (select cast(id as int) id from range(20))")
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stream = rolling_coverage(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("coverage").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.table("coverage")) == key(rolling_coverage(rows)) and spark.table("coverage").count() == 4
